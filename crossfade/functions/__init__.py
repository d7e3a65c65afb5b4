"""Functions of the recommendation engine."""
