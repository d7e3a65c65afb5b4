"""Feature transforms, scaling, weights, similarity, explanation and steering.

Features stay scalar DOUBLE columns, so that a whole scoring pass is one
generated loop; fitted statistics are a single row that is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DURATION_BOUNDS, EXPLAINED, FEATURES, LOUDNESS_BOUNDS, MAX_ADJUSTMENT, STEERABLE, STEERING_STRENGTH, STEERING_WEIGHT, TEMPO_BOUNDS


def numeric(c: Column) -> Column:
    """As a double; what isn't a number is null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def clip(c: Column, bounds: tuple[float, float]) -> Column:
    """Within bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), c)))


def duration_ms(df: DataFrame) -> Column:
    """Milliseconds: ``duration_ms``, or ``duration`` in seconds."""
    if "duration_ms" in df.columns:
        return numeric(F.col("duration_ms"))
    if "duration" in df.columns:
        return numeric(F.col("duration")) * 1000
    raise ValueError("no duration column")


def transformed(df: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, Column]:
    """Each feature as it is fitted and compared: clipped, and where skewed on a log scale."""
    missing = [f for f in features if f not in df.columns and f != "duration_ms"]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    special = {
        "tempo": lambda: F.log1p(clip(numeric(F.col("tempo")), TEMPO_BOUNDS)),
        "loudness": lambda: clip(numeric(F.col("loudness")), LOUDNESS_BOUNDS),
        "duration_ms": lambda: F.log1p(clip(duration_ms(df), DURATION_BOUNDS) / 60_000),
    }
    return {f: special[f]() if f in special else numeric(F.col(f)) for f in features}


def with_transformed(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``df`` with a column t_<feature> for each."""
    return df.withColumns({f"t_{f}": c for f, c in transformed(df, features).items()})


SKETCH = 10_000  # of a quantile sketch: ranks are off by one part in so many
GATHERED = 50_000  # values of a column that are brought together for its median, at most


def wide_medians(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row of exact medians, {name: column}, for which a bounded number of values is gathered.

    A mergeable sketch gives two values close about the median. Counts of what
    lies below, at and between them say where the median's ranks are, and as
    long as more than ``GATHERED`` may lie between, a sketch of those alone
    moves the two closer, to about a thousandth at a time. The scans for that
    run here and now and bring a few numbers to the driver; the last one, which
    gathers what is left between, runs when the row is asked for. A value that
    many rows share is only counted.
    """
    off = 4 / SKETCH
    around = lambda x, q: F.percentile_approx(x, F.array(*[F.lit(min(1.0, max(0.0, q + o))) for o in (-off, off)]), F.lit(SKETCH))
    first = df.agg(*[a for k, c in columns.items() for a in (around(c, 0.5).alias(f"e_{k}"), F.count(c).alias(f"n_{k}"))]).first()
    size = {k: first[f"n_{k}"] for k in columns if first[f"n_{k}"]}
    ends = {k: tuple(first[f"e_{k}"]) for k in size}
    # ranks are off by no more than one part in SKETCH on either side
    most = {k: size[k] * 10 / SKETCH + 2 for k in size}
    between = lambda k: (F.col(columns[k]) > ends[k][0]) & (F.col(columns[k]) < ends[k][1])
    while wide := [k for k in size if most[k] > GATHERED]:
        counts = df.agg(*[a for k in wide for a in (F.count_if(F.col(columns[k]) <= ends[k][0]).alias(f"below_{k}"), F.count_if(between(k)).alias(f"in_{k}"))]).first()
        left = {k: (size[k] - 1) / 2 - counts[f"below_{k}"] for k in wide}
        some = [k for k in wide if counts[f"in_{k}"] > GATHERED]
        most |= {k: counts[f"in_{k}"] for k in wide}
        if some:
            nearer = df.agg(*[around(F.when(between(k), F.col(columns[k])), left[k] / counts[f"in_{k}"]).alias(f"e_{k}") for k in some]).first()
            for k in some:
                # an end that may be beyond a rank of the median stays as it was
                low, high = nearer[f"e_{k}"]
                q = left[k] / counts[f"in_{k}"]
                ends[k] = (low if q > off else ends[k][0], high if q < 1 - off else ends[k][1])
                most[k] = counts[f"in_{k}"] * 10 / SKETCH + 2
    parts = []
    for k in size:
        x, (lo, hi) = F.col(columns[k]), ends[k]
        parts += [F.count_if(x < lo).alias(f"below_{k}"), F.count_if(x == lo).alias(f"lo_{k}"), F.collect_list(F.when(between(k), x)).alias(f"between_{k}")]
    out = df.agg(F.lit(1).alias("one"), *parts)

    def at(k: str, rank: int) -> Column:
        """The value of a rank from 0."""
        left = F.lit(rank) - F.col(f"below_{k}") - F.col(f"lo_{k}")
        return F.when(left < 0, F.lit(ends[k][0])).when(left < F.size(f"between_{k}"), F.get(F.array_sort(f"between_{k}"), left.cast("int"))).otherwise(F.lit(ends[k][1]))

    middle = lambda k: (at(k, (size[k] - 1) // 2) + at(k, size[k] // 2)) / 2
    return out.select(*[(middle(k) if k in size else F.lit(None).cast("double")).alias(k) for k in columns])


def fit_scaler(df: DataFrame, features: Sequence[str] = FEATURES, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Medians, and means and population deviations of the imputed features, over t_ columns.

    med_<f>, mean_<f>, sd_<f>: a feature without any value has median 0, and a
    constant one deviation 1. ``by`` fits each group on its own. Of a
    ``bounded`` set, and of groups, medians are gathered in the same
    aggregation; of others they take two passes of their own.
    """
    gathered = bounded or bool(by)
    parts = []
    for f in features:
        t = f"t_{f}"
        parts += [*[F.median(t).alias(f"m_{f}")] * gathered, F.avg(t).alias(f"a_{f}"), F.var_pop(t).alias(f"v_{f}"), F.count(t).alias(f"n_{f}")]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *parts)
    if not gathered:
        out = out.crossJoin(F.broadcast(wide_medians(df, {f"m_{f}": f"t_{f}" for f in features})))
    cols = {}
    for f in features:
        med = F.coalesce(f"m_{f}", F.lit(0.0))
        some, gaps = F.col(f"n_{f}").cast("double"), (F.col("n") - F.col(f"n_{f}")).cast("double")
        avg, var = F.coalesce(f"a_{f}", F.lit(0.0)), F.coalesce(f"v_{f}", F.lit(0.0))
        mean = F.when(gaps == 0, avg).when(some == 0, med).otherwise((some * avg + gaps * med) / F.col("n"))
        spread = F.when(gaps == 0, var).otherwise((some * (var + F.pow(avg - mean, F.lit(2.0))) + gaps * F.pow(med - mean, F.lit(2.0))) / F.col("n"))
        sd = F.sqrt(spread)
        cols |= {f"med_{f}": med, f"mean_{f}": mean, f"sd_{f}": F.when(sd < 1e-12, 1.0).otherwise(sd)}
    return out.select(*by, "n", *[c.alias(k) for k, c in cols.items()])


def scaled(f: str) -> Column:
    """z of a feature, from its t_ column and the fitted row beside it; what isn't finite becomes 0."""
    z = (F.coalesce(f"t_{f}", f"med_{f}") - F.col(f"mean_{f}")) / F.col(f"sd_{f}")
    return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(z)


def with_scaled(df: DataFrame, stats: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``df`` with z_<feature> columns in place of t_ ones; ``stats`` is one row."""
    wide = df.crossJoin(F.broadcast(stats.drop("n")))
    keep = [c for c in df.columns if not (c.startswith("t_") and c[2:] in features)]
    return wide.select(*keep, *[scaled(f).alias(f"z_{f}") for f in features])


def profile(df: DataFrame, method: str = "median", features: Sequence[str] = FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """The taste of a set of rows: p_<feature>, the median or mean of z_ columns."""
    if method not in ("median", "mean"):
        raise ValueError(f"unknown profile method: {method}")
    agg = F.median if method == "median" else F.avg
    if by and method == "median":
        # a median's state is a map of all its values: rows are brought together as they are, not as maps of one value each
        df = df.select(*by, *[f"z_{f}" for f in features]).repartition(*by)
    return df.groupBy(*by).agg(*[agg(f"z_{f}").alias(f"p_{f}") for f in features])


def check_weights(weights: Mapping[str, float] | None, features: Sequence[str] = FEATURES) -> dict[str, float]:
    """Weights as floats, from any number or text of one; unknown, non-numeric, non-finite and negative ones are an error."""
    out = {}
    for name, value in (weights or {}).items():
        if name not in features:
            raise ValueError(f"unknown feature: {name}")
        try:
            out[name] = float(value)
        except (TypeError, ValueError):
            out[name] = math.nan
        if not (math.isfinite(out[name]) and out[name] >= 0):
            raise ValueError(f"weight of {name} must be finite and not negative: {value!r}")
    return out


def cosine(u: Sequence[Column], v: Sequence[Column]) -> Column:
    """Of two vectors of columns; 0 if either has no length."""
    if len(u) != len(v) or not u:
        raise ValueError("vectors must be of one, positive dimension")
    total = lambda cs: sum(cs[1:], cs[0])
    dot = total([a * b for a, b in zip(u, v, strict=True)])
    size = F.sqrt(total([a * a for a in u])) * F.sqrt(total([b * b for b in v]))
    return F.when(size > 0, dot / size).otherwise(0.0)


def weighted_cosine(weights: Mapping[str, float] | None, features: Sequence[str] = FEATURES) -> Column:
    """Of p_ and z_ columns, both sides weighted; a feature without a weight counts as it is."""
    w = check_weights(weights, features)
    return cosine([F.col(f"p_{f}") * w.get(f, 1.0) for f in features], [F.col(f"z_{f}") * w.get(f, 1.0) for f in features])


# fixed values: the sentences of an explanation
def explanation(features: Sequence[str] = FEATURES, most: int = 3) -> Column:
    """A sentence that names the closest traits of p_ and z_ columns, ties in feature order."""
    if most < 1:
        raise ValueError("most must be at least 1")
    named = [(i, f) for i, f in enumerate(features) if f in EXPLAINED]
    if not named:
        return F.lit("Recommended because its overall audio profile is similar to your playlist.")
    gaps = F.array_sort(F.array(*[F.struct(F.abs(F.col(f"z_{f}") - F.col(f"p_{f}")).alias("d"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in named]))
    traits = F.transform(F.slice(gaps, 1, most), lambda x: x["f"])
    n = min(most, len(named))
    if n == 1:
        text = F.get(traits, 0)
    elif n == 2:
        text = F.concat(F.get(traits, 0), F.lit(" and "), F.get(traits, 1))
    else:
        text = F.concat(F.array_join(F.slice(traits, 1, n - 1), ", "), F.lit(", and "), F.get(traits, n - 1))
    return F.concat(F.lit("Recommended because it is similar to your playlist in "), text, F.lit("."))


def check_adjustments(adjustments: Mapping[str, float] | None) -> dict[str, float]:
    """Steering shifts clamped to their range, zeros left out; unknown features and non-finite shifts are an error."""
    out = {}
    for name, value in (adjustments or {}).items():
        if name not in STEERABLE:
            raise ValueError(f"not a steerable feature: {name}")
        shift = float(value)
        if not math.isfinite(shift):
            raise ValueError(f"shift of {name} must be finite")
        shift = max(-MAX_ADJUSTMENT, min(MAX_ADJUSTMENT, shift))
        if shift:
            out[name] = shift
    return out


def steering_target(baseline: Column, shift: float) -> Column:
    """Where a shift moves a baseline, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), baseline + shift * STEERING_STRENGTH))


def steering_penalty(value: Column, baseline: Column, shift: float) -> Column:
    """What a candidate's distance from the target costs; a missing value counts as the baseline, a missing baseline costs nothing."""
    gap = F.abs(F.coalesce(numeric(value), baseline) - steering_target(baseline, shift))
    return F.when(baseline.isNull(), 0.0).otherwise(STEERING_WEIGHT * gap)


