"""Command line: build a catalog, build labels, evaluate, tune."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.labels import filter_playlists, label_facts, normalize_memberships
from .operators.match import build_labels, read_match_summary
from .plans import report as P
from .plans.benchmark import TuningConfig, evaluate, tune
from .plans.policy import DEFAULT_STRATEGIES, BenchmarkConfig, with_tuned
from .sources import sinks as K
from .sources import tables as S
from .sources.storage import Folder

#: Labels that are looked for, best first, where none are named.
LABELS = ("labels.csv", "data/labels.csv", "data/examples/labels.csv", "data/examples/matched_labels.csv")

AS_READ = "row_as_read"  # the column of a label's place in its file


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crossfade", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("catalog", help="merge CSV files and publish the catalog")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--folder", default="catalog")
    c.add_argument("--version", default="v1")
    c.add_argument("--cache", default=".dataset_cache")
    c.add_argument("--rebuild", action="store_true")
    c.add_argument("--draws", action="store_true", help="also publish the rows in the order of their draws, for samples that read a part")
    b = sub.add_parser("labels", help="match pages of playlist items (playlist_id, page, body) to the catalog")
    b.add_argument("pages", help="JSON lines")
    b.add_argument("--catalog", default="catalog")
    b.add_argument("--min-matched", type=int, default=10)
    b.add_argument("--output", default="labels.csv")
    b.add_argument("--summary", default="match_summary.csv")
    cfg = BenchmarkConfig()
    for name in ("evaluate", "tune"):
        p = sub.add_parser(name)
        p.add_argument("labels", nargs="?", help=f"a CSV file; else the first there is of {', '.join(LABELS)}")
        p.add_argument("--catalog", default="catalog", help="the folder that was published to")
        p.add_argument("--catalog-path", help="a Parquet catalog, in place of the published one")
        p.add_argument("--playlist-col", default="playlist_id")
        p.add_argument("--splits", type=int, default=cfg.num_splits if name == "evaluate" else TuningConfig().benchmark.num_splits)
        p.add_argument("--seed-size", type=int, default=cfg.seed_size)
        p.add_argument("--top-k", type=int, default=cfg.top_k)
        p.add_argument("--seed", type=int, default=cfg.seed)
        p.add_argument("--min-popularity", type=float, default=cfg.min_popularity)
        p.add_argument("--candidate-limit", type=int, default=cfg.candidate_limit)
        p.add_argument("--bootstrap", type=int, default=cfg.bootstrap_samples, help="resamples of playlists")
        p.add_argument("--confidence", type=float, default=cfg.confidence_level)
        p.add_argument("--min-playlists", type=int, default=cfg.min_playlists_for_claim if name == "evaluate" else TuningConfig().min_playlists, help="for a claim" if name == "evaluate" else "to tune at all")
        p.add_argument("--output", default=f"{name}.json")
    e, t = sub.choices["evaluate"], sub.choices["tune"]
    e.add_argument("--only", help="playlist ids: a text list, or a tuning result's held-out ones")
    e.add_argument("--tuned", help="a tuning result whose weights are evaluated too; else that of --only, if it is one")
    e.add_argument("--matches", help="the summary that the label builder has written")
    e.add_argument("--report", default="evaluation.md")
    e.add_argument("--per-split", help="a CSV file for the figures of every request")
    e.add_argument("--recommendations", help="a CSV file for everything shown")
    e.add_argument("--skipped", help="a CSV file for every request that was left out, and why")
    e.add_argument("--readme", help="a README with a marked place for the short table")
    tuning = TuningConfig()
    t.add_argument("--trials", type=int, default=tuning.num_trials)
    t.add_argument("--test-fraction", type=float, default=tuning.test_fraction)
    t.add_argument("--least-weight", type=float, default=tuning.weight_min)
    t.add_argument("--most-weight", type=float, default=tuning.weight_max)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("crossfade").getOrCreate()
    {"catalog": _catalog, "labels": _labels, "evaluate": _evaluate, "tune": _tune}[a.command](spark, a)


def _catalog(spark: SparkSession, a: argparse.Namespace) -> None:
    merged = K.merged_catalog(spark, a.inputs, a.cache, a.rebuild)
    artifact = K.publish_catalog(merged, a.folder, a.version)
    if a.draws:
        K.publish_draws(spark, artifact)
    print(artifact, f"{S.csv_rows(spark, a.inputs)} rows read, {merged.count()} kept")


def _labels(spark: SparkSession, a: argparse.Namespace) -> None:
    items = S.read_playlist_pages(spark.read.schema("playlist_id string, page int, body string").json(a.pages)).select(
        "playlist_id", "position", F.col("track.id").alias("source_track_id"), F.col("track.name").alias("title"), F.col("track.artists.name").alias("artists"), F.col("track.duration_ms").alias("duration_ms")
    )
    labels, summary = build_labels(items, K.catalog_bundle(spark, a.catalog), a.min_matched)
    K.write_csv(labels, a.output)
    K.write_csv(summary.orderBy("playlist_id"), a.summary)


def _given(spark: SparkSession, a: argparse.Namespace):
    """The catalog's path, the labels as they were read, and their path."""
    path = a.labels or S.first_existing(LABELS)
    if path is None:
        raise SystemExit(f"no labels: none of {', '.join(LABELS)} is there")
    return S.current_artifact(a.catalog, a.catalog_path), S.read_csv(spark, Folder(spark, path).uri, AS_READ), path


def _config(a: argparse.Namespace, **more) -> BenchmarkConfig:
    return BenchmarkConfig(
        top_k=a.top_k, seed_size=a.seed_size, num_splits=a.splits, seed=a.seed, min_popularity=a.min_popularity, candidate_limit=a.candidate_limit, bootstrap_samples=a.bootstrap, confidence_level=a.confidence, **more
    )


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    artifact, raw, path = _given(spark, a)
    facts = label_facts(raw) | {"path": path, "sha256": K.sha256_file(spark, path)}
    labels = normalize_memberships(raw, a.playlist_col, AS_READ).drop(AS_READ)
    only = S.read_id_filter(spark, a.only) if a.only else None
    if only is not None:
        labels = filter_playlists(labels, only)
    tuned = a.tuned or (a.only if a.only and a.only.endswith(".json") else None)
    strategies = with_tuned(S.read_weights(tuned)) if tuned else DEFAULT_STRATEGIES
    inputs = {name: {"path": p, "sha256": K.sha256_file(spark, p)} for name, p in (("only", a.only), ("tuned", tuned)) if p}
    if only is not None:
        inputs["only"]["playlist_ids"] = sorted(only)
    counts = labels.agg(F.count("*").alias("rows"), F.count_distinct("playlist_id").alias("playlists")).first().asDict()
    matches = read_match_summary(S.read_csv(spark, Folder(spark, a.matches).uri), only) if a.matches else None
    cfg = _config(a, min_playlists_for_claim=a.min_playlists)
    result = evaluate(S.read_catalog(spark, artifact), labels, cfg, strategies)
    more = {"labels": facts | counts, "catalog": {"path": artifact, "rows": S.row_count(spark, Folder(spark, artifact).uri), "candidate_limit": cfg.candidate_limit}, "matches": matches, "inputs": inputs}
    data = P.payload(result, cfg, strategies, **more)
    K.write_json(data, a.output)
    K.write_text(P.render(data), a.report)
    if a.per_split:
        K.write_csv(result.per_split.orderBy("playlist_id", "split_id", "strategy"), a.per_split)
    if a.recommendations:
        K.write_csv(result.recommendations.orderBy("playlist_id", "split_id", "strategy", "rank"), a.recommendations)
    if a.skipped:
        K.write_csv(result.skipped.orderBy("playlist_id", "split_id"), a.skipped)
    if a.readme:
        P.update_readme(a.readme, data, a.report)
    result.release()


def _tune(spark: SparkSession, a: argparse.Namespace) -> None:
    artifact, raw, _ = _given(spark, a)
    cfg = TuningConfig(num_trials=a.trials, test_fraction=a.test_fraction, weight_min=a.least_weight, weight_max=a.most_weight, min_playlists=a.min_playlists, benchmark=_config(a))
    found = tune(S.read_catalog(spark, artifact), normalize_memberships(raw, a.playlist_col, AS_READ).drop(AS_READ), cfg)
    K.write_text(found.to_json() + "\n", a.output)


if __name__ == "__main__":
    main()
