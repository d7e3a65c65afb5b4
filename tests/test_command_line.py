import csv
import json

import pytest
from pyspark.sql import functions as F
from test_recommend import big, playlists

from crossfade import __main__ as M
from crossfade.plans import report as P
from crossfade.sources import sinks as K
from crossfade.sources import tables as S


def rows_of(path):
    with open(path) as f:
        return list(csv.DictReader(f))


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A published catalog and a label file under the names of other tools."""
    d = tmp_path_factory.mktemp("shop")
    cat = big(spark)
    missing = {c: "0.5" for c in ("valence", "speechiness", "acousticness", "instrumentalness", "liveness", "loudness")}
    wide = cat.withColumns({c: F.lit(v).cast("double") for c, v in missing.items() if c not in cat.columns}).withColumn("title_canon", F.lower("title_raw"))
    K.publish_catalog(wide, str(d / "catalog"), "v1")
    labels = playlists(spark).withColumnsRenamed({"source_track_id": "source_spotify_id", "catalog_track_id": "catalog_spotify_id", "playlist_id": "list"})
    K.write_csv(labels, str(d / "labels.csv"))
    with open(d / "matches.csv", "w") as f:
        f.write("playlist_id,total_unique_source_tracks,matched_unique_tracks\np0,10,9\np1,9,9\nother,5,0\n")
    return d


def test_tune_then_evaluate(spark, shop):
    at = lambda name: str(shop / name)
    M.main(["tune", at("labels.csv"), "--catalog", at("catalog"), "--playlist-col", "list", "--splits", "1", "--top-k", "5", "--bootstrap", "5", "--trials", "3", "--seed-size", "4", "--output", at("tune.json")])
    tuned = json.load(open(at("tune.json")))
    held = tuned["partition"]["test_playlist_ids"]
    (shop / "README.md").write_text(f"a\n{P.BEGIN}\nold\n{P.END}\nz\n")
    M.main([
        "evaluate", at("labels.csv"), "--catalog", at("catalog"), "--playlist-col", "list", "--splits", "1", "--top-k", "5", "--bootstrap", "5", "--seed-size", "4", "--min-popularity", "10", "--candidate-limit", "30",
        "--confidence", "0.9", "--min-playlists", "2", "--only", at("tune.json"), "--matches", at("matches.csv"), "--output", at("out/e.json"), "--report", at("e.md"), "--per-split", at("per.csv"),
        "--recommendations", at("recs.csv"), "--readme", at("README.md"),
    ])
    data = json.load(open(at("out/e.json")))
    assert data["labels"]["schema"] == "membership-v2" and data["labels"]["preserves_unmatched"] and data["labels"]["playlists"] == len(held) and len(data["labels"]["sha256"]) == 64
    assert data["catalog"]["rows"] == 40 and data["config"]["candidate_limit"] == 30 and data["config"]["confidence_level"] == 0.9 and data["status"] == "benchmark"
    # the held-out list names the weights too
    assert data["inputs"]["only"]["playlist_ids"] == sorted(held) and {s["name"] for s in data["strategies"]} >= {"tuned_deployed", "tuned_weighted_cosine_pca"} and len(data["summary"]) == 9
    of = {r["playlist_id"]: r for r in rows_of(at("matches.csv"))}
    some = [of[i] for i in held if i in of]
    assert data["matches"] == ({"num_playlists": len(some), "total_source_tracks": sum(int(r["total_unique_source_tracks"]) for r in some), "matched_tracks": sum(int(r["matched_unique_tracks"]) for r in some), "match_rate": sum(int(r["matched_unique_tracks"]) for r in some) / sum(int(r["total_unique_source_tracks"]) for r in some)} if some else None)
    per, recs = rows_of(at("per.csv")), rows_of(at("recs.csv"))
    assert len(per) + 9 * len(data["skipped"]) == 9 * len(held) and len(recs) == 5 * len(per) and {"rank", "track_id", "relevant"} <= set(recs[0])
    text = (shop / "e.md").read_text()
    assert "90% CI" in text and "| tuned_deployed |" in text and "## Method" in text
    readme = (shop / "README.md").read_text()
    assert readme.startswith("a\n") and readme.endswith("\nz\n") and "old" not in readme and "deployed" in readme


def test_labels_are_looked_for(spark, shop, monkeypatch):
    monkeypatch.chdir(shop)
    monkeypatch.setattr(M, "LABELS", ("absent.csv", "labels.csv"))
    assert M._given(spark, M.parser().parse_args(["evaluate", "--catalog", str(shop / "catalog")]))[2] == "labels.csv"
    monkeypatch.setattr(M, "LABELS", ("absent.csv",))
    with pytest.raises(SystemExit):
        M._given(spark, M.parser().parse_args(["evaluate"]))


def test_publishing_on_a_named_file_system(spark, shop):
    """Another URI form, groups of the published size, the same artifact again, and a table that another reader may replace."""
    import pyarrow.parquet as pq

    folder = f"file://{shop}/remote"
    rows = spark.read.parquet(f"file://{S.current_artifact(str(shop / 'catalog'))}")
    many = rows.crossJoin(spark.range(7000)).coalesce(1)
    path = K.publish_catalog(many, folder, "v2")
    assert path.startswith(folder) and K.publish_catalog(rows, folder, "v3") != path and S.read_catalog(spark, path).count() == many.count()
    assert K.publish_catalog(rows, folder, "v3") == S.current_artifact(folder)
    part = next((shop / "remote" / path.rpartition("/")[2]).glob("part-*"))
    meta = pq.ParquetFile(part).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)][:2] == [122_880, 122_880]
    assert len(list((shop / "remote").glob("[!.]*"))) == 3
