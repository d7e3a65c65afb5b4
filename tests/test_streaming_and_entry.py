import os
import subprocess
import sys

from pyspark.sql import functions as F

from crossfade.streaming import exposure as E


def test_a_stream_keeps_the_exposure_table(spark, sf, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.union(events.limit(50)).repartition(3).write.parquet(src)  # some events arrive twice
    E.keep_exposure(E.read_events(spark, src), out, check).awaitTermination()
    got = E.exposure_table(spark, out)
    want = E.shown(events).groupBy("user_id", "track_id").agg(F.min("ts").alias("first_shown"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    E.keep_exposure(E.read_events(spark, src), out, check).awaitTermination()  # nothing new
    assert E.exposure_table(spark, out).count() == got.count()
    user = got.first().user_id
    cands = spark.range(200).select(F.col("id").cast("string").alias("track_id"))
    assert E.unseen(cands, got, user).count() == 200 - got.where(F.col("user_id") == user).count()
    assert E.hourly(events).agg(F.sum("n")).first()[0] == events.count()


def test_the_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('crossfade.llm'):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e, bench, crossfade.__main__, crossfade.streaming.exposure, crossfade.plans.report
assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
