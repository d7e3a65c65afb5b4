import io
import random
import re
import unicodedata
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from crossfade.functions import text as T
from crossfade.operators import retrieve as C
from crossfade.schema import TITLE_VARIANTS
from crossfade.sources import fixtures as S
from crossfade.sources import sinks as K
from crossfade.sources import tables as R


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def slow_canon(title):
    """The rules of a canonical title, one at a time."""
    t = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().strip().lower()
    marked = lambda s: any(re.search(rf"\b{k}\b", s) for k in TITLE_VARIANTS)
    while (m := re.search(r"[(\[{]([^()\[\]{}]+)[)\]}]\s*$", t)) and marked(m[1]):
        t = t[: m.start()].rstrip()
    head, dash, tail = t.partition("-")
    if dash and "\n" not in t and tail.strip() and marked(tail):
        t = head.rstrip()
    return " ".join(re.sub(r"[^\w\s]", " ", t).split())


def test_random_titles_follow_the_rules(spark):
    rng = random.Random(11)
    bits = ["song", "Live", "(live)", "[Remastered 2011]", "{x}", " - ", "-", "radio edit", "é", " ", "(", ")", "acoustic mix", "!", "alive", "(club mix) ", "ﬁ", "\t"]
    titles = sorted({"".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(600)})
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", T.canon_title(F.col("t")).alias("c")).collect()
    assert [(r.t, r.c) for r in rows if r.c != slow_canon(r.t)] == []


def test_bounds_reach_the_scan_and_columns_are_pruned(spark, sf, tmp_path):
    K.publish_catalog(S.catalog(spark, sf), str(tmp_path), "v1")
    cat = R.read_catalog(spark, "file://" + R.current_artifact(str(tmp_path)))
    text = plan(C.filter_candidates(cat, ["1"], min_popularity=20, year_range=(1970, 2000)).select("track_id"))
    assert "GreaterThanOrEqual(release_year,1970)" in text and "LessThanOrEqual(release_year,2000)" in text
    assert "ReadSchema: struct<track_id:string,popularity:float,release_year:smallint>" in text
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_the_bounded_sample_is_a_top_k(spark, sf):
    assert "TakeOrderedAndProject" in plan(C.bounded_sample(S.catalog(spark, sf), 10))


def test_ascii_titles_skip_the_python_fold(spark):
    # the fold's input is null wherever a title is plain
    df = spark.createDataFrame([("plain",), ("é",)], "t string")
    seen = df.select(F.when(F.col("t").rlike(r"[^\x00-\x7F]"), F.col("t")).alias("x")).where("x is not null").count()
    assert seen == 1 and "ArrowEvalPython" in plan(df.select(T.canon_title(F.col("t"))))
