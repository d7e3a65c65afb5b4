import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_scans import ODD, save

import crossfade.llm.collocations as C
from crossfade.llm.collocations import collocations
from crossfade.llm.queries import op12_collocations

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, max_n=5, subsume=100, top=2000):
    sizes, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII)):
            own = re.findall("[^ \t]+", piece)
            sizes[lang] += len(own)
            for i in range(len(own)):
                for m in range(1, min(max_n, len(own) - i) + 1):
                    f[lang, tuple(own[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    outer = Counter()
    for (lang, words), n in f.items():
        for m in range(2, len(words)):
            for a in range(len(words) - m + 1):
                outer[lang, words[a : a + m]] = max(outer[lang, words[a : a + m]], n)
    out = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and not 100 * outer[lang, words] >= subsume * a:
            cuts = [(1000 * a * sizes[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], sizes[lang]))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, found in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top], 1))


def table(spark, rows):
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    return df.withColumn("phrase", F.lit("clash")).withColumn("a.b", F.lit(1))


def corpus():
    rng = random.Random(12)
    odd = ["a\x00b \x01 \x08c a\x00b \x01 \x08c", "\x01 a\x01 a \x01b a b", "a b\nc d\r\na b", "a.b,c;d:e!f?g", "É é ſ K İ", "A b A B a B", "\ta  b\t\tc ", "x" * 70_000 + " y x", "q " * 3000]
    out = [(lang, t) for t in ODD + odd for lang in ("en", None)]
    for lang in ("en", "de", "und", "", "z\x00z", None):
        out += [(lang, " ".join(rng.choice(["a", "b", "B", "c.", "a b c d", "é", "\x01", "rare%d" % rng.randrange(999)]) for _ in range(rng.randrange(1, 40)))) for _ in range(60)]
    return out + [("en", "one two three four five six")] * 9


def test_counts_and_ranks_are_brute_force(spark):
    own = corpus()
    for least, max_n, subsume, top in ((3, 5, 100, 2000), (8, 3, 60, 7), (2, 2, 100, 50), (4, 7, 90, 2000)):
        df = collocations(table(spark, own).repartition(5), least=least, max_n=max_n, subsume=subsume, top=top)
        assert sorted(tuple(r) for r in df.collect()) == brute(own, least, max_n, subsume, top)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_hot_prefixes_and_repeated_words(spark):
    # one word, one pair and one passage hold most of all words: their prefixes are shuffled by more words
    rng = random.Random(2)
    own = [("en", "the " * 400)] * 6 + [("en", " ".join("of the %s" % rng.choice("klmnop") for _ in range(300)))] * 3 + [("en", "to be or not to be")] * 50
    own += [("en", " ".join(rng.choice("abcdefgh") for _ in range(100))) for _ in range(50)]
    assert sorted(tuple(r) for r in collocations(table(spark, own).repartition(7), least=20).collect()) == brute(own, 20)
    survey = C._survey(table(spark, own).select("lang", "text"), 5)
    hot = survey.where("kind = 2").where(F.col("n") > survey.where("kind = 0").agg(F.sum("n")).first()[0] * C.HOT_SHARE).select("key").toPandas()["key"].to_numpy().view("uint64")
    sc = spark.sparkContext
    blocks = C._suffixes(table(spark, own).select("lang", "text"), sc.broadcast(np.full(1 << (C.BUCKET_BITS - 3), 255, np.uint8)), sc.broadcast(np.sort(hot)), 5, 64)
    rows = blocks.mapInArrow(C._spread, "suffix binary, n long, depth tinyint").groupBy("depth").agg(F.sum("n").alias("words")).collect()
    assert len(rows) > 2  # some are dealt by one word, some by more
    assert sum(r.words for r in rows) == sum(len(t.split()) for _, t in own)
    dealt = blocks.groupBy("bucket").agg(F.sum(F.length("block")).alias("bytes")).agg(F.max("bytes").alias("most"), F.avg("bytes").alias("mean")).first()
    assert dealt.most < 12 * dealt.mean


@pytest.mark.parametrize("batch", [1, 2, 5, 100_000])
def test_the_stack_goes_on_from_batch_to_batch(batch):
    rng = random.Random(batch)
    words = ["a", "ab", "abc", "b", "\x01", "aa"]
    rows = sorted({tuple([rng.choice(words), rng.choice(["00", "0011"]), *[rng.choice(words) for _ in range(rng.randrange(0, 5))]]) for _ in range(400)}, key=lambda r: b"\0".join(w.encode() for w in r), reverse=True)
    n = [rng.randrange(1, 9) for _ in rows]
    want = Counter()
    for row, k in zip(rows, n):
        for m in range(2, len(row) + 1):
            want[row[:m]] += k
    for least, depth in ((1, 1), (30, 1), (30, 3)):
        stack, got = C._Stack(5, least), []
        for i in range(0, len(rows), batch):
            part = rows[i : i + batch]
            stack.push(pa.array([b"\0".join(w.encode() for w in r) for r in part], pa.binary()), np.array(n[i : i + batch]), np.full(len(part), depth, np.int8))
        stack.finish()
        got = Counter({tuple(x.decode() for x in p.split(b"\0")): k for p, k in stack.closed})
        assert len(stack.closed) == len(got) and got == {p: k for p, k in want.items() if k >= least or len(p) - 1 < depth}


def test_query_is_brute_force_and_leaves_one_table(spark, tmp_path):
    rng = random.Random(4)
    own = [("en", " ".join(rng.choice("abcdefg") for _ in range(400))) for _ in range(40)] + [(None, "x y z. " * 150), ("fr", "")]
    d = save(spark, tmp_path, documents=table(spark, own))
    from crossfade.llm.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = sorted(tuple(r) for r in op12_collocations(spark, d).collect())
    assert got == brute(own, 100) and got
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"collocations"}


def test_products_beyond_64_bits(spark, monkeypatch):
    big = {"x": 3_000_000_000_000_019, "y": 1_000_000_007, "x y": 999_999_937, "z": 2_000_000_000_000_003, "y z": 999_999_999, "x y z": 999_999_930}
    n = 60_000_000_000_000_007

    def counts(docs, scratch, *_):
        s = docs.sparkSession
        return s.createDataFrame([("en", n)], "lang string, n long"), s.createDataFrame([("en", k, v) for k, v in big.items()], "lang string, phrase string, f long")

    monkeypatch.setattr(C, "phrase_counts", counts)
    got = {r.phrase: (r.score, r.l, r.r) for r in collocations(table(spark, [("en", "")])).collect()}
    want = {}
    for p in ("x y", "y z", "x y z"):
        own = p.split()
        score, k = min((1000 * big[p] * n // (big[" ".join(own[:k])] * big[" ".join(own[k:])]), k) for k in range(1, len(own)))
        want[p] = (score, big[" ".join(own[:k])], big[" ".join(own[k:])])
    assert got == want


def test_nothing_to_count(spark):
    for own in ([], [("en", None), (None, ""), ("de", " .,; \n")], [("en", "a b c")]):
        assert collocations(table(spark, own) if own else table(spark, [("en", "")]).limit(0)).count() == 0
