import base64
import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F
from test_scans import ODD, rows_of, save

from crossfade.llm.quality_rules import BAD_SHARE, BANDS, CHUNK, Compressor, _word_codes, quality_rules, repeated_words
from crossfade.llm.queries import op11_quality_rules


def brute(text):
    text = text or ""
    own = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside)


def limits(size):
    found = [b for b in BANDS if size >= b.least]
    return (found[-1].low, found[-1].high) if found else (0, 99)


def brute_reason(text):
    raw = (text or "").encode()
    if not raw:
        return None
    squeeze = lambda b: len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(b)) / len(b)
    low, high = limits(len(raw))
    if squeeze(raw) < low or squeeze(raw) > high:
        return "repetitive" if squeeze(raw) < low else "incompressible"
    parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) > CHUNK else []
    few = sum(len(p) for p in parts if squeeze(p) < limits(len(p))[0])
    many = sum(len(p) for p in parts if squeeze(p) > limits(len(p))[1])
    return "repetitive" if few > BAD_SHARE * len(raw) else "incompressible" if many > BAD_SHARE * len(raw) else None


def prose(rng, n):
    stems = ["".join(rng.choice("aeioubcdflmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    return " ".join(rng.choice(stems) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


def noise(rng, n):
    return base64.b64encode(rng.randbytes(n)).decode()


def texts():
    rng = random.Random(11)
    odd = ODD + ["a\na\n \n \na", "a\r\na\na\r", "x\x0by\x0cz", "one two three four five one two three four five", "#*$%&|<> é#", "\n\n", "a b c d e " * 2, "Up up UP up Up up UP up", " ".join("abcdefghij")]
    return odd + [" ".join(rng.choice(["a", "b", "É", "c\n", "#"]) for _ in range(rng.randrange(60))) for _ in range(120)] + [prose(rng, 50), prose(rng, 4000), noise(rng, 3000), prose(rng, 9000) + noise(rng, 30000), prose(rng, 9000) + " na" * 9000]


def test_query_is_brute_force(spark, tmp_path):
    own = texts()
    d = save(spark, tmp_path, documents=rows_of(spark, own + [own[-1]], lang="en", n_words="clash", ratio="clash"))
    got = sorted(op11_quality_rules(spark, d).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(own) + 1 and got[-1][1:] == got[-2][1:]
    for r, t in zip(got, own):
        n, chars, symbols, dup, repeat = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), t[:80]
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and r.reason == brute_reason(t)
        assert r.kept == (not r.base_failed and r.reason is None)
    assert [r.reason for r in got[-6:-1]] == [None, None, "incompressible", "incompressible", "repetitive"]


def test_windows_of_many_words_are_numbered_exactly():
    rng = random.Random(5)
    own = [str(rng.randrange(40_000)) for _ in range(60_000)] + ["p", "q", "r", "s", "t", "u", "p", "q", "r", "s", "t"]
    codes, distinct = _word_codes(" ".join(own).encode())
    assert distinct**5 > 1 << 63 and repeated_words(codes, distinct) == 10
    assert len(set(zip(own, codes.tolist()))) == distinct


def test_a_text_longer_than_a_piece_is_split_at_blanks(monkeypatch):
    import crossfade.llm.quality_rules as Q

    monkeypatch.setattr(Q, "_PIECE", 7)
    own = "aa bbbbbbbbbbbbbbbbb c  d\te aa f aa" * 3
    codes, distinct = _word_codes(own.encode())
    assert len(codes) == len(own.split()) and distinct == len(set(own.split()))


def test_bands_depend_on_length():
    rng = random.Random(7)
    zstd = Compressor()
    for n in (3, 20, 60, 200, 900, 5000, 40_000):
        assert zstd.judge(prose(rng, n).encode(), BAD_SHARE)[3] is None, n
        if n >= 60:
            assert zstd.judge(b"all of it again " * n, BAD_SHARE)[3] == "repetitive"
            assert zstd.judge(rng.randbytes(8 * n), BAD_SHARE)[3] == "incompressible"


def test_other_limits_and_empty_tables(spark):
    from crossfade.llm.quality_rules import Band

    df = rows_of(spark, ["plain words of no great length", None]).withColumn("ID", F.lit("x"))
    got = {r.doc_id: r.reason for r in quality_rules(df, bands=(Band(1, 2.0, 3.0),)).collect()}
    assert got == {0: "repetitive", 1: None} and quality_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_keep_their_type(spark, kind):
    df = rows_of(spark, ["a"]).withColumn("doc_id", F.col("doc_id").cast(kind))
    assert dict(quality_rules(df).dtypes)["doc_id"] == {"string": "string", "long": "bigint"}[kind]
