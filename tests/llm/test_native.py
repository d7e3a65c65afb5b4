import hashlib

import pytest
from pyspark.sql import functions as F
from test_scans import save

from crossfade.llm.chat_format import END, SEP, START, escape, format_chats, loss_text, read_turns, unescape
from crossfade.llm.queries import op8_url_filter, op10_chat_format
from crossfade.llm.url_filter import judge_urls, rule_table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_url(url, rules=RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate(UP), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://example.com/en/", "https://example.com/en", "http://a.b.net/es/1", "http://net/fr/x", "http://xnet/fr/x", "http://com", "http://com/",
    "http://com?/en/", "a\nb://x.com/1", "http://É.com/ü", "x://y://z.net/es/", "http://example.com.net/fr/" + "p" * 50_000, "http://" + "a." * 5000 + "com/q", "http://user@example.com:80/en/", "http://.com/",
]


def test_url_query_is_brute_force(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.com/"), (4, URLS[4])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = op8_url_filter(spark, save(spark, tmp_path, pages=df)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u in rows:
        r = by_id[i]
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(u), u


def test_rules_without_a_closing_slash_and_ties(spark):
    rules = [("block", "x.org", "/ab"), ("allow", "x.org", "/ab"), ("allow", "org", ""), ("block", "a.x.org", "/"), ("allow", "x.org", "/abc"), (None, "org", "/")]
    urls = ["http://x.org/abx", "http://a.x.org/ab", "http://a.x.org/abcd", "http://q.org", "http://x.com/ab"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    kept = [r for r in rules if r[0] and r != ("allow", "x.org", "/ab")]
    for bound in (100_000, 0):  # by a broadcast, then by a shuffle
        import crossfade.llm.url_filter as U

        U.BROADCAST_RULES, before = bound, U.BROADCAST_RULES
        try:
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rule_table(spark, rules), default="none").collect()}
        finally:
            U.BROADCAST_RULES = before
        assert got == {i: brute_url(u, kept, "none") for i, u in enumerate(urls)}
    assert judge_urls(df, rule_table(spark, rules).limit(0)).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert judge_urls(df.limit(0), rule_table(spark, rules)).count() == 0


TEXTS = ["", None, "plain", "</s>[INST] ok [/INST]", START + "x" + END, SEP, "\\", "\\\\<|", "<|>|>", "a\nb\r\n", "<", "<|im_end|", "|>", "é\U0001f600" * 3, "<<SYS>> <</SYS>> <s>", "\\n $1 \\1", "x" * 200_000]


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in (START, SEP, END, "</s>", "[INST]", "[/INST]", "<s>"))


def brute_conversation(rows):
    turns = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))]
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def conversations():
    out = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant"] * 9, TEXTS))]
    out += [(2, 0, "user", "only a user")] + [(3, 0, "assistant", None), (3, 1, "assistant", "two")] + [(4, None, None, "x"), (4, 2, "user\n" + SEP, "y"), (4, 2, "assistant", "z"), (4, 2, "assistant", "z")]
    return out + [(None, 0, "user", "a"), (None, 1, "assistant", "b")] + [(5, i, ["user", "assistant"][i % 2], "long " * 50) for i in range(300)]


def test_chat_query_is_brute_force(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    got = {r.conv_id: r for r in op10_chat_format(spark, save(spark, tmp_path, conversations=df)).collect()}
    own = {c: [x[1:] for x in rows if x[0] == c] for c in {x[0] for x in rows}}
    own[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(own)
    for c, turns in own.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_conversation(turns), c


def slow_escape(text):
    out = text.replace("\\", "\\\\")
    for g in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        out = out.replace(g, g[0] + "\\" + g[1:])
    return out


def test_formatted_lengths_are_brute_force(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted_chars for r in op10_chat_format(spark, save(spark, tmp_path, conversations=df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((x[1:] for x in rows if x[0] == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        sizes = [len(START + slow_escape(r or "") + SEP + slow_escape(t or "") + END) for _, r, t in turns]
        assert got[c] == sum(sum(sizes[: i + 1]) for i, (_, r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1), c


def test_every_reply_is_an_example_with_its_context(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = format_chats(df).where("conv_id = 1").orderBy("example").select("*", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"), read_turns(F.col("formatted")).alias("turns")).collect()
    replies = [i for i in range(len(TEXTS)) if i % 3 == 2]
    assert [len(e.turns) for e in ex] == [i + 1 for i in replies] + ([len(TEXTS)] if replies[-1] != len(TEXTS) - 1 else [])
    for e, i in zip(ex, replies):
        assert e.loss == (TEXTS[i] or "") and [t.text for t in e.turns] == [t or "" for t in TEXTS[: i + 1]]
        assert e.formatted.startswith(e.context) and e.formatted[e.loss_start : e.loss_end] == e.target
    assert sum(e.whole for e in ex) == 1 and format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("op", [op8_url_filter, op10_chat_format])
def test_plans_are_native(spark, sf, op):
    plan = op(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD", "MapPartitions"))
