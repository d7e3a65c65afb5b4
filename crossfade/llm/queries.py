"""One query per operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, loss_text, read_turns
from .chat_repair import repair_digests
from .collocations import collocations
from .decontaminate import overlaps
from .license_scan import scan_licenses
from .minhash_dedup import near_duplicates
from .packing import pack_documents
from .quality_knn import fit_quality, held_out, score_quality
from .quality_rules import quality_rules
from .secret_scan import KINDS, scan_secrets
from .shared import materialize
from .token_counts import TokenRollup, count_tokens
from .topk_kdtree import top_k
from .url_filter import judge_urls, rule_table

#: (verdict, host, path); fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LEAST_QUALITY = 0.3
PACK_WORDS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), PACK_WORDS)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        _sha256(listed(of(*KINDS[:3]))).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: insert, the same again, an end-of-text token on each byte-pair count, and the deletion of exact copies."""
    counts = materialize(count_tokens(table(spark, sf_dir, "documents")), "token-counts")
    rollup = TokenRollup(spark)
    insert = counts.select(F.lit("insert").alias("op"), "doc_id", "version", "source", "lang", "n_tokens")
    rollup.commit("insert", insert)
    rollup.commit("insert", insert)  # a repeat: without effect
    ended = rollup.ledger().where(F.col("version") == "byte-bpe-50k")
    rollup.commit("end-of-text", ended.select(F.lit("revise").alias("op"), "doc_id", "version", "source", "lang", (F.col("n_tokens") + 1).alias("n_tokens")))
    first = counts.groupBy("copy").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("copy", "first")
    # as a table of its own, so that a join on a hot copy can be split
    first = materialize(first, "first-copies")
    copies = counts.join(first, "copy").where("doc_id <> first")
    rollup.commit("copies", copies.select(F.lit("delete").alias("op"), "doc_id", "version", "source", "lang", "n_tokens"))
    return rollup.totals()


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(~held_out(F.col("doc_id"))))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), _sha256(F.array_join("items", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    convs = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    examples = format_chats(convs)
    # read back from the formatted texts and their masks alone
    turns = F.when(F.col("whole"), read_turns(F.col("formatted")))
    read = examples.select("conv_id", "example", F.char_length("formatted").cast("long").alias("chars"), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"), turns.alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n_turns"), _sha256(said).alias("turns_sha256"))
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    read = read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), _sha256(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("reason").isNull()).alias("kept"), "ratio", "low_bytes", "high_bytes", "reason")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fifth of their rows damaged, by the crc32 of conversation and turn; nulls become one blank."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.where("hit <> 0").select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    ids = convs.select("conv_id").distinct()
    found = repair_digests(damaged(convs)).withColumnRenamed("conv_id", "found")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = [none(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", _sha256(F.lit(""))).alias("repaired_sha256"))


# the parts of operators 1, 3, 4 and 11 that SQL can follow, through the same code


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts alone: insert, revise half of the documents, delete a third, insert some again."""
    counts = materialize(count_tokens(table(spark, sf_dir, "documents")).where("version = 'words'"), "word-counts")
    rollup = TokenRollup(spark)
    change = lambda op, n: counts.select(F.lit(op).alias("op"), "doc_id", "version", "source", "lang", n.alias("n_tokens"))
    rollup.commit("insert", change("insert", F.col("n_tokens")))
    rollup.commit("revise", change("revise", 2 * F.col("n_tokens") + 1).where("doc_id % 2 = 0"))
    rollup.commit("delete", change("delete", F.col("n_tokens")).where("doc_id % 3 = 0"))
    rollup.commit("again", change("insert", F.lit(7)).where("doc_id % 9 = 0"))
    return rollup.totals()


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict:
    named = (op1_license_scan, op2_best_fit_packing, op3_secret_scan, op4_token_counts, op5_quality_knn, op6_minhash_dedup, op7_kdtree_topk, op8_url_filter, op9_decontamination, op10_chat_format, op11_quality_rules, op12_collocations, op13_chat_repair, license_base, secret_base, token_rollup_words, quality_base)
    return {f.__name__: f for f in named}
