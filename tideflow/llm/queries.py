"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, line_dedup, near_dedup, packing, quality, secrets, suffix_dedup, toxicity, url_filter, warc
from .common import scan

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


@query(warc.sql())
def op1_warc(spark, sf_dir):
    out = warc.archive_pages(scan(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


@query(line_dedup.sql())
def op2_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(scan(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op3_toxicity(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, scan(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query(secrets.sql())
def op4_secrets(spark, sf_dir):
    out = secrets.find_secrets(scan(spark, sf_dir, "documents"), repository=F.md5(F.coalesce("text", F.lit(""))))
    count = lambda test: F.size(F.filter("found", test)).cast("bigint")
    n = lambda kind: count(lambda s: s["kind"] == kind).alias(f"n_{kind}")
    return out.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"),
    )


@query()
def op5_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.dedup_substrings(scan(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col("repeats")
    return out.select(
        "doc_id", r["n_bytes"].alias("n_bytes"), (r["n_bytes"] - F.octet_length(r["kept"])).alias("n_removed"),
        F.size(r["spans"]).cast("bigint").alias("n_spans"), F.sha2(r["kept"], 256).alias("kept_sha256"),
    )


@query(quality.sql())
def op6_quality_rules(spark, sf_dir):
    judged = quality.quality(scan(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(url_filter.sql())
def op7_url_filter(spark, sf_dir):
    return url_filter.judge(scan(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query()
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(scan(spark, sf_dir, "documents").select("doc_id", "text"))


@query(decontaminate.sql())
def op9_decontamination(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, scan(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return out.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


@query()
def op10_near_dedup(spark, sf_dir):
    out = near_dedup.near_duplicates(scan(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id")
