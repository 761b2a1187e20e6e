"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import table
from . import bpe, formatdup, mixing, neardup, pii, quantiles, topn, truncation

PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of both savings columns per command type and day, and, from the sketches of the days, per month and over all days."""
    runs = table(spark, d, "token_saver_runs").withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    days = written(quantiles.sketches(runs, ["command_type", "day"], ["savings_percent", "estimated_saved_tokens"]), "days")
    keys, out = ["command_type", "period", "metric"], None
    for period in (F.col("day"), F.substring("day", 1, 7), F.lit("all")):
        part = days.withColumn("period", period)
        part = quantiles.percentiles(quantiles.merge_sketches(part, keys), keys, PERCENTILES)
        out = part if out is None else out.unionByName(part)
    return out


def _format_copies(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    o = table(spark, d, "observations").select(F.lit("observations").alias("part"), "id", "title", "content")
    u = table(spark, d, "user_prompts").select(F.lit("user_prompts").alias("part"), "id", none.alias("title"), "content")
    return formatdup.format_copies(o.unionByName(u), ["title", "content"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    copies = _format_copies(spark, d).filter("id <> first_id")
    return copies.select(F.col("part").alias("record_table"), "first_id", F.col("id").alias("copy_id"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record that has copies: the first of its group and the number of copies, itself included."""
    return _format_copies(spark, d).groupBy(F.col("part").alias("record_table"), "first_id").agg(F.count(F.lit(1)).alias("copies"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").filter(F.col("project").isNotNull() & F.col("deleted_at").isNull())
    rows = o.select("project", F.col("type").alias("obs_type"), F.col("id").alias("obs_id"), "created_at")
    top = topn.top_n_per_group(rows, ["project", "obs_type"], [F.col("created_at").desc_nulls_last(), F.col("obs_id").desc()], 5)
    return top.select("project", "obs_type", "obs_id")


_P4_FOUND = """
SELECT project, type AS obs_type, id AS obs_id FROM observations WHERE project IS NOT NULL AND deleted_at IS NULL
QUALIFY row_number() OVER (PARTITION BY project, type ORDER BY created_at DESC NULLS LAST, id DESC) <= 5
"""


def _contents(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("part"), "id", F.col("content").alias("text")) for t in ("observations", "user_prompts")]
    return parts[0].unionByName(parts[1])


#: Key of the replacements; a real run passes its own secret.
KEY = "basalt"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.replacements(_contents(spark, d), KEY)
    return found.select(F.col("part").alias("record_table"), F.col("id").alias("record_id"), F.col("kind").alias("pii_kind"), F.col("no").alias("occurrence_no"))


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every content with typed, keyed placeholders instead of personal data."""
    return pii.masked(_contents(spark, d), KEY).withColumnRenamed("part", "record_table").withColumnRenamed("id", "record_id")


def p6_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Every content with keyed surrogates of the same form instead of personal data."""
    return pii.masked(_contents(spark, d), KEY, surrogates=True).withColumnRenamed("part", "record_table").withColumnRenamed("id", "record_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "observations"), ["title", "content"], threshold=0.6, size=3)


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every observation with the class of its word set, the size of that class, and the class's number of similar classes."""
    members, links = neardup.similar_classes(table(spark, d, "observations"), ["title", "content"], threshold=0.6, size=3)
    links = written(links, "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("class_id"))
    return members.join(sizes.join(degree, "digest", "left"), "digest").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "text", ["doc_id"])


def _mix(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    wanted = F.broadcast(targets.select("source").distinct())  # settings, a row per source
    kept = docs.join(wanted, "source", "left_semi").withColumn("weight", mixing.quality_weight(F.col("text")))
    counted = written(bpe.encode(kept, "text", ["doc_id", "source", "weight"], as_count=True), "sizes")
    return mixing.mix(counted, targets)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each mix and how often each is used."""
    return _mix(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares that each mix reaches."""
    return mixing.shares(written(_mix(spark, d), "mix"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per source the number of texts and of cut texts, how many of these lie at a length limit and how many elsewhere, and the share cut."""
    docs = table(spark, d, "documents")
    cut = truncation.truncated(docs).groupBy("source").agg(F.count(F.lit(1)).alias("cut"), F.count_if("at_limit").alias("cut_at_limit"))
    every = docs.groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    out = every.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    n, limit = F.coalesce("cut", F.lit(0)), F.coalesce("cut_at_limit", F.lit(0))
    return out.select("source", "texts", n.alias("cut"), limit.alias("cut_at_limit"), (n - limit).alias("cut_elsewhere"), (n / F.col("texts")).alias("share"))


QUERIES = {"p1_percentiles": p1_percentiles, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p6_found": p6_found, "p6_masked": p6_masked, "p6_surrogates": p6_surrogates, "p7_found": p7_found, "p7_classes": p7_classes, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_sources": p10_sources}
SQL = {"p4_found": _P4_FOUND}
