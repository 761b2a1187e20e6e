"""Mixing sources to target weights by weighted sampling without replacement.

The budget of a source is its share of the mix's total, in tokens. As many complete
epochs as fit are taken of all its documents; the rest is filled by a weighted sample: each
document draws the key -ln(u) / weight, and documents are taken in order of
their keys while their tokens fit. u is a hash of the mix, the document and a seed, so a run repeats. The
running sum over a source is taken in two steps, over the sums of narrow ranges of the key and
then inside the one range that holds the border, so no source is sorted in one task. The ranges have equal widths in the key's logarithm: of
draws of any weight, and of any mixture of weights, one holds at most 1 / (e * BINS) * ln 2 of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the sampling key to each of its doublings.
BINS = 1024


def quality_weight(text: Column) -> Column:
    """Weight of a document for sampling, 0.05 to 1, by signs of poor text that hold in any script, in prose as in code.

    The product of: the share of lines that aren't repeats of another line; the share of characters that are no long run of one
    character (of ten and more); one less ten times the share of characters that are left over from broken
    encodings or control; and the length up to 200 characters, as a share, of which half counts. A null or empty text has the least weight.
    """
    n = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda x: F.length(F.trim(x)) > 0)
    fresh = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    runs = F.length(F.regexp_replace(text, r"(.)\1{9,}", "")) / n
    broken = F.length(text) - F.length(F.regexp_replace(text, r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0E-\x1F\x7F]|Ã[\x{0080}-\x{00BF}]", ""))
    long_ = 0.5 + 0.5 * F.least(n / 200.0, F.lit(1.0))
    score = fresh * runs * F.greatest(1 - 10 * broken / n, F.lit(0.0)) * long_
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 1) -> DataFrame:
    """mix_name, source, target_share, doc_id, n_tokens, uses: the selected documents and how often each is used.

    docs: doc_id, source, n_tokens, weight (positive; null or other counts as 1); targets as the table
    mix_targets: a small table of settings, one row per mix and source. Without total_tokens a mix gets the largest total at which every source that
    has documents reaches its share (of what such sources share) within its max_repeats; with it,
    a source that max_repeats holds below its share gives all it may. Documents without
    tokens, of a null source, or of sources in no mix are never selected; a source without documents gives none; a
    target with a null or non-positive share or max_repeats selects none. uses never exceeds max_repeats.
    """
    usable = docs.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    wanted = targets.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sizes = usable.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    have = wanted.join(sizes, "source")
    per_mix = Window.partitionBy("mix_name")
    share = F.col("target_share") / F.sum("target_share").over(per_mix)
    plan = have.withColumn("share", share).withColumn("most", F.col("size") * F.col("max_repeats"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.col("most") / F.col("share")).over(per_mix)
    plan = plan.withColumn("budget", F.least(F.col("most").cast("double"), F.col("share") * total))
    plan = plan.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("size") + 1e-9), F.col("max_repeats").cast("long")))
    plan = plan.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.col("budget") - F.col("epochs") * F.col("size"), F.lit(0.0))).otherwise(0.0))
    plan = plan.select("mix_name", "source", "target_share", "epochs", "rest")
    # settings: a row per mix and source, of the size of mix_targets whatever the documents
    drawn = usable.join(F.broadcast(plan), "source")
    u = (F.shiftrightunsigned(F.xxhash64("mix_name", "doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    drawn = drawn.withColumn("key", -F.log(u) / weight).withColumn("bin", F.floor(F.log2("key") * BINS).cast("int"))
    bins = drawn.groupBy("mix_name", "source", "bin").agg(F.sum("n_tokens").alias("in_bin"))
    before = F.sum("in_bin").over(Window.partitionBy("mix_name", "source").orderBy("bin")) - F.col("in_bin")
    border = bins.withColumn("before", before).join(F.broadcast(plan), ["mix_name", "source"])
    border = border.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_bin") > F.col("rest"))).select("mix_name", "source", F.col("bin").alias("border"), "before")
    # one bin for each mix and source at most
    met = drawn.join(F.broadcast(border), ["mix_name", "source"], "left")
    whole = met.filter(F.col("border").isNull() | (F.col("bin") != F.col("border")))
    whole = whole.withColumn("extra", F.when(F.col("border").isNull() | (F.col("bin") < F.col("border")), 1).otherwise(0))
    whole = whole.withColumn("extra", F.when(F.col("rest") > 0, F.col("extra")).otherwise(0))
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("mix_name", "source").orderBy("key", "doc_id"))
    # the document at the border is taken if that comes nearer to the budget
    inside = met.filter(F.col("bin") == F.col("border")).withColumn("extra", F.when((F.col("rest") > 0) & (run - F.col("n_tokens") / 2 <= F.col("rest")), 1).otherwise(0))
    cols = ["mix_name", "source", "target_share", "doc_id", "n_tokens", (F.col("epochs") + F.col("extra")).alias("uses")]
    return whole.select(*cols).unionByName(inside.select(*cols)).filter(F.col("uses") > 0)


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, max_repeats, n_docs, tokens, actual_share for every row of the targets."""
    got = selected.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    out = targets.select("mix_name", "source", "target_share", "max_repeats").join(F.broadcast(got), ["mix_name", "source"], "left")
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    out = out.withColumn("n_docs", F.coalesce("n_docs", F.lit(0))).withColumn("tokens", tokens)
    every = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return out.withColumn("actual_share", F.when(every > 0, F.col("tokens") / every).otherwise(0.0))
