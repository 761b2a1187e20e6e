"""References to records that don't exist, by runs of parent keys.

Sorted parent keys are compressed into runs of consecutive keys. A
reference looks up the run that starts last before it (the as-of match); if its key lies
beyond that run's end, it has no parent. Runs are cut where the parent's state
changes and at the borders of key blocks of ``2 ** bits`` keys, so that the as-of match is
an equality join on the block and a search in its few runs. Keys that are no numbers are numbered first, densely and in
their order, over parents and references together, so that parents between which no orphan lies form a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_with_hot_keys, written


def integer_key(text: Column) -> Column:
    """The number in a padded text: blanks around and zeros before it don't matter; null if it's none."""
    digits = F.regexp_extract(text, r"^[\s ]*([+-]?[0-9]+)[\s ]*$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def dense_numbers(ids: DataFrame, id_: str) -> DataFrame:
    """id and key (long), one row for each id that isn't null: sorted ids have consecutive keys within each range of ids.

    Ids are cut into ranges, each sorted by one task; a range starts a new stretch of keys, so no task needs the sizes of the others.
    """
    one = ids.select(F.col(id_)).filter(F.col(id_).isNotNull()).distinct()
    ranges = one.repartitionByRange(id_).sortWithinPartitions(id_)
    return written(ranges.withColumn("key", F.monotonically_increasing_id()), "numbers")


def parent_runs(parents: DataFrame, bits: int) -> DataFrame:
    """block, runs: array of (first, last, name, gone, since), in order of first.

    parents: key (long), name (string or null, told apart beside the key), gone (boolean), since.
    Of repeated keys the earliest ``since`` counts, and a key is gone only if all its rows are.
    since of a run is the latest of its keys; a run of one key has it exactly.
    """
    one = (
        parents.filter(F.col("key").isNotNull())
        .groupBy("key", "name")
        .agg(F.min("gone").alias("gone"), F.min("since").alias("since"))
        .withColumn("block", F.shiftright("key", bits))
    )
    w = Window.partitionBy("block").orderBy("key", "name")
    breaks = F.lag("key").over(w).eqNullSafe(F.col("key") - 1) & F.lag("gone").over(w).eqNullSafe(F.col("gone")) & F.col("name").isNull()
    numbered = one.withColumn("run", F.sum(F.when(breaks, 0).otherwise(1)).over(w))
    runs = numbered.groupBy("block", "run").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.min("name").alias("name"), F.min("gone").alias("gone"), F.max("since").alias("since")
    )
    return runs.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("first", "last", "name", "gone", "since"))).alias("runs"))


def orphan_references(refs: DataFrame, parents: DataFrame, bits: int = 8) -> DataFrame:
    """ref, reason ('missing', 'deleted' or 'late'): the references without a usable parent.

    refs: ref (its id), key (long or null), name, at (timestamp). A null key is missing. A
    reference is late if its parent's since lies after at; a null time is never late.
    """
    blocks = parent_runs(parents, bits)
    keyed = refs.withColumn("block", F.shiftright("key", bits))
    # as-of: runs are sorted, so the last run that starts at or before the key
    met = join_with_hot_keys(keyed, blocks, "block", "left")
    before = F.filter(F.col("runs"), lambda r: (r["first"] <= F.col("key")) & (r["name"].isNull() | (r["first"] < F.col("key")) | (r["name"] == F.col("name"))))
    run = met.withColumn("run", F.try_element_at(before, F.lit(-1))).drop("runs")
    found = F.col("run").isNotNull() & (F.col("key") <= F.col("run.last")) & (F.col("run.name").isNull() | F.col("run.name").eqNullSafe(F.col("name")))
    run = run.withColumn("found", F.coalesce(found, F.lit(False))).withColumn("maybe_late", F.coalesce(F.col("run.since") > F.col("at"), F.lit(False)))
    sure = F.when(~F.col("found"), "missing").when(F.col("run.gone"), "deleted").when(F.col("maybe_late") & (F.col("run.first") == F.col("run.last")), "late")
    run = run.withColumn("reason", sure)
    # inside a longer run since is only a bound: the few that it doesn't clear look up their own parent
    unsure = run.filter(F.col("reason").isNull() & F.col("maybe_late")).select("ref", "key", "at")
    exact = parents.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("since").alias("since"))
    late = join_with_hot_keys(unsure, exact, "key").filter(F.col("since") > F.col("at")).select("ref", F.lit("late").alias("reason"))
    return run.filter(F.col("reason").isNotNull()).select("ref", "reason").unionByName(late)
