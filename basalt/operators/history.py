"""History of changing attributes, kept by comparing Merkle trees of snapshots.

A snapshot's rows are hashed into ``fanout ** depth`` leaf buckets by key. The depth follows the number of keys, so that a
leaf holds few keys whatever the size, and few changes leave most leaves alone. The digest of
a bucket is the sum of its rows' hashes, so it needs no order and combines before
the shuffle; a branch's digest is the sum of its children's. Two snapshots are
compared from the root: only children of branches that differ are looked at, and
only rows of leaf buckets that differ are read for the diff. A leaf's number in a shallow tree is that in a deep one
modulo the number of leaves, so trees of different depths are compared at the lesser. History and tree are kept
in a folder between runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

FANOUT, DEPTH = 16, 4
#: Keys a leaf holds on average at most, up to a tree of the greatest depth.
LEAF_KEYS, DEEPEST = 64, 7
#: Trees of so many leaves lie in one partition, so comparing them shuffles nothing.
SMALL_TREE = 65_536
_M = (1 << 31) - 1


def leaf_of(keys: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> Column:
    """Leaf bucket of a key; a null is a key value like any other."""
    return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys)), F.lit(fanout**depth)).cast("int")


def tree_depth(rows: DataFrame, keys: list[str], fanout: int = FANOUT) -> int:
    """Depth of the tree for so many keys (counted within a few per cent)."""
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*(F.col(k).cast("string") for k in keys)))).first()[0]
    depth = 2
    while depth < DEEPEST and fanout**depth * LEAF_KEYS < n:
        depth += 1
    return depth


def _row_digest(cols: list[str]) -> list[Column]:
    """Two independent 31-bit hashes of a row, nulls told from empty strings; their sums fit a long."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return [F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(_M)) for seed in (17, 91)]


def merkle_leaves(df: DataFrame, keys: list[str], cols: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """leaf, n, d1, d2: the digests of the leaf buckets, written. At most fanout ** depth rows, and at most a row a key."""
    a, b = _row_digest([*keys, *cols])
    leaves = (
        df.select(leaf_of(keys, fanout, depth).alias("leaf"), a.alias("a"), b.alias("b"))
        .groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("d1"), F.sum("b").alias("d2"))
    )
    leaves = written(leaves, "leaves")
    return leaves.coalesce(1) if fanout**depth <= SMALL_TREE else leaves


def at_depth(leaves: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """The leaves of a deeper tree as those of a tree of this depth."""
    return leaves.groupBy((F.col("leaf") % fanout**depth).cast("int").alias("leaf")).agg(*(F.sum(c).alias(c) for c in ("n", "d1", "d2")))


def differing_leaves(old: DataFrame, new: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Leaf buckets that differ, found from the root down: a level keeps the children of the differing branches of the level above.

    Small trees lie in one partition each, so no level shuffles.
    """
    small = fanout**depth <= SMALL_TREE

    def level(height: int) -> DataFrame:
        at = F.col("leaf") if height == 0 else F.expr(f"leaf div {fanout**height}").cast("int")
        side = lambda x, sign: x.select(at.alias("node"), *((F.col(c) * sign).alias(c) for c in ("n", "d1", "d2")))
        both = side(old, -1).unionByName(side(new, 1))
        both = both.coalesce(1) if small else both
        return both.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n", "d1", "d2")))

    differs = (F.col("n") != 0) | (F.col("d1") != 0) | (F.col("d2") != 0)
    open_nodes = None
    for height in range(depth - 1, -1, -1):
        nodes = level(height)
        if open_nodes is not None:
            up = F.expr(f"node div {fanout}").cast("int")
            nodes = nodes.withColumn("parent", up).join(open_nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
        open_nodes = nodes.filter(differs).select("node")
    return open_nodes.select(F.col("node").alias("leaf"))


def versions_of_edits(edits: DataFrame, keys: list[str], old: str, new: str, at: str, order: str) -> DataFrame:
    """keys, value, valid_from, valid_to: the versions that a log of edits opens.

    Edits of a key are ordered by (at, order). Of edits at the same instant the last counts.
    An edit opens a version if its value differs from the one in force, which at first is
    the old value of the key's very first edit. A null value is an empty one; edits
    without a time are left out; null keys form keys of their own; valid_to is null while
    a version is in force.

    A key may hold any share of the rows: edits of one instant collapse before the shuffle,
    the rest is split by day, and days are stitched by one summary row each.
    """
    e = edits.filter(F.col(at).isNotNull()).select(
        *keys, F.col(at).alias("__t"), F.col(order).alias("__o"), F.coalesce(F.col(old), F.lit("")).alias("__old"), F.coalesce(F.col(new), F.lit("")).alias("__new")
    )
    e = e.withColumn("__day", F.to_date("__t"))
    instants = e.groupBy(*keys, "__day", "__t").agg(F.max(F.struct("__o", "__new")).alias("__last"), F.min(F.struct("__o", "__old")).alias("__first"))
    part = [*keys, "__day"]
    w = Window.partitionBy(*part).orderBy("__t")
    rows = instants.repartition(*part).select(*part, "__t", F.col("__last.__new").alias("value"), F.col("__first.__old").alias("__was"))
    rows = rows.withColumn("__prev", F.lag("value").over(w)).withColumn("__inner", F.col("__prev").isNotNull() & (F.col("__prev") != F.col("value")))
    days = rows.groupBy(*part).agg(
        F.min(F.struct("__t", "value", "__was")).alias("__head"),
        F.max(F.struct("__t", "value")).alias("__tail"),
        F.min(F.when(F.col("__inner"), F.col("__t"))).alias("__inner_t"),
    )
    wd = Window.partitionBy(*keys).orderBy("__day")
    days = days.withColumn("__before", F.coalesce(F.lag("__tail.value").over(wd), F.col("__head.__was")))
    days = days.withColumn("__opens", F.when(F.col("__head.value") != F.col("__before"), F.col("__head.__t")).otherwise(F.col("__inner_t")))
    days = days.withColumn("__next_day", F.min("__opens").over(wd.rowsBetween(1, Window.unboundedFollowing)))
    days = days.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(part)), "__before", "__next_day")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(part)]
    opened = (
        rows.join(days, on)
        .withColumn("__prev", F.coalesce("__prev", "__before"))
        .filter(F.col("__prev") != F.col("value"))
        .withColumn("valid_to", F.coalesce(F.lead("__t").over(w), F.col("__next_day")))
    )
    return opened.select(*keys, "value", F.col("__t").alias("valid_from"), "valid_to")


def apply_edit_snapshot(history: DataFrame | None, old_leaves: DataFrame | None, log: DataFrame, leaves: DataFrame, keys: list[str], old: str, new: str, at: str, order: str, depth: int = DEPTH) -> DataFrame:
    """A stored history (none at first) and the leaves of the log it was made from, brought up to a newer log.

    Leaf buckets in which the two snapshots of the edit log agree keep their stored versions
    unread; in the others the keys' versions are taken from the new log. Both trees have the given depth.
    """
    if history is None:
        return versions_of_edits(log, keys, old, new, at, order)
    changed = differing_leaves(old_leaves, leaves, depth=depth)
    changed = F.broadcast(changed) if FANOUT**depth <= SMALL_TREE else changed
    leaf = leaf_of(keys, depth=depth)
    kept = history.withColumn("leaf", leaf).join(changed, "leaf", "left_anti").drop("leaf")
    fresh = log.withColumn("leaf", leaf).join(changed, "leaf", "left_semi").drop("leaf")
    return kept.unionByName(versions_of_edits(fresh, keys, old, new, at, order))


def history_of_edits(edits: DataFrame, keys: list[str], old: str, new: str, at: str, order: str, cuts: list) -> DataFrame:
    """History of an edit log, built snapshot by snapshot: one up to each cut, stored with its tree, then the whole log."""
    history = tree = None
    depth = tree_depth(edits, keys)
    for cut in cuts:
        log = edits.filter(F.col(at) <= F.lit(cut))
        leaves = merkle_leaves(log, keys, [old, new, at, order], depth=depth)
        history, tree = written(apply_edit_snapshot(history, tree, log, leaves, keys, old, new, at, order, depth), "history"), leaves
    return apply_edit_snapshot(history, tree, edits, merkle_leaves(edits, keys, [old, new, at, order], depth=depth), keys, old, new, at, order, depth)


def comparison(old_leaves: DataFrame, leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """leaves, differing, rows, rows_read, skipped: how much of a newer snapshot is left unread, as a share of its rows."""
    changed = differing_leaves(old_leaves, leaves, depth=depth).withColumn("differs", F.lit(1))
    x = leaves.join(changed, "leaf", "left").select("n", F.coalesce("differs", F.lit(0)).alias("differs"))
    g = x.agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum("differs"), F.lit(0)).alias("differing"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("differs")), F.lit(0)).alias("rows_read"))
    return g.withColumn("skipped", F.when(F.col("rows") > 0, 1 - F.col("rows_read") / F.col("rows")).otherwise(1.0))


class StoredHistory:
    """A history and its tree in a folder that all executors share, kept between runs.

    A run writes a new version beside the last one and ends with its tree; a version without a complete tree doesn't count,
    so a run that fails leaves the one before it in force. The version before the last is deleted.
    """

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, int]]:
        """(number, depth) of the complete versions, in order."""
        if not self._fs.exists(self._root):
            return []
        names = [x.getPath().getName().split("-") for x in self._fs.listStatus(self._root)]
        whole = [(int(n[0]), int(n[1])) for n in names if len(n) == 2 and all(map(str.isdigit, n))]
        return sorted(v for v in whole if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{self._at(*v)}/leaves/_SUCCESS")))

    def _at(self, number: int, depth: int) -> str:
        return f"{self.folder}/{number:09d}-{depth}"

    def read(self) -> DataFrame | None:
        """The history as the last run left it."""
        last = self._versions()[-1:]
        return self.spark.read.parquet(f"{self._at(*last[0])}/history") if last else None

    def update(self, log: DataFrame, keys: list[str], old: str, new: str, at: str, order: str) -> tuple[DataFrame, DataFrame | None]:
        """The history brought up to a newer log, and comparison() with the log before (none at first)."""
        before, depth = self._versions(), tree_depth(log, keys)
        leaves = merkle_leaves(log, keys, [old, new, at, order], depth=depth)
        history = tree = report = None
        common, now = depth, leaves
        if before:
            common = min(depth, before[-1][1])
            history, tree = self.read(), self.spark.read.parquet(f"{self._at(*before[-1])}/leaves")
            tree, now = (x if d == common else at_depth(x, common) for x, d in ((tree, before[-1][1]), (leaves, depth)))
            report = comparison(tree, now, common)
        made = apply_edit_snapshot(history, tree, log, now, keys, old, new, at, order, common)
        to = self._at(before[-1][0] + 1 if before else 1, depth)
        made.write.mode("overwrite").parquet(f"{to}/history")
        report = written(report, "comparison") if report is not None else None
        leaves.write.mode("overwrite").parquet(f"{to}/leaves")
        for v in before[:-1]:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(self._at(*v)), True)
        return self.read(), report


def apply_state_snapshot(history: DataFrame, snapshot: DataFrame, keys: list[str], cols: list[str], at: Column) -> DataFrame:
    """A history of whole rows (keys, cols, valid_from, valid_to), brought up to a snapshot taken at a time.

    Versions in force are the previous snapshot. Leaf buckets that agree keep their versions; in the
    others changed and vanished keys' versions end at the snapshot's time, and
    changed and new keys open versions. Of several rows of a key the one with the largest values counts.
    """
    vals = F.struct(*cols)
    now = snapshot.groupBy(*keys).agg(F.max(vals).alias("__now")).select(*keys, *(F.col(f"__now.{c}").alias(c) for c in cols))
    open_rows = history.filter(F.col("valid_to").isNull())
    depth = tree_depth(now, keys)
    leaf = leaf_of(keys, depth=depth)
    leaves = differing_leaves(merkle_leaves(open_rows, keys, cols, depth=depth), merkle_leaves(now, keys, cols, depth=depth), depth=depth)
    leaves = F.broadcast(leaves) if FANOUT**depth <= SMALL_TREE else leaves
    h = history.withColumn("leaf", leaf)
    kept = h.join(leaves, "leaf", "left_anti").drop("leaf")
    touched = h.join(leaves, "leaf", "left_semi").drop("leaf")
    n = now.withColumn("leaf", leaf).join(leaves, "leaf", "left_semi").select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), vals.alias("__now")
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    closed = touched.filter(F.col("valid_to").isNotNull())
    met = touched.filter(F.col("valid_to").isNull()).withColumn("__h", F.lit(True)).join(n.withColumn("__n", F.lit(True)), on, "full")
    ends = F.col("__h") & ~(F.col("__n").isNotNull() & vals.eqNullSafe(F.col("__now")))
    still = met.filter(F.col("__h")).withColumn("valid_to", F.when(ends, at)).select(*history.columns)
    opens = met.filter(F.col("__n") & (F.col("__h").isNull() | ~vals.eqNullSafe(F.col("__now"))))
    begun = opens.select(
        *(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)), *(F.col(f"__now.{c}").alias(c) for c in cols), at.alias("valid_from"), F.lit(None).cast(dict(history.dtypes)["valid_to"]).alias("valid_to")
    )
    return kept.unionByName(closed.select(*kept.columns)).unionByName(still.select(*kept.columns)).unionByName(begun)


def history_of_snapshots(snapshots: list[tuple[object, DataFrame]], keys: list[str], cols: list[str]) -> DataFrame:
    """History of periodic snapshots, each with the time it was taken, in order of time."""
    history = None
    for k, (when, snapshot) in enumerate(snapshots):
        at = F.lit(when).cast("timestamp_ntz")
        if history is None:
            fields = snapshot.select(*keys, *cols).withColumn("valid_from", at).withColumn("valid_to", at)
            history = snapshot.sparkSession.createDataFrame([], fields.schema)
        history = apply_state_snapshot(history, snapshot, keys, cols, at)
        if k < len(snapshots) - 1:
            history = written(history, "history")
    return history
