"""Queries of the general training-data operators: p2 (history) and p5 (orphans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import comparison, history_of_edits, history_of_snapshots, merkle_leaves, tree_depth
from ..operators.orphans import dense_numbers, integer_key, orphan_references
from ..session import join_with_hot_keys
from ..sources.tables import table

_TIME = "yyyy-MM-dd HH:mm:ss"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    edits = table(spark, d, "observation_versions")
    # the stored history is of the snapshot that ends with the month before the newest edit
    newest = edits.agg(F.max("created_at").alias("t")).select(F.date_trunc("month", "t").cast("timestamp_ntz").alias("t")).first()["t"]
    cuts = [newest] if newest is not None else []
    found = history_of_edits(edits, ["memory_id", "field"], "old_value", "new_value", "created_at", "id", cuts)
    return found.select(
        "memory_id", "field", F.date_format("valid_from", _TIME).alias("valid_from"), F.coalesce(F.date_format("valid_to", _TIME), F.lit("")).alias("valid_to")
    )


_P2_FOUND = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY memory_id, field ORDER BY created_at, id) AS first_no,
                  row_number() OVER (PARTITION BY memory_id, field, created_at ORDER BY id DESC) AS back_no
           FROM observation_versions WHERE created_at IS NOT NULL),
     f AS (SELECT memory_id, field, coalesce(old_value, '') AS was FROM e WHERE first_no = 1),
     s AS (SELECT e.memory_id, e.field, created_at, coalesce(new_value, '') AS v,
                  lag(coalesce(new_value, '')) OVER (PARTITION BY e.memory_id, e.field ORDER BY created_at) AS prev FROM e WHERE back_no = 1),
     o AS (SELECT s.* FROM s JOIN f ON s.memory_id IS NOT DISTINCT FROM f.memory_id AND s.field IS NOT DISTINCT FROM f.field
           WHERE s.v <> coalesce(s.prev, f.was))
SELECT memory_id, field, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS valid_from,
       coalesce(strftime(lead(created_at) OVER (PARTITION BY memory_id, field ORDER BY created_at), '%Y-%m-%d %H:%M:%S'), '') AS valid_to
FROM o
"""

def p2_tree_report(spark: SparkSession, d: str) -> DataFrame:
    """How much of the edit log the comparison with the snapshot a day, a week and a month before leaves unread."""
    edits = table(spark, d, "observation_versions")
    keys, cols = ["memory_id", "field"], ["old_value", "new_value", "created_at", "id"]
    depth, newest, out = tree_depth(edits, keys), edits.agg(F.max("created_at").alias("t")), None
    leaves = merkle_leaves(edits, keys, cols, depth=depth)
    for days in (1, 7, 30):
        log = edits.join(F.broadcast(newest)).filter(F.col("created_at") <= F.col("t") - F.make_dt_interval(F.lit(days))).drop("t")
        x = comparison(merkle_leaves(log, keys, cols, depth=depth), leaves, depth).select(F.lit(days).alias("days"), F.lit(depth).alias("depth"), "leaves", "differing", "rows", "rows_read", "skipped")
        out = x if out is None else out.unionByName(x)
    return out


_SNAPSHOTS = ("2026-03-01 00:00:00", "2026-06-01 00:00:00", "2026-09-01 00:00:00")


def p2_snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    """Type and project of memories as quarterly snapshots saw them: the newest type by then, without memories deleted by then."""
    o, v = table(spark, d, "observations"), table(spark, d, "observation_versions")
    typed = v.filter(F.col("field") == "type").select("memory_id", "created_at", "id", "new_value")
    shots = []
    for when in _SNAPSHOTS:
        t = F.lit(when).cast("timestamp_ntz")
        live = o.filter((F.col("created_at") < t) & (F.col("deleted_at").isNull() | (F.col("deleted_at") >= t)))
        last = typed.filter(F.col("created_at") < t).groupBy("memory_id").agg(F.max(F.struct("created_at", "id", "new_value")).alias("e"))
        shots.append((when, live.join(last, live["id"] == last["memory_id"], "left").select(live["id"].alias("memory_id"), F.coalesce("e.new_value", "type").alias("type"), "project")))
    h = history_of_snapshots(shots, ["memory_id"], ["type", "project"])
    return h.select("memory_id", "type", "project", F.date_format("valid_from", _TIME).alias("valid_from"), F.coalesce(F.date_format("valid_to", _TIME), F.lit("")).alias("valid_to"))


_P2_SNAPSHOT = f"""
WITH t AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in _SNAPSHOTS)}]) AS taken, unnest([1, 2, 3]) AS k),
     e AS (SELECT t.k, memory_id, arg_max(new_value, (created_at, id)) AS v FROM t JOIN observation_versions ON created_at < t.taken WHERE field = 'type' GROUP BY ALL),
     s AS (SELECT t.k, t.taken, o.id AS memory_id, coalesce(e.v, o.type) AS type, o.project FROM t JOIN observations o
           ON o.created_at < t.taken AND (o.deleted_at IS NULL OR o.deleted_at >= t.taken) LEFT JOIN e ON e.k = t.k AND e.memory_id = o.id),
     b AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND lag(type) OVER w IS NOT DISTINCT FROM type AND lag(project) OVER w IS NOT DISTINCT FROM project THEN 0 ELSE 1 END AS opens
           FROM s WINDOW w AS (PARTITION BY memory_id ORDER BY k)),
     g AS (SELECT *, sum(opens) OVER (PARTITION BY memory_id ORDER BY k) AS run FROM b),
     r AS (SELECT memory_id, run, any_value(type) AS type, any_value(project) AS project, min(taken) AS valid_from, max(k) AS last_k FROM g GROUP BY ALL)
SELECT r.memory_id, r.type, r.project, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(t.taken, '%Y-%m-%d %H:%M:%S'), '') AS valid_to
FROM r LEFT JOIN t ON t.k = r.last_k + 1
"""


def _bad_references(spark: SparkSession, d: str) -> DataFrame:
    links, obs, symbols = table(spark, d, "symbol_links"), table(spark, d, "observations"), table(spark, d, "code_symbols")
    none = F.lit(None).cast("string")
    memory = orphan_references(
        links.select(F.col("id").alias("ref"), integer_key(F.col("memory_id")).alias("key"), none.alias("name"), F.col("last_verified").alias("at")),
        obs.select(F.col("id").alias("key"), none.alias("name"), F.col("deleted_at").isNotNull().alias("gone"), F.col("created_at").alias("since")),
    )
    # symbol ids are no numbers: they are numbered in their order
    named = links.filter(F.col("symbol_id").isNotNull() & (F.col("symbol_id") != "__unlinked__")).select(F.col("id").alias("ref"), F.col("symbol_id").alias("symbol"), F.col("last_verified").alias("at"))
    known = symbols.filter(F.col("stable_symbol_id").isNotNull()).select(F.col("stable_symbol_id").alias("symbol"), "indexed_at")
    numbers = dense_numbers(named.select("symbol").unionByName(known.select("symbol")), "symbol")
    symbol = orphan_references(
        join_with_hot_keys(named, numbers, "symbol").select("ref", "key", none.alias("name"), "at"),
        join_with_hot_keys(known, numbers, "symbol").select("key", none.alias("name"), F.lit(False).alias("gone"), F.col("indexed_at").alias("since")),
    )
    tagged = lambda x, field: x.select(F.col("ref").alias("link_id"), F.lit(field).alias("ref_field"), "reason")
    return tagged(memory, "memory_id").unionByName(tagged(symbol, "symbol_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _bad_references(spark, d)


_P5_FOUND = r"""
SELECT l.id AS link_id, 'memory_id' AS ref_field,
       CASE WHEN o.id IS NULL THEN 'missing' WHEN o.deleted_at IS NOT NULL THEN 'deleted' ELSE 'late' END AS reason
FROM symbol_links l LEFT JOIN observations o
     ON o.id = try_cast(nullif(regexp_extract(l.memory_id, '^[\s\x{00a0}]*([+-]?[0-9]+)[\s\x{00a0}]*$', 1), '') AS BIGINT)
WHERE o.id IS NULL OR o.deleted_at IS NOT NULL OR o.created_at > l.last_verified
UNION ALL
SELECT l.id, 'symbol_id', CASE WHEN s.k IS NULL THEN 'missing' ELSE 'late' END
FROM symbol_links l LEFT JOIN (SELECT stable_symbol_id AS k, min(indexed_at) AS since FROM code_symbols GROUP BY 1) s ON s.k = l.symbol_id
WHERE l.symbol_id IS NOT NULL AND l.symbol_id <> '__unlinked__' AND (s.k IS NULL OR s.since > l.last_verified)
"""


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referenced table, reason and month of last_verified."""
    bad = _bad_references(spark, d)
    month = F.date_format("last_verified", "yyyy-MM")
    links = table(spark, d, "symbol_links").select(F.col("id").alias("link_id"), month.alias("month"))
    to = F.when(F.col("ref_field") == "memory_id", "observations").otherwise("code_symbols")
    return bad.join(links, "link_id").groupBy(to.alias("ref_table"), "reason", "month").agg(F.count(F.lit(1)).alias("orphans"))


_P5_REPORT = f"""
SELECT CASE WHEN ref_field = 'memory_id' THEN 'observations' ELSE 'code_symbols' END AS ref_table, reason, strftime(l.last_verified, '%Y-%m') AS month, count(*) AS orphans
FROM ({_P5_FOUND}) b JOIN symbol_links l ON l.id = b.link_id GROUP BY ALL
"""

QUERIES = {"p2_found": p2_found, "p2_tree_report": p2_tree_report, "p2_snapshot_history": p2_snapshot_history, "p5_found": p5_found, "p5_report": p5_report}
SQL = {"p2_found": _P2_FOUND, "p2_snapshot_history": _P2_SNAPSHOT, "p5_found": _P5_FOUND, "p5_report": _P5_REPORT}
