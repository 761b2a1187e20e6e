"""The domain's tables over a data folder, as DataFrames and as SQL.

Memories, prompts, edits, links, symbols and runs are tables of the folder. Recalls, sessions,
commits, calls, imports and code files have none, so their shape is taken from events, lineitem and part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.orphans import integer_key
from .tables import table


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations")


def links(spark: SparkSession, d: str) -> DataFrame:
    """id, memory_id (long), symbol_id (null if unlinked), repo, trust_score, symbol_path."""
    x = table(spark, d, "symbol_links")
    symbol = F.when(F.col("symbol_id") != "__unlinked__", F.col("symbol_id"))
    return x.select("id", integer_key(F.col("memory_id")).alias("memory_id"), symbol.alias("symbol_id"), "repo", "trust_score", "symbol_path")


def recalls(spark: SparkSession, d: str) -> DataFrame:
    """id, memory_id, session_id, was_useful (1, 0 or null), created_at."""
    e = table(spark, d, "events")
    useful = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type").isin("error", "view"), 0)
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 997 + 1).alias("memory_id"), F.col("user_id").alias("session_id"), useful.alias("was_useful"), F.col("ts").alias("created_at"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """id, project, started_at, ended_at (null while open), saved: a user's day."""
    e = table(spark, d, "events")
    g = e.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(
        F.min("ts").alias("started_at"),
        F.when(F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)) == 0, F.max("ts")).alias("ended_at"),
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("saved"),
    )
    return g.select((F.col("user_id") * 1000 + F.col("day")).alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"), "started_at", "ended_at", "saved")


def commits(spark: SparkSession, d: str) -> DataFrame:
    """commit_id, file_id, author_id, committed_at."""
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("author_id"), F.col("l_shipdate").alias("committed_at")).distinct()


def calls(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, confidence: one row per caller and callee."""
    x = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = x.withColumn("dst", F.lead("l_partkey").over(w)).filter((F.col("l_partkey") != F.col("dst")) & (F.col("l_quantity") >= 48))
    return x.groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.max(F.round(1 - 5 * F.col("l_discount"), 2)).alias("confidence"))


def imports(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, kind ('static' or 're-export')."""
    p = table(spark, d, "part")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    p = p.select("p_partkey", "p_size").join(F.broadcast(n))
    a = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("src"), F.expr("(3 * p_partkey + 1) % n").alias("dst"), F.expr("case when p_size % 7 = 0 then 're-export' else 'static' end").alias("kind"))
    b = p.filter("p_size % 3 = 0").select(F.col("p_partkey").alias("src"), F.expr("(p_partkey + p_size) % n").alias("dst"), F.lit("static").alias("kind"))
    return a.unionByName(b)


def files(spark: SparkSession, d: str) -> DataFrame:
    """id, path, cyclomatic, layer."""
    p = table(spark, d, "part")
    test = F.when(F.col("p_size") % 10 == 0, ".test").otherwise("")
    path = F.concat(F.lit("src/"), F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "-"), F.lit("/"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("_"), F.col("p_partkey").cast("string"), test, F.lit(".js"))
    return p.select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_size").alias("cyclomatic"), F.col("p_brand").alias("layer"))


#: The same views as SQL, by name.
SQL = {
    "links": r"""SELECT id, try_cast(nullif(regexp_extract(memory_id, '^[\s\x{00a0}]*([+-]?[0-9]+)[\s\x{00a0}]*$', 1), '') AS BIGINT) AS memory_id,
        CASE WHEN symbol_id <> '__unlinked__' THEN symbol_id END AS symbol_id, repo, trust_score, symbol_path FROM symbol_links""",
    "recalls": """SELECT event_id AS id, event_id % 997 + 1 AS memory_id, user_id AS session_id,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('error', 'view') THEN 0 END AS was_useful, ts AS created_at FROM events""",
    "sessions": """SELECT user_id * 1000 + day(ts) AS id, 'p' || (user_id % 10) AS project, min(ts) AS started_at,
        CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 THEN max(ts) END AS ended_at,
        sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS saved FROM events GROUP BY user_id, day(ts)""",
    "commits": "SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file_id, l_suppkey AS author_id, l_shipdate AS committed_at FROM lineitem",
    "calls": """SELECT src, dst, max(round(1 - 5 * l_discount, 2)) AS confidence FROM
        (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst, l_quantity, l_discount FROM lineitem) x
        WHERE src <> dst AND l_quantity >= 48 GROUP BY src, dst""",
    "imports": """SELECT p_partkey AS src, (3 * p_partkey + 1) % (SELECT count(*) FROM part) AS dst, CASE WHEN p_size % 7 = 0 THEN 're-export' ELSE 'static' END AS kind FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT p_partkey, (p_partkey + p_size) % (SELECT count(*) FROM part), 'static' FROM part WHERE p_size % 3 = 0""",
    "files": """SELECT p_partkey AS id, 'src/' || regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') || '/' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '_' || p_partkey
        || CASE WHEN p_size % 10 = 0 THEN '.test' ELSE '' END || '.js' AS path, p_size AS cyclomatic, p_brand AS layer FROM part""",
}


def sql(body: str, *views: str) -> str:
    """body with the named views before it."""
    if not views:
        return body
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
    rest = body.strip()
    if rest.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {rest[15:]}"
    return f"WITH {head}, {rest[5:]}" if rest.startswith("WITH ") else f"WITH {head} {rest}"
