"""Names of called functions, resolved to symbols by a cascade of rules from the surest to the weakest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in their order, with how sure each is. Rule 0 has the sureness of the scope table.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.9, 5: 0.95, 6: 0.9, 7: 0.85, 8: 0.8, 9: 0.9, 10: 0.7}
UNRESOLVED = 0.5


def resolve_calls(calls: DataFrame, symbols: DataFrame, bindings: DataFrame, imports: DataFrame, parents: DataFrame, scopes: DataFrame) -> DataFrame:
    """call, rule, symbol, confidence: one row for each call; rule and symbol are null and confidence is 0.5 where nothing fits.

    calls: call, repo, file, callee, receiver, owner (the caller's class), line. symbols: id, repo, file, name, kind, owner, qualified.
    bindings: id, file, local, original, target (file), reexport. imports: file, target, place. parents: repo, name, parent (of classes).
    scopes: file, name, first_line, last_line, depth, symbol, confidence.

    Rules: 0 the innermost scope around the line; 1 the file's binding of the name; 2 and 3 this.name, by the one such symbol or the one of the same file;
    4 super.name; 5 and 6 a bound receiver, as a namespace or a class; 7 receiver.name; 8 the first imported file that has the name; 9 the same
    file; 10 the only symbol of that name. Each rule meets the calls with a table of one row a key, so no list of equal names is ever
    paired; ties go to the least id.
    """
    least = lambda keys, df, name: df.groupBy(*keys).agg(F.min("id").alias(name))
    in_file = least(["file", "name"], symbols, "found")
    only = lambda keys, df: df.groupBy(*keys).agg(F.min("id").alias("found"), F.count(F.lit(1)).alias("n"))
    qualified = only(["repo", "qualified"], symbols)
    first_binding = bindings.filter("NOT reexport AND local IS NOT NULL").groupBy("file", "local").agg(F.min_by(F.struct("original", "target"), "id").alias("b")).select("file", "local", "b.original", "b.target")
    out = []

    def put(rule: int, df: DataFrame, confidence: Column | None = None) -> None:
        out.append(df.select("call", F.struct(F.lit(rule).alias("rule"), F.col("found").alias("symbol"), (F.lit(CONFIDENCE.get(rule)) if confidence is None else confidence).alias("confidence")).alias("hit")))

    def named(df: DataFrame, target: str, name: str, table: DataFrame) -> DataFrame:
        return df.join(table.select(F.col("file").alias(target), F.col("name").alias(name), "found"), [target, name])

    around = calls.join(scopes.withColumnRenamed("name", "callee"), ["file", "callee"]).filter(F.col("line").between(F.col("first_line"), F.col("last_line")))
    around = around.groupBy("call").agg(F.min(F.struct(-F.col("depth"), -F.col("confidence"), "symbol")).alias("m"))
    put(0, around.select("call", F.col("m.symbol").alias("found"), (-F.col("m.col2")).alias("confidence")), F.col("confidence"))

    bound = calls.join(first_binding.withColumnRenamed("local", "callee"), ["file", "callee"])
    wanted = bound.withColumn("wanted", F.when(F.col("original").isin("*", "default"), F.col("callee")).otherwise(F.col("original")))
    put(1, named(wanted, "target", "wanted", in_file))

    def by_path(df: DataFrame, owner: str) -> DataFrame:
        return df.withColumn("qualified", F.concat_ws(".", owner, "callee")).join(qualified, ["repo", "qualified"])

    own = by_path(calls.filter("receiver = 'this' AND owner IS NOT NULL"), "owner")
    put(2, own.filter("n = 1"))
    same = least(["repo", "qualified", "file"], symbols, "near")
    put(3, own.filter("n > 1").drop("found").join(same.withColumnRenamed("near", "found"), ["repo", "qualified", "file"]))
    above = calls.filter("receiver = 'super' AND owner IS NOT NULL").join(parents.select("repo", F.col("name").alias("owner"), "parent"), ["repo", "owner"])
    put(4, by_path(above, "parent").filter("n = 1"))

    other = calls.filter("receiver IS NOT NULL AND receiver NOT IN ('this', 'super')")
    received = other.join(first_binding.withColumnRenamed("local", "receiver"), ["file", "receiver"]).filter("target IS NOT NULL")
    put(5, named(received.filter("original = '*'"), "target", "callee", least(["file", "name"], symbols.filter("kind = 'function'"), "found")))
    classes = named(received.withColumn("class", F.when(F.col("original") == "default", F.col("receiver")).otherwise(F.col("original"))), "target", "class", least(["file", "name"], symbols.filter("kind = 'class'"), "found"))
    methods = least(["repo", "owner", "name"], symbols.filter("owner IS NOT NULL"), "found").select("repo", F.col("owner").alias("class"), F.col("name").alias("callee"), "found")
    put(6, classes.drop("found").join(methods, ["repo", "class", "callee"]))
    put(7, by_path(other, "receiver").filter("n = 1"))

    through = named(calls.select("call", "file", "callee").join(imports, "file"), "target", "callee", in_file)
    put(8, through.groupBy("call").agg(F.min_by("found", F.struct("place", "found")).alias("found")))
    put(9, named(calls, "file", "callee", in_file))
    put(10, calls.join(only(["repo", "name"], symbols).withColumnRenamed("name", "callee"), ["repo", "callee"]).filter("n = 1"))

    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    best = every.groupBy("call").agg(F.min("hit").alias("hit"))
    return calls.select("call").join(best, "call", "left").select("call", "hit.rule", "hit.symbol", F.coalesce("hit.confidence", F.lit(UNRESOLVED)).alias("confidence"))
