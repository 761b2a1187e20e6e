"""Graphs of imports, calls and relations: closures, ranks, components, impact.

Edges are (src, dst) and more. Nothing is gathered on the driver but the number of rows of a frontier. Loops
write each round's state to the shared folder, so lineage stays short and lost executors cost
one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hot_keys, join_with_hot_keys, written

DAMPING, ROUNDS = 0.85, 10
#: How far an edge of a kind carries a change, and what a hop costs.
EDGE_DECAY = {"call": 0.7, "import": 0.5, "cochange": 0.3}
HOP = 0.85


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None, until: int | None = None) -> DataFrame:
    """id, depth: the nodes within so many hops along src -> dst (any number, if none is given), each with its least depth; seeds (id) have 0. Cycles and
    self-edges do no harm. It ends early once the node ``until`` is reached.

    What was seen is written anew every few rounds, so a deep graph doesn't leave a table a round to be read again.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    hubs = hot_keys(edges, "src")
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, k = seen, 0
    while depth is None or k < depth:
        k += 1
        reached = join_with_hot_keys(edges, frontier.select(F.col("id").alias("src")), "src", hot=hubs).select(F.col("dst").alias("id")).distinct()
        frontier = written(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % 8 == 0:
            seen = written(seen, "seen")
        if until is not None and not frontier.filter(F.col("id") == until).isEmpty():
            break
    return seen


def path_length(edges: DataFrame, source: int, target: int, most: int | None = None) -> DataFrame:
    """source, target, hops: length of the shortest path; no row if there is none (within ``most`` hops, if given)."""
    spark = edges.sparkSession
    seen = closure(edges, spark.createDataFrame([(source,)], "id long"), most, until=target)
    return seen.filter(F.col("id") == target).select(F.lit(source).cast("long").alias("source"), F.lit(target).cast("long").alias("target"), F.col("depth").alias("hops"))


def page_rank(edges: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """id, rank after a fixed number of rounds from 1/n: .15/n + .85 * the sum over incoming edges of rank / out-degree. Repeated edges count; what reaches a sink is lost.

    Edges are shuffled by source once and stay partitioned; a round joins the ranks to them and sums by target.
    """
    n = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    weighted = written(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("w")), "edges")
    ranks = nodes.join(n).select("id", (1 / F.col("n")).alias("rank"))
    for k in range(rounds):
        got = weighted.join(ranks, weighted["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        ranks = nodes.join(n).join(got, "id", "left").select("id", ((1 - DAMPING) / F.col("n") + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 2 and k < rounds - 1:
            ranks = written(ranks, "ranks")
    return ranks


def components(edges: DataFrame) -> DataFrame:
    """id, component: strongly connected components of two nodes and more, named by their least id.

    Nodes without edges in or out are trimmed first. Then colours (the least hash of an id that reaches a node) and
    backward walks inside a colour from its root split off components, round by round, until no edges are left. Hashes
    stand in for a random order, by which a chain of components halves each round instead of losing one.
    """
    edges = written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    found = None
    while True:
        n = edges.count()
        while n:
            edges = written(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "trimmed")
            before, n = n, edges.count()
            if n == before:
                break
        if not n:
            break
        own = F.xxhash64("id")
        colour = edges.select(F.col("src").alias("id")).distinct().withColumn("colour", own)
        while True:
            along = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
            new = written(colour.join(along, "id", "left").select("id", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("moved")), "colours")
            colour = new.select("id", "colour")
            if new.filter("moved").isEmpty():
                break
        inside = edges.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").filter("a = b").select("src", "dst", F.col("a").alias("colour"))
        member = written(colour.filter(own == F.col("colour")), "roots")
        front, k = member, 0
        while True:
            back = inside.join(front.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            front = written(back.join(member, ["id", "colour"], "left_anti"), "back")
            if front.isEmpty():
                break
            member, k = member.unionByName(front), k + 1
            if k % 8 == 0:
                member = written(member, "members")
        part = written(member, "component")
        found = part if found is None else found.unionByName(part)
        gone = part.select("id")
        edges = written(edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "rest")
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"))
    # a colour may be used again in a later round, but never by two components: its root is gone
    big = found.groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("component")).filter("n > 1").select("colour", "component")
    return found.join(big, "colour").select("id", "component")


def propagate(edges: DataFrame, seeds: DataFrame, depth: int = 5, floor: float = 0.1) -> DataFrame:
    """id, score, depth: how strongly a change of the seeds reaches a node. edges: src, dst, weight, kind.

    A hop scores weight * decay of the kind * .85 ** (hops so far + 1), whatever its source scored; the best score of a node counts, scores
    under the floor stop, and each node is left by the hop in which it was first reached.
    """
    decay = None
    for k, v in EDGE_DECAY.items():
        decay = F.when(F.col("kind") == k, v) if decay is None else decay.when(F.col("kind") == k, v)
    e = edges.select("src", "dst", (F.col("weight") * decay).alias("base"))
    e = written(e.groupBy("src", "dst").agg(F.max("base").alias("base")), "edges")
    hubs = hot_keys(e, "src")
    seen = seeds.select("id").distinct().withColumn("score", F.lit(1.0)).withColumn("depth", F.lit(0))
    frontier = seen
    for k in range(depth):
        hops = join_with_hot_keys(e, frontier.select(F.col("id").alias("src")), "src", hot=hubs)
        hops = hops.select(F.col("dst").alias("id"), (F.col("base") * HOP ** (k + 1)).alias("score")).filter(F.col("score") >= floor).groupBy("id").agg(F.max("score").alias("score"))
        frontier = written(hops.join(seen, "id", "left_anti").withColumn("depth", F.lit(k + 1)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def least_confidence_paths(edges: DataFrame, seeds: DataFrame, depth: int = 8, least: float = 0.5) -> DataFrame:
    """id, depth, confidence: nodes reached over edges of enough confidence, with the least depth and, at that depth, the best of the paths' least confidences."""
    e = written(edges.filter(F.col("confidence") >= least).groupBy("src", "dst").agg(F.max("confidence").alias("c")), "edges")
    hubs = hot_keys(e, "src")
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0)).withColumn("confidence", F.lit(1.0))
    frontier = seen
    for k in range(1, depth + 1):
        hop = join_with_hot_keys(e, frontier.select(F.col("id").alias("src"), "confidence"), "src", hot=hubs)
        reached = hop.groupBy(F.col("dst").alias("id")).agg(F.max(F.least("confidence", "c")).alias("confidence"))
        frontier = written(reached.join(seen, "id", "left_anti").select("id", F.lit(k).alias("depth"), "confidence"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def coupling(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, ca, ce, instability, category: distinct importers, distinct imported files (re-exports don't count), ce / (ca + ce)."""
    ca = imports.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("ca"))
    ce = imports.filter("kind <> 're-export'").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("ce"))
    x = nodes.select("id").join(ca, "id", "left").join(ce, "id", "left").select("id", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    i = F.when(F.col("ca") + F.col("ce") > 0, F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 2)).otherwise(0.0)
    return x.withColumn("instability", i).withColumn("category", F.when(F.col("instability") <= 0.3, "stable").when(F.col("instability") >= 0.7, "unstable").otherwise("balanced"))


def cochange(commits: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """a, b, together, strength: pairs of files changed by one commit, in both directions. Commits of fewer or more distinct files than given are
    not about the files together and are left out, which bounds the pairs of a commit."""
    files = commits.groupBy("commit_id").agg(F.array_sort(F.collect_set("file_id")).alias("f")).filter(F.size("f").between(least, most))
    left = files.select("f", F.posexplode("f").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
    top = F.broadcast(pairs.agg(F.max("together").alias("top")))
    out = pairs.join(top).select("a", "b", "together", F.round(F.col("together") / F.col("top"), 2).alias("strength"))
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "together", "strength"))


def churn(commits: DataFrame, days: int) -> DataFrame:
    """file_id, commits, authors, first_seen, last_seen, per_week within the days before the newest commit."""
    now = F.broadcast(commits.agg(F.max("committed_at").alias("now")))
    x = commits.join(now).filter(F.col("committed_at") >= F.col("now") - F.make_dt_interval(F.lit(days)))
    n = F.count_distinct("commit_id")
    return x.groupBy("file_id").agg(n.alias("commits"), F.count_distinct("author_id").alias("authors"), F.min("committed_at").alias("first_seen"), F.max("committed_at").alias("last_seen"), F.round(n / (days / 7.0), 2).alias("per_week"))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(test|tests|spec|__tests__)(/|$)|[._](test|spec)\.|(^|/)test_[^/]*$")


def level(score: Column, cuts: dict[str, float], below: str) -> Column:
    """Name of the first cut that the score reaches, from the highest."""
    out = None
    for name, least in sorted(cuts.items(), key=lambda x: -x[1]):
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(below)


def newest_per(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def levels(edges: DataFrame) -> DataFrame:
    """id, level: length of the longest path to a node, for the nodes that no cycle reaches (a topological order). Rounds strip nodes whose sources are all placed."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    left = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    done, k = None, 0
    while True:
        ready = left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        ready = written(ready.select("id", F.lit(k).alias("level")), "level")
        if ready.isEmpty():
            break
        done, k = ready if done is None else done.unionByName(ready), k + 1
        left = written(left.join(ready, "id", "left_anti"), "left")
        e = written(e.join(ready.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"), "edges")
    return done if done is not None else left.select("id", F.lit(0).alias("level")).limit(0)


def resolve_aliases(bindings: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """name, target, passes: names followed through re-exports (name -> via) until a name with a target, over so many passes (any number, if none is given); cycles end without one."""
    found = written(targets.select("name", "target").withColumn("passes", F.lit(0)), "resolved")
    open_ = bindings.select("name", "via").join(found, "name", "left_anti")
    step, k = found, 0
    while most is None or k < most:
        k += 1
        # what an earlier pass found has led to its names already
        step = written(open_.join(step.select(F.col("name").alias("via"), "target"), "via").groupBy("name").agg(F.min("target").alias("target")).withColumn("passes", F.lit(k)), "resolved")
        if step.isEmpty():
            break
        found = found.unionByName(step)
        open_ = open_.join(step, "name", "left_anti")
    return found


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; both have one row a key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def class_relations(classes: DataFrame) -> DataFrame:
    """source, target, kind ('extends' or 'implements') of class signatures. classes: id, repo, name, kind, signature.

    A base is met with the first class, interface or type of its name in the repository; names that aren't there give no edge.
    """
    targets = classes.filter(F.col("kind").isin("class", "interface", "type")).groupBy("repo", F.col("name").alias("base")).agg(F.min("id").alias("target"))
    c = classes.filter("kind = 'class' AND signature IS NOT NULL")
    base = c.select("id", "repo", F.regexp_extract("signature", r"extends\s+(\w+)", 1).alias("base"), F.lit("extends").alias("edge"))
    faces = F.split(F.regexp_extract("signature", r"implements\s+([\w,\s]+?)(?:\s*\{|$)", 1), ",")
    face = c.select("id", "repo", F.explode(faces).alias("base"), F.lit("implements").alias("edge")).withColumn("base", F.trim("base"))
    return base.unionByName(face).join(targets, ["repo", "base"]).select(F.col("id").alias("source"), "target", F.col("edge").alias("kind")).distinct()


def is_dependency(kind: Column) -> Column:
    """Edges of all kinds but containment carry a dependency."""
    return kind != "Contains"


def impact_classes(affected: DataFrame) -> DataFrame:
    """affected (change, edge, confidence) with score, class and level: the first rule that fits."""
    c, e = F.col("change"), F.col("edge")
    rules = [
        (c == "Deleted", 1.0, "Breaking"),
        ((c == "SignatureChanged") & e.isin("Imports", "PackageDep"), 0.9, "Breaking"),
        ((c == "BodyOnly") & (e == "PackageDep"), 0.7, "NeedsUpdate"),
        ((c == "BodyOnly") & (e == "Calls"), 0.6, "NeedsUpdate"),
        (c.isin("Moved", "Renamed"), 0.4, "Investigate"),
        (F.col("confidence") < 0.65, 0.5, "Investigate"),
        (F.lit(True), 0.1, "Safe"),
    ]
    hit = F.coalesce(*(F.when(test, F.struct(F.lit(score).alias("score"), F.lit(name).alias("class"))) for test, score, name in rules))
    out = affected.withColumn("__h", hit).withColumn("score", F.col("__h.score")).withColumn("class", F.col("__h.class")).drop("__h")
    return out.withColumn("level", level(F.col("score"), {"Critical": 0.85, "High": 0.6, "Medium": 0.3}, "Low"))


def suggested_edges(answers: DataFrame, body: str, least: float = 0.95) -> DataFrame:
    """id, source, target, edge_type, reasoning, confidence, accepted: the edges of JSON answers {"edges": [...]}, from consumer to exporter.

    An edge without both ends is left out; an unknown type is a contract of an interface; a missing confidence is 0.5. A body that is no such object has none.
    """
    kind = "edges array<struct<entity_a: string, entity_b: string, edge_type: string, reasoning: string, confidence: double>>"
    e = answers.select("id", F.explode(F.from_json(body, kind)["edges"]).alias("e")).select("id", "e.*").filter("entity_a IS NOT NULL AND entity_b IS NOT NULL")
    type_ = F.when(F.col("edge_type").isin("SharedType", "DataFlow", "EventContract"), F.col("edge_type")).otherwise("APIContract")
    sure = F.coalesce("confidence", F.lit(0.5))
    return e.select("id", F.col("entity_b").alias("source"), F.col("entity_a").alias("target"), type_.alias("edge_type"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), sure.alias("confidence"), (sure >= least).alias("accepted"))


#: What may stand behind an imported path, in the order in which it is tried.
IMPORT_ENDINGS = ("", ".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx", "/index.js", "/index.ts", "/index.tsx")


def joined_path(folder: Column, module: Column) -> Column:
    """module as seen from a folder, without dots; one that begins with a slash is seen from the root."""
    parts = F.split(F.when(F.startswith(module, F.lit("/")), module).otherwise(F.concat(folder, F.lit("/"), module)), "/")

    def step(done: Column, p: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(p.isin("", "."), done).when(p == "..", up).otherwise(F.concat(done, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path of the importing file, module, and more) with target: the file that a relative module means, by the first ending that exists; null for packages and what isn't there.

    Each import meets the files by its few candidates; the best is kept by the import's own number, so equal imports don't mix.
    """
    x = imports.withColumn("__n", F.monotonically_increasing_id())
    x = written(x, "imports")  # the numbers have to stay
    near = x.filter(F.startswith("module", F.lit(".")) | F.startswith("module", F.lit("/")))
    at = joined_path(F.regexp_replace("path", "/?[^/]*$", ""), F.col("module"))
    c = near.select("__n", at.alias("at"), F.posexplode(F.array(*map(F.lit, IMPORT_ENDINGS))).alias("place", "ending")).select("__n", "place", F.concat("at", "ending").alias("path"))
    hit = c.join(files.select(F.col("id").alias("target"), "path"), "path").groupBy("__n").agg(F.min_by("target", F.struct("place", "target")).alias("target"))
    return x.join(hit, "__n", "left").drop("__n")
