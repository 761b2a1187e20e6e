import random

from basalt.operators import graph as G
from basalt.session import hot_keys, join_with_hot_keys


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def random_pairs(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def depths(pairs, seed, most):
    seen, front = {seed: 0}, {seed}
    for k in range(1, most + 1):
        front = {b for a, b in pairs if a in front} - seen.keys()
        seen.update(dict.fromkeys(front, k))
    return seen


def test_closure_with_cycles_and_self_edges(spark):
    pairs = [*random_pairs(40, 70, 1), (3, 3), (1, 2), (2, 1)]
    seeds = spark.createDataFrame([(1,), (1,)], "id long")
    got = {r.id: r.depth for r in G.closure(edges(spark, pairs), seeds, 4).collect()}
    assert got == depths(pairs, 1, 4)


def test_closure_of_nothing(spark):
    none = edges(spark, [])
    assert G.closure(none, spark.createDataFrame([(1,)], "id long"), 3).count() == 1
    assert G.closure(none, spark.createDataFrame([], "id long"), 3).count() == 0


def test_components(spark):
    pairs = random_pairs(30, 45, 5)
    reach = {a: set(depths(pairs, a, 40)) for a in range(30)}
    want = {}
    for a in range(30):
        mine = {b for b in reach[a] if a in reach[b]}
        if len(mine) > 1:
            want[a] = min(mine)
    assert {r.id: r.component for r in G.components(edges(spark, pairs)).collect()} == want
    assert G.components(edges(spark, [(1, 2), (2, 3)])).count() == 0


def test_page_rank(spark):
    pairs = random_pairs(12, 30, 2)
    n, rank = 12, dict.fromkeys(range(12), 1 / 12)
    out = {a: sum(x == a for x, _ in pairs) for a in range(n)}
    for _ in range(10):
        rank = {v: 0.15 / n + 0.85 * sum(rank[a] / out[a] for a, b in pairs if b == v) for v in range(n)}
    got = {r.id: r["rank"] for r in G.page_rank(edges(spark, pairs), spark.range(n)).collect()}
    assert all(abs(got[v] - rank[v]) < 1e-12 for v in rank)


def test_hop_scores_do_not_multiply(spark):
    e = spark.createDataFrame([(1, 2, 1.0, "call"), (2, 3, 1.0, "call"), (3, 4, 0.1, "call")], "src long, dst long, weight double, kind string")
    got = {r.id: round(r.score, 6) for r in G.propagate(e, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: 1.0, 2: round(0.7 * 0.85, 6), 3: round(0.7 * 0.85**2, 6)}


def test_commits_of_one_or_many_files_make_no_pairs(spark):
    rows = [(1, 1), (2, 1), (2, 2), (2, 2), *((3, k) for k in range(51)), *((4, k) for k in range(1, 3))]
    got = {(r.a, r.b): (r.together, r.strength) for r in G.cochange(spark.createDataFrame(rows, "commit_id long, file_id long")).collect()}
    assert got == {(1, 2): (2, 1.0), (2, 1): (2, 1.0)}


def test_test_paths(spark):
    paths = ["a/test/b.js", "a/b.test.js", "test_a.py", "a/contest/b.js", "a/latest.js", "__tests__/x.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.filter(G.is_test_path(df["path"])).collect()] == ["a/test/b.js", "a/b.test.js", "test_a.py", "__tests__/x.ts"]


def test_hot_keys_join(spark):
    left = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(30000)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(k, k * 2) for k in range(0, 30000, 2)] + [(1, 5)], "k long, w long")
    assert hot_keys(left, "k") == [1]
    for how in ("inner", "left"):
        assert sorted(map(tuple, join_with_hot_keys(left, right, "k", how).collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


def test_long_chains_are_followed_to_their_end(spark):
    rings = [(3 * k + a, 3 * k + b) for k in range(24) for a, b in ((0, 1), (1, 2), (2, 0))] + [(3 * k + 2, 3 * k + 3) for k in range(23)]
    assert {r.id: r.component for r in G.components(edges(spark, rings)).collect()} == {v: v // 3 * 3 for v in range(72)}


def test_deep_walks_have_no_bound(spark):
    chain = edges(spark, [(k, k + 1) for k in range(20)])
    assert {r.id: r.depth for r in G.closure(chain, spark.createDataFrame([(0,)], "id long")).collect()} == {k: k for k in range(21)}
    assert G.path_length(chain, 12, 16).first().hops == 4 and G.path_length(chain, 16, 12).count() == 0
    assert {r.id: r.level for r in G.levels(chain.filter("src < 9")).collect()} == {k: k for k in range(10)}
    names = spark.createDataFrame([(k, k + 1) for k in range(13)] + [(30, 31), (31, 30)], "name long, via long")
    got = {r.name: r.passes for r in G.resolve_aliases(names, spark.createDataFrame([(13, 7)], "name long, target long")).collect()}
    assert got == {13 - k: k for k in range(14)}


def test_import_targets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a/b", "./c"), ("a/b", "../../../x/y"), ("", "./c/.."), ("a", "/r//s")], "folder string, module string")
    assert [r[0] for r in df.select(G.joined_path(F.col("folder"), F.col("module"))).collect()] == ["a/b/c", "x/y", "", "r/s"]
    files = spark.createDataFrame([(1, "a/b.ts"), (2, "a/b.js"), (3, "a/c/index.ts"), (4, "d.tsx")], "id long, path string")
    asked = spark.createDataFrame([("a/x.js", "./b"), ("a/x.js", "./b.ts"), ("a/x.js", "./c"), ("a/x.js", "../d"), ("a/x.js", "b"), ("x.js", "/a/b"), ("a/x.js", "./none"), ("a/x.js", "./b")], "path string, module string")
    assert sorted((r.module, r.target or 0) for r in G.import_targets(asked, files).collect()) == sorted([("./b", 2), ("./b.ts", 1), ("./c", 3), ("../d", 4), ("b", 0), ("/a/b", 2), ("./none", 0), ("./b", 2)])
