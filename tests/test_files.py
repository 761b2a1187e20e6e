import random

from basalt.operators import graph as G
from basalt.operators.similar import minhash_pairs
from basalt.sources import files as S


def test_scan_rules(spark, tmp_path):
    for name, data in {
        "src/a.js": b"let a", "src/deep/b.py": b"b = 1", "node_modules/x/i.js": b"x", "src/.env": b"K=1", "package-lock.json": b"{}", "src/m.min.js": b"m", "notes.txt": b"n", "src/big.ts": b"x" * 2000, "src/bin.go": b"a\0b", "src/key.pem": b"k",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = {r.path.split(str(tmp_path))[1]: (r.reason, r.content) for r in S.scan_files(spark, str(tmp_path), most_bytes=1000).collect()}
    want = {"/src/a.js": None, "/src/deep/b.py": None, "/node_modules/x/i.js": "ignored", "/package-lock.json": "lock", "/src/m.min.js": "lock", "/notes.txt": "suffix", "/src/key.pem": "secret", "/src/big.ts": "size", "/src/bin.go": "binary"}
    assert {k: v[0] for k, v in rows.items() if k != "/src/.env"} == want
    assert rows["/src/a.js"][1] == "let a" and rows["/src/big.ts"][1] is None


def test_commit_log(spark):
    df = spark.createDataFrame([("x\nCOMMIT:1\na.js\n\nb.js\na.js\nCOMMIT:2\nCOMMIT:3\n c.js \n",), (None,)], "t string")
    assert {tuple(r) for r in S.commit_files(df, "t").collect()} == {("1", "a.js"), ("1", "b.js"), ("3", "c.js")}


def test_imports(spark):
    code = "import x from './x';\nimport './side.css'\nexport { y } from \"../y\"\nconst z = require('z'), w = require(\"w\");\nawait import('./lazy')\n// nothing"
    got = {tuple(r) for r in S.import_statements(spark.createDataFrame([(1, code), (2, None)], "id long, t string"), "id", "t").collect()}
    assert got == {(1, 1, "import", "./x"), (1, 2, "import", "./side.css"), (1, 3, "re-export", "../y"), (1, 4, "require", "z"), (1, 4, "require", "w"), (1, 5, "dynamic", "./lazy")}


def test_html(spark):
    page = "<style>h1{}</style>hello<h1>Top <b>one</b></h1><p>see <a href='/a'>a</a><h2>Sub</h2>text<script>x</script><a href=b>"
    got = [tuple(r) for r in S.html_sections(spark.createDataFrame([(1, page), (2, None)], "id long, t string"), "id", "t").collect()]
    assert got == [(1, 0, 0, "", "hello", []), (1, 1, 1, "Top one", "see a", ["/a"]), (1, 2, 2, "Sub", "text", ["b"])]


def test_checkers(spark):
    out = "src/a.ts(3,5): error TS2304: Cannot find x.\nsrc/b.py:7:1: E501 too long\nFound 2 errors."
    got = {tuple(r) for r in S.checker_findings(spark.createDataFrame([(1, out), (2, None)], "id long, t string"), "id", "t").collect()}
    assert got == {(1, "src/a.ts", 3, "TS2304", "Cannot find x."), (1, "src/b.py", 7, "E501", "too long")}


def test_minhash_pairs(spark):
    r = random.Random(2)
    words = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(20)]
    base = [[r.choice(words) for _ in range(40)] for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-2] + ["x", "y"]) for b in base[:10]] + [" ".join(base[0])] * 5 + ["short", None]
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        s = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3))
        if s and len(t) >= 40:
            sets.setdefault(s, i)
    ids = list(sets.items())
    want = {(min(a, b), max(a, b)) for k, (s, a) in enumerate(ids) for t, b in ids[k + 1 :] if len(s & t) >= 0.65 * len(s | t)}
    got = {(x.a, x.b) for x in minhash_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "t").collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def test_levels_and_aliases(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (3, 6), (5, 6)], "src long, dst long")
    assert {r.id: r.level for r in G.levels(e).collect()} == {1: 0, 2: 1, 3: 2}
    b = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, via string")
    t = spark.createDataFrame([("c", "file")], "name string, target string")
    assert {tuple(r) for r in G.resolve_aliases(b, t).collect()} == {("c", "file", 0), ("b", "file", 1), ("a", "file", 2)}
