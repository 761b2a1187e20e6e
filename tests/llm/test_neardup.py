import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from basalt.llm import neardup as N

WORD = re.compile(r"[^\W_]+")


def shingles(t, n):
    w = WORD.findall(t.lower())
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def brute(texts, t, n):
    s = {i: shingles(x, n) for i, x in texts}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-9}


def corpus(seed, n, words, longest):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = list(r.choice(out))
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 1)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(0, longest))]
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("seed", "words", "longest", "rare", "common"), [(1, 500, 60, 48, 224), (2, 6, 30, 2, 5), (3, 3, 12, 1, 3), (4, 8, 80, 3, 9)])
def test_no_link_is_lost(spark, monkeypatch, seed, words, longest, rare, common):
    monkeypatch.setattr(N, "RARE", rare)
    monkeypatch.setattr(N, "COMMON", common)
    texts = corpus(seed, 150, words, longest)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "id long, content string, n int, digest string").repartition(3)
    for t, n in ((0.6, 3), (0.8, 2)):
        got = [(r.id_a, r.id_b) for r in N.similar_pairs(df, ["content"], t, n).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(texts, t, n)


def test_one_shared_token_of_class_2_before_those_of_class_3(spark):
    often = " ".join(f"often{k}" for k in range(7))
    own = lambda k: "".join(f" own{k}x{j}" for j in range(20))
    texts = [(1, f"a1 a2 shared {often}"), (2, f"b1 b2 shared {often}")]
    texts += [(k, "shared" + own(k)) for k in range(100, 200)] + [(k, often + own(k)) for k in range(200, 500)]
    assert N.RARE < 102 <= N.COMMON < 302
    df = spark.createDataFrame(texts, "id long, content string").repartition(3)
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(df, ["content"], 0.6, 1).collect()} == {(1, 2)}


def test_null_short_and_long_texts(spark):
    long = " ".join(f"x{k}" for k in range(60_000))
    rows = [(1, None, None), (2, "a b", ""), (3, "a", "b"), (4, "One two", "three four"), (5, "one TWO three", "four!"), (6, long, None), (7, long, "end"), (4, "One two", "three four")]
    df = spark.createDataFrame(rows, "id long, title string, content string")
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(df, ["title", "content"], 0.6, 3).collect()} == {(4, 5), (6, 7)}
    assert N.similar_pairs(df.limit(0), ["title", "content"], 0.6, 3).count() == 0


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, 60)).astype(np.uint64) for _ in range(2))
        xs = [N._bitmaps(np.array([0, len(x)]), x) for x in (a, b)]
        bits = sum(int(np.bitwise_xor(p[0], q[0])).bit_count() for p, q in zip(*xs, strict=True))
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize(("triples", "pairs", "rare", "common"), [(6, 14, 2, 4), (10, 12, 1, 2), (0, 9, 1, 3), (0, 0, 2, 4)])
def test_no_link_is_lost_between_sizes(monkeypatch, triples, pairs, rare, common):
    """Common keys of all similar pairs, whose sizes lie on either side of the borders of the schemes, and within the position filter."""
    monkeypatch.setattr(N, "TRIPLES", triples)
    monkeypatch.setattr(N, "PAIRS", pairs)
    r = np.random.default_rng(5)
    level_of = np.minimum(r.integers(0, 16, 60), 15)
    for t in (0.6, 0.8):
        sets = []
        for _ in range(60):
            a = r.choice(60, r.integers(3, 30), replace=False)
            b = np.setdiff1d(a, r.choice(a, r.integers(0, 4)))
            sets += [a, np.union1d(b, r.integers(0, 60, r.integers(0, 5)))]
        signed = []
        for x in sets:
            by = sorted(set(x.tolist()), key=lambda v: (level_of[v], v))
            signed.append((set(by), N._keys_of(np.array(by, np.uint64), level_of[by], t)))
        for k, (a, keys_a) in enumerate(signed):
            for b, keys_b in signed[k + 1 :]:
                if a and b and len(a & b) >= t * len(a | b) - 1e-9 and not (a & b <= {v for v in a & b if level_of[v] == 0}):
                    if any(level_of[v] == 0 for v in a & b):
                        continue  # a token of level 0 is in one set only
                    large = max(len(a), len(b))
                    scheme = 1 if large <= triples else 2 if large <= pairs else 3
                    need = int(np.ceil(t / (1 + t) * (len(a) + len(b)) - 1e-9))
                    mine = {}
                    for key, pos in keys_a:
                        mine.setdefault(key, []).append(pos)
                    assert any(key & 3 in (0, scheme) and min(len(a) - p, len(b) - q) >= need for key, q in keys_b for p in mine.get(key, []))


def test_a_full_sketch_and_long_sets_of_frequent_tokens(spark):
    r = random.Random(9)
    common = [f"c{k}" for k in range(700)]
    rows = [(k, " ".join(common if k < 60 else r.sample(common, 500)) + f" own{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    got = {(x.id_a, x.id_b) for x in N.similar_pairs(df, ["content"], 0.8, 1, sketch_bits=10).collect()}  # some 150 counts a counter
    assert got == brute(rows, 0.8, 1)
    tokens = np.arange(3000, dtype=np.uint64)
    assert len(N._keys_of(tokens, np.full(3000, 15), 0.6)) < 3000


def test_slots():
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 20, 50_000).astype(np.uint64)
    met = N._Slots()
    for k in range(0, len(x), 777):
        met.add(x[k : k + 777])
    back = {}
    for k, slots, counts in met.slices((1 << 20) // N._CHUNKS):
        back |= zip((np.cumsum(N._unpack(slots), dtype=np.int64) + k * ((1 << 20) // N._CHUNKS)).tolist(), N._unpack(counts).tolist(), strict=True)
    at, n = np.unique(x, return_counts=True)
    assert back == dict(zip(at.tolist(), n.tolist(), strict=True))


def test_copies_are_indexed_once_and_shuffles_go_when_they_are_read(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in str(f)}
    base = corpus(6, 40, 300, 40)
    rows = [(i + 100 * k, t) for k in range(5) for i, t in base]
    df = spark.createDataFrame(rows, "id long, content string").repartition(5, "id")
    before = files()
    members, links = N.similar_classes(df, ["content"], 0.6, 3)
    assert not files() - before
    assert members.count() == 5 * sum(bool(shingles(t, 3)) for _, t in base)
    got = [(r.id_a, r.id_b) for r in N.similar_pairs(df, ["content"], 0.6, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, 3)


class Sent:
    def __init__(self, raw):
        self.value = zstandard.ZstdCompressor().compress(raw)


def test_index_is_packed_and_of_wanted_records_only():
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(30)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts + texts[:150] + ["w1 w2 w3"] * 150)], names=["id", "t0"])
    wanted = np.zeros(1 << 17, np.uint8)
    for h in N._filter_places(np.arange(100, dtype=np.uint64), 20):
        np.bitwise_or.at(wanted, h.astype(np.int64) >> 3, (1 << (h & np.uint64(7))).astype(np.uint8))
    digests = N.set_digests(*N.token_sets(texts, 1)).view(np.int64).tolist()
    for only, kept in (((), set(digests)), ((Sent(wanted.tobytes()), 20), set(digests[:100]))):
        made = [x for out in N._sign(["t0"], 1, 0.6, Sent(b"\x55" * 512), 10, 7, *only)(iter([batch])) for x in out.to_pylist()]
        rows = [d for x in made for d in np.frombuffer(x["digests"], "<i8").tolist()]
        assert kept <= set(rows) <= kept | ({N.set_digests(*N.token_sets(["w1 w2 w3"], 1)).view(np.int64).tolist()[0]} if not only else set())
        assert sum(len(v) for x in made for k, v in x.items() if k != "part") < 16 * len(rows)  # a row of three longs takes 32 bytes
        for x in made:
            key = np.cumsum(N._unpack(x["keys"], 8), dtype=np.uint64)
            assert {int(k >> 2) * 7 >> N.INDEX_BITS for k in key.tolist()} == {x["part"]} and (N._unpack(x["sizes"]) >= 3).all()
            assert len(key) == len(N._unpack(x["places"], 2)) == len(x["digests"]) // 8


def test_pairs_of_a_range_come_once_for_each_key_list():
    """All pairs of a key, also where more sets share it than a step holds."""
    n = 50
    key, digest = np.repeat(np.array([4, 9], np.int64), n), np.tile(np.arange(n, dtype=np.int64) - 20, 2)
    made = list(N._packed(N._index_key(key), digest, np.full(2 * n, 8 << 16, np.int64), 1))
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.binary() if k else pa.int32()) for k in range(5)], names=N._INDEX_NAMES)
    got = [(x["a"], x["b"]) for out in N._meet(0.6)(iter([batch])) for x in out.to_pylist()]
    assert sorted(got) == [(a, b) for a in range(-20, 30) for b in range(a + 1, 30)]
