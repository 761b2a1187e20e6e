"""Near-duplicate records: an exact set-similarity join with token-combination prefixes.

Tokens are the shingles of a record's words. They are ordered from rare to frequent; two
sets as similar as the threshold share tokens within their prefixes (their first tokens in this
order). Tokens fall into classes by frequency. In class 1 (rare) a single token is
an index key; in class 2 and 3 (frequent) only combinations of 2 and 3 tokens are, and a prefix
that reaches into such a class is extended by one or two tokens, which keeps the join exact: of the tokens
that two extended prefixes must share, enough lie in one class to form a common key. So no
key is both frequent and cheap to share, and no list of a frequent token is joined. Triples of a long prefix are many, so the combinations
get smaller as sets get longer; a set near such a border has the keys of both sides, for partners of either.

Frequencies come from a sketch of counters of bounded size: tasks count only the slots of their own tokens, slices are added up apart from each other, and
counts are cut to 16 levels before they are handed to all tasks. An estimate that is too high changes the order, which costs time but loses nothing, because all
records use the same order; where counters fill up, the classes start above what collisions alone add. Equal sets are one class from the start: a record is represented by the digest of its
token set. Where most records are copies, tokens are counted and indexed for one record a class, told by a filter of fixed size. Candidates pass a length filter and a position filter in the join, then a bitmap filter,
and are verified on the whole sets.

The index is shuffled once, as sorted and packed columns for each range of keys, and joined there; its files go before those of the candidates are written.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import tidy_shuffles, written

_WORD = re.compile(r"[^\W_]+")
#: Counters of the frequency sketch, as a power of two: 32 a record within these bounds. A counter is half a byte in a task, 128 MB at most.
SKETCH_BITS = (20, 28)
#: Upper frequency of class 1 and of class 2.
RARE, COMMON = 48, 224
#: Sets up to this size index all their large subsets instead of a prefix.
SMALL = 8
#: Largest sets whose class 3 is indexed by triples, and by pairs; the tokens of classes 2 and 3 of larger sets are keys by themselves.
TRIPLES, PAIRS = 96, 400
#: Bits of a combination's hash that its key leaves out; keys that fall together cost a look at the filters, and short ones less room.
KEY_DROPS = 20
#: Records a partition of the index, and the most partitions.
INDEX_RECORDS, INDEX_PARTITIONS = 12_000, 20_000
#: Bits of the filter of involved records, as a power of two: 8 a record within these bounds, 64 MB at most. A full filter passes all records, which costs time only.
FILTER_BITS = (20, 29)
#: Bits of a key's hash in the index; index rows that a task holds before it packs them, and pairs that it holds before it drops repeated ones.
INDEX_BITS, INDEX_ROWS, PAIR_ROWS = 44, 2_000_000, 1_000_000
#: Where there are so many records a class, only one of a class is counted and indexed; below, a second count would cost more than it saves.
COPIES = 2
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """word -> 64-bit hash, remembered; starts anew when it holds a million words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def token_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """offsets and tokens: for each text the sorted distinct 48-bit hashes of its shingles of that many words."""
    hashes: list[int] = []
    lengths = []
    get = _words.__getitem__
    for t in texts:
        w = _WORD.findall(t.lower())
        hashes += map(get, w)
        lengths.append(len(w))
    flat, n = np.array(hashes, dtype=np.uint64), np.array(lengths)
    if len(flat) < size:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64)
    last = len(flat) - size + 1
    h = np.full(last, _U(size))
    for k in range(size):
        h = _mix(h + flat[k : k + last] * _U(2 * k + 3))
    doc = np.repeat(np.arange(len(texts)), n)
    inside = doc[:last] == doc[size - 1 :]
    # the record's number above 48 bits of hash: one sort orders all sets at once
    key = (doc[:last][inside].astype(np.uint64) << _U(48)) | (h[inside] >> _U(16))
    key = np.unique(key)
    return np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << _U(48)), key & _U((1 << 48) - 1)


def set_digests(offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """64-bit digest of each set; 0 for the empty set."""
    m = _mix(tokens * _U(0x9E3779B97F4A7C15) + _U(1))
    total = np.r_[_U(0), np.cumsum(m, dtype=np.uint64)]
    return _mix(total[offsets[1:]] - total[offsets[:-1]]) | _U(1)


def _bitmaps(offsets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per set 128 bits, each the parity of the tokens that fall on it: two sets that differ in d tokens differ in at most d bits."""
    at = _mix(tokens + _U(77)) & _U(127)
    out = []
    for half in (0, 1):
        bits = np.where((at >> _U(6)) == half, _U(1) << (at & _U(63)), _U(0))
        run = np.r_[_U(0), np.bitwise_xor.accumulate(bits)] if len(bits) else np.zeros(1, np.uint64)
        out.append(run[offsets[1:]] ^ run[offsets[:-1]])
    return out[0], out[1]


def _texts(batch: pa.RecordBatch, cols: list[str]) -> list[str]:
    parts = [batch.column(c).to_pylist() for c in cols]
    return [" ".join(x or "" for x in row) for row in zip(*parts, strict=True)]


def _batches(batches: Iterator[pa.RecordBatch], cols: list[str], size: int):
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            yield batch, *token_sets(_texts(batch, cols), size)


#: Slices of a sketch, merged apart from each other.
_CHUNKS = 512


def _bits(rows: int, each: int, bounds: tuple[int, int]) -> int:
    return min(max((rows * each).bit_length(), bounds[0]), bounds[1])


def _pack(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers of that many bytes, byte by byte, which packs small numbers well."""
    return zstandard.ZstdCompressor(level=3).compress(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _unpack(blob: bytes, width: int = 4) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1)


class _Slots:
    """Counts of the slots met so far; memory follows the slots met, not the sketch."""

    def __init__(self) -> None:
        self.at, self.n, self.new, self.waiting = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

    def add(self, slots: np.ndarray) -> None:
        self.new.append(slots.astype(np.uint32))
        self.waiting += len(slots)
        if self.waiting > 2_000_000:
            self.settle()

    def settle(self) -> None:
        at, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *self.new]), return_counts=True)
        every, where = np.unique(np.concatenate([self.at, at]), return_inverse=True)
        self.at, self.n = every, np.bincount(where, np.concatenate([self.n, n]), len(every)).astype(np.int64)
        self.new, self.waiting = [], 0

    def slices(self, step: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(slice, gaps of its slots, their counts)"""
        self.settle()
        edges = np.searchsorted(self.at, np.arange(0, _CHUNKS + 1, dtype=np.uint64) * _U(step))
        for k in range(_CHUNKS):
            a, b = edges[k], edges[k + 1]
            if a < b:
                yield k, _pack(np.diff(self.at[a:b] - np.uint32(k * step), prepend=np.uint32(0))), _pack(np.minimum(self.n[a:b], (1 << 32) - 1))


def _count(cols: list[str], size: int, bits: int, wanted=None, wanted_bits: int = 0):
    """Slices of the sketch of a task's tokens, and a row of (digest, id, size, bitmap) for each record. wanted: the filter of the records to use, if not all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Slots()
        for batch, offsets, tokens in _batches(_passed(batches, wanted, wanted_bits), cols, size):
            met.add(tokens & _U((1 << bits) - 1))
            b0, b1 = _bitmaps(offsets, tokens)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(set_digests(offsets, tokens).view(np.int64)), pa.array(np.diff(offsets).astype(np.int32)), pa.array(b0.view(np.int64)), pa.array(b1.view(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())],
                names=_COUNT_NAMES,
            )
        made = list(met.slices((1 << bits) // _CHUNKS))
        none, small = pa.nulls(len(made), pa.int64()), pa.nulls(len(made), pa.int32())
        yield pa.RecordBatch.from_arrays([none, none, small, none, none, pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary()), pa.array([x[2] for x in made], pa.binary())], names=_COUNT_NAMES)

    return run


_COUNT_NAMES = ["id", "digest", "n", "b0", "b1", "chunk", "slots", "counts"]
_COUNT_DDL = "id long, digest long, n int, b0 long, b1 long, chunk int, slots binary, counts binary"

#: Levels from which a token is of class 2 and of class 3; level 0 is a token that no other record has.
CLASS_2, CLASS_3 = 10, 13


def _level_bounds(load: float) -> list[int]:
    """Least counts of the levels above 0. load: what an average counter holds, by which counts are too high where counters are shared."""
    x = 2 * int(load)
    rare, common = RARE + x, COMMON + x
    return sorted([2, *(min(k + x, rare) for k in (3, 4, 6, 9, 13, 19, 27, 37)), rare + 1, *(rare + 1 + (common - rare) * k // 3 for k in (1, 2)), common + 1, common * 2 + 1, common * 8 + 1])


def _add_counts(bits: int, load: float):
    """Levels of the summed counts of each slice, two a byte; sorted by slice, so one sum is held at a time."""
    step, bounds = (1 << bits) // _CHUNKS, _level_bounds(load)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)

        def out():
            level = np.searchsorted(bounds, total, side="right").astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zstandard.ZstdCompressor(level=9).compress((level[::2] | level[1::2] << 4).tobytes())], pa.binary())], names=["chunk", "levels"])

        for batch in batches:
            for chunk, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "slots", "counts")), strict=True):
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, total = chunk, np.zeros(step, np.int64)
                total[np.cumsum(_unpack(slots), dtype=np.int64)] += _unpack(counts)
        if now is not None:
            yield out()

    return run


def _combined(head: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all combinations of k of the tokens at these places, and the place of each one's first token."""
    grid = at[:, None] if k == 1 else np.array(list(combinations(at.tolist(), k)))
    if k == 1:
        return (head[at] << _U(2)).astype(np.int64), at
    h = np.full(len(grid), _U(k))
    for j in range(k):
        h = _mix(h + head[grid[:, j]] * _U(2 * j + 3))
    return (h >> _U(KEY_DROPS) << _U(2)).astype(np.int64), grid[:, 0]


def _schemes(n: int, t: float) -> list[tuple[int, int, int]]:
    """(number, k of class 2, k of class 3) of the schemes that a set of n tokens has keys of: that of its own size and those of larger sets that may be like it."""
    own = lambda m: 0 if m <= TRIPLES else 1 if m <= PAIRS else 2
    return [((1, 2, 3), (2, 2, 2), (3, 1, 1))[k] for k in range(own(n), own(math.floor(n / t + 1e-9)) + 1)]


def _key_lists(tokens: np.ndarray, level: np.ndarray, t: float) -> tuple[list[int], list[int]]:
    """Keys and positions of one set, given in the common order. The last two bits of a key tell its scheme; 0 is of all schemes."""
    n = len(tokens)
    keys: list[int] = []  # a set has few keys, for which lists are faster than arrays
    places: list[int] = []

    def put(key: np.ndarray, at: np.ndarray) -> None:
        keys.extend(key.tolist())
        places.extend(at.tolist())

    if n <= SMALL:
        own = [hash((k, *part)) & ((1 << 62) - 4) | (1 << 62) for k in range(math.ceil(t * n - 1e-9), n + 1) for part in combinations(sorted(tokens.tolist()), k)]
        keys, places = own, [0] * len(own)
    base = n - math.ceil(t * n - 1e-9) + 1
    kinds = 1 + (level >= CLASS_2).astype(np.int64) + (level >= CLASS_3)
    longest, pairs_of_2 = base, False
    for scheme, k2, k3 in _schemes(n, t):
        k_of, p = {1: 1, 2: k2, 3: k3}, base
        while (longer := min(n, base + sum(k_of[c] - 1 for c in set(kinds[:p].tolist())))) != p:
            p = longer
        longest, pairs_of_2 = max(longest, p), pairs_of_2 or k2 == 2
        for c in (2, 3):
            at = np.nonzero(kinds[:p] == c)[0]
            if len(at) >= k_of[c] and not (c == 2 and k2 == 2):
                key, first = _combined(tokens, at, k_of[c])
                # a combination's tokens are shared together, so its first token bounds the position; before those of class 3
                # one shared token of class 2 may stand, which has no key of its own where pairs are (one of class 1 has, and so do two of class 2)
                put(key | scheme, first - int(c == 3 and k2 == 2 and bool((kinds == 2).any())))
    single = np.nonzero((kinds[:longest] == 1) & (level[:longest] > 0))[0]
    put((tokens[single] << _U(2)).astype(np.int64), single)
    at = np.nonzero(kinds[:longest] == 2)[0]
    if pairs_of_2 and len(at) > 1:
        put(*_combined(tokens, at, 2))
    return keys, places


def _keys_of(tokens: np.ndarray, level: np.ndarray, t: float) -> list[tuple[int, int]]:
    """_key_lists() as (key, position) pairs."""
    return list(zip(*_key_lists(tokens, level, t), strict=True))


def _index_key(keys: np.ndarray) -> np.ndarray:
    """Keys of the index: 44 bits of hash, spread evenly, over the scheme."""
    keys = keys.view(np.uint64)
    return _mix(keys) >> _U(64 - INDEX_BITS) << _U(2) | keys & _U(3)


def _packed(key: np.ndarray, digest: np.ndarray, place: np.ndarray, partitions: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
    """(range of keys, gaps of the keys, digests, sizes, positions) of index rows."""
    by = np.argsort(key)
    key, digest, place = key[by], digest[by], place[by]
    # multiplied in two steps, for the bits of a key and of a range's number don't fit in 64 together
    part = ((key >> _U(14)) * _U(partitions) >> _U(INDEX_BITS - 12)).astype(np.int64)
    edges = np.r_[0, np.nonzero(np.diff(part))[0] + 1, len(part)] if len(part) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), _pack(np.diff(key[a:b], prepend=_U(0)), 8), digest[a:b].astype("<i8").tobytes(), _pack(place[a:b] >> 16), _pack(place[a:b] & 0xFFFF, 2)


_INDEX_NAMES = ["part", "keys", "digests", "sizes", "places"]
_INDEX_DDL = "part int, keys binary, digests binary, sizes binary, places binary"


def _sign(cols: list[str], size: int, t: float, sketch, bits: int, partitions: int, wanted=None, wanted_bits: int = 0):
    """Packed index rows of each set; a task emits each set once, as long as it remembers having met it. wanted: the filter of the records to use, if not all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zstandard.ZstdDecompressor().decompress(sketch.value), np.uint8)
        met: OrderedDict[int, None] = OrderedDict()
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            made = list(_packed(*(np.concatenate(x) for x in zip(*waiting, strict=True)), partitions))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.binary() if k else pa.int32()) for k in range(5)], names=_INDEX_NAMES)

        for _, offsets, tokens in _batches(_passed(batches, wanted, wanted_bits), cols, size):
            if not len(tokens):
                continue
            digests = set_digests(offsets, tokens).view(np.int64)
            slot = tokens & _U((1 << bits) - 1)
            level = (levels[slot >> _U(1)] >> ((slot & _U(1)) << _U(2)).astype(np.uint8)) & 15
            # order: frequency, then a hash of the token; records stay apart
            doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
            rank = (doc << _U(48)) | (level.astype(np.uint64) << _U(40)) | (_mix(tokens) >> _U(24))
            by = np.argsort(rank)
            tokens, level = tokens[by], level[by].astype(np.int64)
            keys: list[int] = []
            places: list[int] = []
            whose, sizes, counts = [], [], []
            for k in range(len(offsets) - 1):
                a, b = offsets[k], offsets[k + 1]
                d = int(digests[k])
                if a == b or d in met:
                    continue
                met[d] = None
                if len(met) > 1_000_000:
                    met.popitem(last=False)
                mine, at = _key_lists(tokens[a:b], level[a:b], t)
                keys += mine
                places += at
                whose.append(d)
                sizes.append(int(b - a))
                counts.append(len(mine))
            if keys:
                # size and position in one number; a position cut to 16 bits only weakens the filter
                place = (np.repeat(np.array(sizes, np.int64), counts) << 16) | np.clip(np.array(places, np.int64), 0, 0xFFFF)
                waiting.append((_index_key(np.array(keys, np.int64)), np.repeat(np.array(whose, np.int64), counts), place))
                if sum(len(x[0]) for x in waiting) > INDEX_ROWS:
                    yield out()
        if waiting:
            yield out()

    return run


def _alike(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, scheme: np.ndarray, t: float) -> np.ndarray:
    """Pairs that the length filter, the position filter and the scheme of their key let pass."""
    larger = np.maximum(na, nb)
    need = np.ceil(t / (1 + t) * (na + nb) - 1e-9)
    # the larger set of a pair decides whose keys count
    own = np.where(larger <= TRIPLES, 1, np.where(larger <= PAIRS, 2, 3))
    return (np.minimum(na, nb) >= larger * t - 1e-9) & (np.minimum(na - pa_, nb - pb) >= need) & ((scheme == 0) | (scheme == own))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _meet(t: float):
    """(a, b) of the sets that share a key, from packed index rows of one range of keys; a pair may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for keys, digests, sizes, places in zip(*(batch.column(c).to_pylist() for c in _INDEX_NAMES[1:]), strict=True):
                parts.append((np.cumsum(_unpack(keys, 8), dtype=np.uint64), np.frombuffer(digests, "<i8"), _unpack(sizes), _unpack(places, 2)))
        if not parts:
            return
        key, digest, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        by = np.argsort(key)
        key = key[by]
        same = np.r_[False, key[1:] == key[:-1], False]
        shared = same[:-1] | same[1:]  # most keys are of one set only
        key, by = key[shared], by[shared]
        digest, n, place = digest[by], n[by].astype(np.int64), place[by].astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            a, b = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        at, apart = np.arange(len(key)), 0
        while len(at):
            apart += 1
            at = at[at < len(key) - apart]
            at = at[key[at] == key[at + apart]]
            for k in range(0, len(at), PAIR_ROWS):
                i = at[k : k + PAIR_ROWS]
                j = i + apart
                keep = (digest[i] != digest[j]) & _alike(n[i], n[j], place[i], place[j], (key[i] & _U(3)).astype(np.int64), t)
                x, y = digest[i[keep]], digest[j[keep]]
                found.append((np.minimum(x, y), np.maximum(x, y)))
                held += len(x)
                if held > PAIR_ROWS:
                    yield out()
                    held = 0
        if held:
            yield out()

    return run


def _passed(batches: Iterator[pa.RecordBatch], wanted, bits: int) -> Iterator[pa.RecordBatch]:
    """The rows whose id passes the filter; all rows where there is none."""
    if wanted is None:
        yield from batches
        return
    held = np.frombuffer(zstandard.ZstdDecompressor().decompress(wanted.value), np.uint8)
    for whole in batches:
        ids = whole.column("id").to_numpy().view(np.uint64)
        keep = np.ones(len(ids), bool)
        for h in _filter_places(ids, bits):
            keep &= (held[h >> _U(3)] >> (h & _U(7)).astype(np.uint8)) & 1 == 1
        yield whole.filter(pa.array(keep))


def _involved(cols: list[str], size: int, wanted, bits: int):
    """(id, tokens as bytes) of the records whose id passes the filter of involved records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offsets, tokens in _batches(_passed(batches, wanted, bits), cols, size):
            raw = np.frombuffer(tokens.astype("<u8").tobytes(), np.uint8).reshape(-1, 8)[:, :6].tobytes()
            sets = [raw[6 * offsets[k] : 6 * offsets[k + 1]] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "tokens"])

    return run


def _filter_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_mix(ids + _U(seed)) & _U((1 << bits) - 1) for seed in (5, 11)]


def _verify(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, scores = [], []
            for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), strict=True):
                a = {x[k : k + 6] for k in range(0, len(x), 6)}
                b = {y[k : k + 6] for k in range(0, len(y), 6)}
                shared = len(a & b)
                every = len(a) + len(b) - shared
                keep.append(shared >= t * every - 1e-9)
                scores.append(shared / every if every else 0.0)
            yield batch.select(["a", "b"]).append_column("similarity", pa.array(scores, pa.float64())).filter(pa.array(keep, pa.bool_()))

    return run


def _gathered(df: DataFrame, column: str, empty: int) -> bytes:
    """The parts of a sketch of fixed size, together; this much and no more comes to the driver."""
    parts = {r["chunk"]: zstandard.ZstdDecompressor().decompress(r[column]) for r in df.collect()}
    size = max((len(p) for p in parts.values()), default=0)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts.get(k, bytes(size)) for k in range(_CHUNKS)) if size else bytes(empty))


def _filter_of(records: DataFrame, bits: int) -> bytes:
    """Bits of a Bloom filter of the records that any column names; its size doesn't depend on their number."""

    step = (1 << (bits - 3)) // _CHUNKS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Slots()
        for batch in batches:
            for ids in batch.columns:
                for h in _filter_places(ids.to_numpy().view(np.uint64), bits):
                    met.add(h)
        made = list(met.slices(step * 8))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], names=["chunk", "slots"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("chunk").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                at = np.cumsum(_unpack(blob), dtype=np.int64)
                np.bitwise_or.at(now.setdefault(k, np.zeros(step, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(now.keys(), pa.int32()), pa.array([zstandard.ZstdCompressor().compress(x.tobytes()) for x in now.values()], pa.binary())], names=["chunk", "bits"])

    made = records.mapInArrow(build, "chunk int, slots binary")
    return _gathered(made.repartition("chunk").mapInArrow(unite, "chunk int, bits binary"), "bits", 1 << (bits - 3))


def _close(rows: DataFrame, names: list[str], threshold: float, size: int, sketch_bits: int):
    """members, the pairs of classes that pass all filters with a record of each, and the filter of these records with its bits."""
    sc = rows.sparkSession.sparkContext
    n = rows.count()
    bits, filter_bits = _bits(n, 32, (min(SKETCH_BITS[0], max(10, sketch_bits)), max(10, sketch_bits))), _bits(n, 8, FILTER_BITS)
    counted = written(rows.mapInArrow(_count(names, size, bits), _COUNT_DDL), "tokens")
    members = counted.filter("n > 0").select("id", "digest")
    classes = written(counted.filter("n > 0").groupBy("digest").agg(F.min("n").alias("n"), F.min("b0").alias("b0"), F.min("b1").alias("b1"), F.min("id").alias("r")), "classes")
    made, every = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts, used, only = counted, rows, ()
    if members.count() >= COPIES * max(made, 1):
        used, bits, id_bits = rows.filter("id is not null"), _bits(made, 32, (min(SKETCH_BITS[0], max(10, sketch_bits)), max(10, sketch_bits))), _bits(made, 8, FILTER_BITS)
        only = (sc.broadcast(_filter_of(classes.filter("r is not null").select("r"), id_bits)), id_bits)
        parts = used.mapInArrow(_count(names, size, bits, *only), _COUNT_DDL)
    else:
        every = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    load = every / (1 << bits)
    sums = parts.filter("chunk is not null").select("chunk", "slots", "counts").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_add_counts(bits, load), "chunk int, levels binary")
    sketch = sc.broadcast(_gathered(sums, "levels", 1 << (bits - 1)))

    partitions = min(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), made // INDEX_RECORDS), INDEX_PARTITIONS)
    signed = used.mapInArrow(_sign(names, size, threshold, sketch, bits, partitions, *only), _INDEX_DDL).repartitionById(partitions, F.col("part"))
    candidates = written(signed.mapInArrow(_meet(threshold), "a long, b long").repartition("a").distinct(), "candidates")

    side = lambda s: classes.select(F.col("digest").alias(s), F.col("n").alias(f"n{s}"), F.col("b0").alias(f"x{s}"), F.col("b1").alias(f"y{s}"), F.col("r").alias(f"r{s}"))
    apart = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) + F.bit_count(F.col("ya").bitwiseXOR(F.col("yb")))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    close = candidates.join(side("a"), "a").join(side("b"), "b").filter(apart <= F.col("na") + F.col("nb") - 2 * need)
    close = written(close.select("a", "b", "ra", "rb"), "close")

    wanted = sc.broadcast(_filter_of(close.filter("ra is not null and rb is not null").select("ra", "rb"), filter_bits))
    return members, close, wanted, filter_bits


def similar_classes(records: DataFrame, cols: list[str], threshold: float = 0.8, size: int = 5, sketch_bits: int = SKETCH_BITS[1]) -> tuple[DataFrame, DataFrame]:
    """members (id, digest) and links (a, b, similarity): records by class of equal token sets, and the pairs of
    classes, as digests with a < b, whose Jaccard similarity is at least the threshold (over 0.5).

    records: id and the text columns, which are joined by a blank; a null text is empty. Words are the longest runs of letters
    and digits, in lower case. Texts of fewer words than a shingle have no tokens; they are in
    no class and like nothing. Texts are used whole, and each id once. sketch_bits (10 at least) bounds the sketch to 2 ** sketch_bits counters of half a byte.
    """
    rows = records.select("id", *(F.col(c).alias(f"t{k}") for k, c in enumerate(cols)))
    names = [f"t{k}" for k in range(len(cols))]
    with tidy_shuffles(records.sparkSession):
        members, close, wanted, filter_bits = _close(rows, names, threshold, size, sketch_bits)
    tokens = rows.filter("id is not null").mapInArrow(_involved(names, size, wanted, filter_bits), "id long, tokens binary").dropDuplicates(["id"])
    ta, tb = tokens.select(F.col("id").alias("ra"), F.col("tokens").alias("tokens_a")), tokens.select(F.col("id").alias("rb"), F.col("tokens").alias("tokens_b"))
    links = close.join(ta, "ra").join(tb, "rb").mapInArrow(_verify(threshold), "a long, b long, similarity double")
    return members, links


def similar_pairs(records: DataFrame, cols: list[str], threshold: float = 0.8, size: int = 5, sketch_bits: int = SKETCH_BITS[1]) -> DataFrame:
    """id_a, id_b (id_a < id_b): every pair of records whose similarity is at least the threshold, pairs of copies included."""
    members, links = similar_classes(records, cols, threshold, size, sketch_bits)
    members = members.distinct()
    both = links.select("a", "b").unionByName(members.groupBy("digest").agg(F.countDistinct("id").alias("n")).filter("n > 1").select(F.col("digest").alias("a"), F.col("digest").alias("b")))
    x = members.select(F.col("digest").alias("a"), F.col("id").alias("ia"))
    y = members.select(F.col("digest").alias("b"), F.col("id").alias("ib"))
    pairs = both.join(x, "a").join(y, "b").filter((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib")))
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
