"""Percentiles of large columns with a proven rank error, by collapsing equal-size buffers.

A sketch holds sorted buffers of K values; each value of a buffer of level L stands for 2 ** L
rows. When two buffers have one level, they are merged and every second value is kept:
a buffer of the next level. The first value kept alternates between the first and
the second position, by the parity of the collapses so far. Such a collapse moves the rank of
any value by at most 2 ** L, so the sum of these is a bound on the rank error of
the sketch; it is carried along, adds up when sketches merge, and needs no assumption about
the order or spread of the values. For n rows it is at most n * log2(n / K) / (2 * K).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values in a buffer.
K = 1024
#: Values that a task holds in all its sketches before it passes them on (32 MB).
HELD = 4_000_000

SKETCH = "n long, error long, collapses long, lowest double, highest double, rest array<double>, levels array<int>, buffers array<double>"


class Sketch:
    """rest: values not yet in a buffer; buffers: level -> sorted buffer of K values (one a level)."""

    def __init__(self, k: int = K) -> None:
        self.k, self.n, self.error, self.collapses = k, 0, 0, 0
        self.low, self.high = np.inf, -np.inf
        self.rest: list[np.ndarray] = []
        self.loose = 0
        self.buffers: dict[int, np.ndarray] = {}

    def held(self) -> int:
        return self.loose + self.k * len(self.buffers)

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        self._take(values)

    def _take(self, values: np.ndarray) -> None:
        self.rest.append(values)
        self.loose += len(values)
        if self.loose >= self.k:
            every = np.concatenate(self.rest)
            full = len(every) - len(every) % self.k
            for at in range(0, full, self.k):
                self._place(0, np.sort(every[at : at + self.k]))
            self.rest, self.loose = [every[full:]], len(every) - full

    def _place(self, level: int, buffer: np.ndarray) -> None:
        while level in self.buffers:
            both = np.sort(np.concatenate([self.buffers.pop(level), buffer]), kind="stable")
            buffer = both[self.collapses % 2 :: 2]
            self.error += 1 << level
            self.collapses += 1
            level += 1
        self.buffers[level] = buffer

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.error += other.error
        self.collapses += other.collapses
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for level in sorted(other.buffers):
            self._place(level, other.buffers[level])
        for r in other.rest:
            if len(r):
                self._take(r)

    def percentiles(self, ps: list[float]) -> list[float | None]:
        """Values whose rank lies within error of ceil(p * n); the lowest and highest are exact."""
        if not self.n:
            return [None] * len(ps)
        parts = [(r, np.ones(len(r))) for r in self.rest] + [(b, np.full(len(b), float(1 << lv))) for lv, b in self.buffers.items()]
        values, weights = np.concatenate([a for a, _ in parts]), np.concatenate([w for _, w in parts])
        by = np.argsort(values, kind="stable")
        values, ranks = values[by], np.cumsum(weights[by])
        out = []
        for p in ps:
            want = max(1.0, np.ceil(p * self.n))
            out.append(float(self.low if want <= 1 else self.high if want >= self.n else values[min(np.searchsorted(ranks, want), len(values) - 1)]))
        return out

    def row(self) -> tuple:
        levels = sorted(self.buffers)
        rest = np.concatenate(self.rest) if self.rest else np.zeros(0)
        return (self.n, self.error, self.collapses, float(self.low), float(self.high), rest, levels, np.concatenate([self.buffers[x] for x in levels]) if levels else np.zeros(0))

    @classmethod
    def of_row(cls, r: dict, k: int = K) -> Sketch:
        s = cls(k)
        s.n, s.error, s.collapses, s.low, s.high = r["n"], r["error"], r["collapses"], r["lowest"], r["highest"]
        s._rest_of(np.asarray(r["rest"], float))
        flat = np.asarray(r["buffers"], float)
        s.buffers = {lv: flat[i * k : (i + 1) * k] for i, lv in enumerate(r["levels"])}
        return s

    def _rest_of(self, rest: np.ndarray) -> None:
        self.rest, self.loose = [rest], len(rest)


def _emit(keys: list[str], schema: pa.Schema, made: list[tuple[tuple, Sketch]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(made), 2000):
        part = made[at : at + 2000]
        rows = [(*key, *s.row()) for key, s in part]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow_schema(df: DataFrame, keys: list[str]) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    head = df.select(*keys).schema
    ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keys).dtypes), SKETCH])
    probe = df.sparkSession.createDataFrame([], ddl).schema
    assert [f.name for f in head] == probe.names[: len(keys)]
    return ddl, to_arrow_schema(probe)


def sketches(df: DataFrame, keys: list[str], metrics: list[str], k: int = K) -> DataFrame:
    """keys, metric and one mergeable sketch of each metric's values per group.

    Nulls and NaN are ignored; a group without values has no row; a null key is a group. Each task keeps the
    sketches of the groups it meets, so rows of a hot group shrink before the shuffle, and passes them on
    whenever they hold HELD values. The sketches of a group merge in two rounds, the first on a
    part of them each.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    flat = df.select(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True)), *(F.col(m).cast("double").alias(f"__m{i}") for i, m in enumerate(metrics)))
    keyed = flat.withColumn("metric", F.lit(""))
    ddl, schema = _arrow_schema(keyed, [*names, "metric"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        since = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = pa.Table.from_batches([batch.select(names)]) if names else None
            code = np.zeros(batch.num_rows, np.int64)
            for n in names:
                enc = batch.column(n).dictionary_encode(null_encoding="encode")
                code = code * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
            by = np.argsort(code, kind="stable")
            starts = np.nonzero(np.r_[True, np.diff(code[by]) != 0])[0]
            ends = np.r_[starts[1:], len(by)]
            firsts = groups.take(pa.array(by[starts])).to_pylist() if names else [{}]
            for i, m in enumerate(metrics):
                values = batch.column(f"__m{i}").to_numpy(zero_copy_only=False)[by]
                for g, (a, b) in zip(firsts, zip(starts, ends, strict=True), strict=True):
                    part = values[a:b]
                    part = part[~np.isnan(part)]
                    if len(part):
                        held.setdefault((*(g[n] for n in names), m), Sketch(k)).add(part)
            since += batch.num_rows * len(metrics)
            if since > HELD:
                if sum(s.held() for s in held.values()) > HELD:
                    yield from _emit(names, schema, list(held.items()))
                    held = {}
                since = 0
        yield from _emit(names, schema, list(held.items()))

    made = keyed.drop("metric").mapInArrow(build, ddl)
    merged = merge_sketches(made, [*names, "metric"], k, rounds=2)
    return merged.select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), "metric", *[c for c in merged.columns if c not in (*names, "metric")])


def merge_sketches(df: DataFrame, keys: list[str], k: int = K, rounds: int = 1) -> DataFrame:
    """One sketch per group of sketches. Sorted sketches stream through, so no group is held but its merged sketch."""
    ddl, schema = _arrow_schema(df, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        now: Sketch | None = None
        done: list[tuple[tuple, Sketch]] = []
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[c] for c in keys)
                if now is None or key != last:
                    if now is not None:
                        done.append((last, now))
                    last, now = key, Sketch.of_row(r, k)
                else:
                    now.merge(Sketch.of_row(r, k))
            if len(done) > 500:
                yield from _emit(keys, schema, done)
                done = []
        if now is not None:
            done.append((last, now))
        yield from _emit(keys, schema, done)

    cols = [f.name for f in schema]
    out = df.select(*cols)
    if rounds > 1:
        out = out.withColumn("__part", F.pmod(F.xxhash64("n", "lowest", "highest", "error"), F.lit(16))).repartition(*keys, "__part")
        out = out.sortWithinPartitions(*keys, "n", "error", "lowest", "highest").select(*cols).mapInArrow(run, ddl)
    return out.repartition(*keys).sortWithinPartitions(*keys, "n", "error", "lowest", "highest").mapInArrow(run, ddl)


def percentiles(sketched: DataFrame, keys: list[str], ps: list[float], k: int = K) -> DataFrame:
    """keys, percentile, value, n, rank_error: the largest share of the rows by which a value's rank may be off."""
    ddl = ", ".join([*(f"`{n}` {t}" for n, t in sketched.select(*keys).dtypes), "percentile double, value double, n long, rank_error double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s = Sketch.of_row(r, k)
                out += [(*(r[c] for c in keys), p, v, s.n, s.error / s.n) for p, v in zip(ps, s.percentiles(ps), strict=True)]
            types = [batch.schema.field(c).type for c in keys] + [pa.float64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=[*keys, "percentile", "value", "n", "rank_error"])

    return sketched.mapInArrow(run, ddl)
