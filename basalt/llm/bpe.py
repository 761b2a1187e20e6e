"""Byte-pair encoding of whole texts by speculating and verifying.

A word's tokens are first guessed by greedy longest match. The guess is the true encoding
if and only if each adjacent pair is compatible, that is, if encoding the two
tokens' bytes together gives the same two tokens. All pairs of a batch are
tested at once on arrays; words with a failing pair go through the exact merges.
Words repeat, so each worker keeps the encodings of those it has met.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import BYTE_PATTERN, byte_ranks, tokenizer_dir

#: Words that a worker remembers, and the longest of them; beyond that number the memory starts anew.
CACHE_WORDS, CACHE_CHARS = 400_000, 200


class ByteBPE:
    def __init__(self, path: str, pattern: str = BYTE_PATTERN) -> None:
        self.ranks = byte_ranks(path)
        self.words = regex.compile(pattern).findall
        self.longest = max(map(len, self.ranks))
        self.size = max(self.ranks.values()) + 1
        self.known: dict[str, list[int]] = {}
        self.known_chunks: dict[str, bytes] = {}
        self.exact_words = 0
        self._tables()

    def _tables(self) -> None:
        """left, right: the two tokens that merge into a token (itself, if a single byte); pairs: sorted codes of pairs that merge, with the token they make."""
        self.order = np.zeros(self.size, np.int64)  # when a token is made; single bytes first
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        codes, made = [], []
        for token, rank in self.ranks.items():
            self.order[rank] = 0 if len(token) == 1 else rank + 1
            if len(token) > 1:
                parts = self._merge(token, below=rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    codes.append(a * self.size + b)
                    made.append(rank)
        by = np.argsort(codes)
        self.codes, self.made = np.asarray(codes, np.int64)[by], np.asarray(made, np.int64)[by]

    def _merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merges: while any adjacent parts make a token (of rank under below), join the leftmost pair of the lowest rank."""
        parts = [word[k : k + 1] for k in range(len(word))]
        get = self.ranks.get
        if len(parts) > 200:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = get(parts[k] + parts[k + 1])
                if r is not None and (below is None or r < below) and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same merges with a heap, for words of any length."""
        import heapq

        get, n = self.ranks.get, len(parts)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, parts[k] + parts[k + 1]) for k in range(n - 1) if (r := get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, joined = heapq.heappop(heap)
            j = nxt[k] if alive[k] else n
            if j >= n or parts[k] + parts[j] != joined:
                continue
            parts[k], alive[j], nxt[k] = joined, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = k
            for a, b in ((prv[k], k), (k, nxt[k])):
                if a >= 0 and b < n and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [self.ranks[parts[k]] for k in range(n) if alive[k]]

    def _guess(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        out, at, n, get = [], 0, len(word), self.ranks.get
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                r = get(word[at:end])
                if r is not None:
                    out.append(r)
                    at = end
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays as it is when its bytes are encoded together.

        A merge across the border would happen between a suffix part of a and a prefix part of b, before
        either is joined further. The parts along the border are undone from the latest merge to the earliest;
        a pair of parts that merges earlier than the merge just undone refutes the pair.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            code = x * self.size + y
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = (self.codes[at] == code) & (self.order[self.made[at]] < limit[live])
            good[live[hit]] = False
            ox, oy = self.order[x], self.order[y]
            done = hit | ((ox == 0) & (oy == 0))
            # of two equal tokens the left one would have been made first, so the right one is undone first
            undo_left = ox > oy
            go = ~done
            lx, ly = live[go & undo_left], live[go & ~undo_left]
            limit[lx] = self.order[a[lx]]
            a[lx] = self.right[a[lx]]
            limit[ly] = self.order[b[ly]] + 1
            b[ly] = self.left[b[ly]]
            live = live[go]
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words not met before and remember them."""
        guesses = [self._guess(w.encode()) for w in words]
        many = [k for k, g in enumerate(guesses) if len(g) > 1]
        if many:
            flat = np.concatenate([np.asarray(guesses[k]) for k in many])
            ends = np.cumsum([len(guesses[k]) for k in many])
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            left = np.nonzero(inside)[0]
            good = self.compatible(flat[left], flat[left + 1])
            owner = np.searchsorted(ends, left, side="right")
            for k in np.unique(owner[~good]):
                guesses[many[k]] = self._merge(words[many[k]].encode())
                self.exact_words += 1
        self.known.update(zip(words, guesses, strict=True))

    @staticmethod
    def chunks(text: str) -> list[str]:
        """text cut before blanks that follow a visible character, where a word always ends.

        Words never reach over such a place, and chunks repeat more than a pattern search costs.
        """
        out, now = [], []
        for p in text.split(" "):
            if now and now[-1] and not now[-1][-1].isspace():
                out.append(" ".join(now))
                now = [""]
            now.append(p)
        return [*out, " ".join(now)]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """offsets and ids of all texts; a null or empty text has none."""
        if len(self.known) + len(self.known_chunks) > CACHE_WORDS:
            self.known.clear()
            self.known_chunks.clear()
        cut = [self.chunks(t) if t else [] for t in texts]
        chunks = self.known_chunks
        new = {c for cs in cut for c in cs} - chunks.keys()
        if new:
            split = {c: self.words(c) for c in new}
            words = {w for ws in split.values() for w in ws} - self.known.keys()
            if words:
                self.learn(list(words))
            known = self.known
            for c, ws in split.items():
                chunks[c] = np.asarray([i for w in ws for i in known[w]], np.int32).tobytes()
        ids = [b"".join([chunks[c] for c in cs]) for cs in cut]
        for c in new:
            if len(c) > CACHE_CHARS:  # text without a break is no word that repeats
                for w in split[c]:
                    if len(w) > CACHE_CHARS:
                        self.known.pop(w, None)
                del chunks[c]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
        return offsets, np.frombuffer(b"".join(ids), np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def _sliced(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about that many bytes of text, at least one row each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def encode(df: DataFrame, text: str, keep: list[str], path: str | None = None, as_count: bool = False) -> DataFrame:
    """keep columns and ids (list of int), or n_tokens if as_count, of each row's text, without special tokens.

    A null or empty text has an empty list (0). Strings of special tokens inside a text are ordinary text.
    Texts are encoded whole, however long. Rows never meet, so nothing is shuffled.
    """
    path = path or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*keep).dtypes) + (", n_tokens bigint" if as_count else ", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for batch in _sliced(whole, "__text"):
                offsets, ids = bpe.encode_batch(batch.column("__text").to_pylist())
                if as_count:
                    made = pa.array(np.diff(offsets), pa.int64())
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), made], names=[*keep, "n_tokens" if as_count else "ids"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
