"""Records that say the same in another form: one fingerprint whatever the format.

A text is cut into named fields (labels at the start of a line or part, on lines or on one line) and the text outside them. Several readings of a text
are kept: by the labels that are known, by all names that stand where a label may, and, of an object in JSON, by its parsed members. A value runs to the next label; as the text behind
the last value may be its own or stand apart, each line it may end with is a reading of its own. Of each name and value only letters and digits
count, without case. The hashes of the (name, value) pairs are added up, so the order of
fields doesn't matter and nothing is sorted; equal sums are one group. A copy whose labels
lost their marks can't be cut into fields; it is led to its group by the hash
of the whole text. Groups are then verified pair by pair on the texts themselves. A text, group or holder that many records share is joined apart from the others.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import hot_keys, join_with_hot_keys, written

#: Names of labelled fields (fixed values of the data).
LABELS = frozenset("what why where learned next impact task file symbol ticket limit".split())
#: A label stands at the start of a line, or one of these, or a dash between blanks, comes before it.
_BEFORE = frozenset("{|·;,.?!…\"”)}]:")
_DASH = re.compile(r"\s[-–—‑]\s")
_SIGN = re.compile("[:=]")
_CLOSING = frozenset("*_\"'`)] \t\n\r\f\v\u00a0")
_ESCAPE = re.compile(r"\\(u[0-9a-f]{4}|.)", re.I)
_DROP = re.compile(r"[\W_]+")
_M = (1 << 128) - 1


def plain(text: str | None) -> str:
    """Letters and digits only, without case; composed and decomposed letters are the same."""
    if not text:
        return ""
    return _DROP.sub("", unicodedata.normalize("NFC", text).casefold())


def _unescape(value: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        return chr(int(x[1:], 16)) if len(x) == 5 else " " if x in "nrtbfNRTBF" else x

    return re.sub("[\ud800-\udfff]", "", _ESCAPE.sub(one, value)) if "\\" in value else value


def _marks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of all names that stand where a label may, each with the colon or equals sign behind it."""
    out = []
    for m in _SIGN.finditer(text):
        end = m.start()
        while end and text[end - 1] in _CLOSING:
            end -= 1
        at = end
        while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at -= 1
        while at < end and text[at] == "_":
            at += 1
        if at == end or not text[at].isalpha() or out and at < out[-1][1]:
            continue
        k = at
        while k and not (text[k - 1].isalnum() or text[k - 1] in "\n\r"):
            k -= 1
        if k == 0 or text[k - 1] in "\n\r" or any(c in _BEFORE for c in text[k:at]) or _DASH.search(text, k, at):
            out.append((at, m.end(), text[at:end].casefold()))
    return out


def _members(text: str) -> list[tuple[str, str]] | None:
    """(name, value) of the members of an object in JSON, as they would stand in other layouts; None if the text is none."""
    if not text.startswith("{"):
        return None
    try:
        pairs = json.loads(text, object_pairs_hook=lambda x: x, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return None

    def said(x) -> str:
        if isinstance(x, (list, tuple)):
            return "".join(map(said, x))
        return plain(x) if isinstance(x, str) else {True: "true", False: "false", None: "null"}[x]

    return [(k.casefold(), said(v)) for k, v in pairs]


_Parts = tuple[str, list[tuple[str, str]], str, list[tuple[str, str]]]


def _parts(text: str | None, marks: list[tuple[int, int, str]] | None = None) -> _Parts:
    """The text before the fields; (name, value) of all fields but the last; the last one's name, and each of its lines as value and as text.

    A value runs to the next label, over line breaks too. Where the last one ends only its lines can tell. All but names are plain. Without marks those of LABELS are taken.
    """
    text = text or ""
    marks = [m for m in _marks(text) if m[2] in LABELS] if marks is None else marks
    if not marks:
        return plain(text), [], "", []
    named: list[tuple[str, str]] = []
    for (start, end, name), after in zip(marks, [*marks[1:], None], strict=True):
        quoted = text[start - 1 : start] in ('"', "“")
        piece = text[end : after[0] if after else len(text)]
        if after:
            named.append((name, plain(_unescape(piece) if quoted else piece)))
    lines = [(plain(_unescape(x) if quoted else x), plain(x)) for x in piece.split("\n")]
    return plain(text[: marks[0][0]]), named, name, [x for x in lines if any(x)]


def _all_parts(text: str | None) -> list[_Parts]:
    """The readings by known labels, by all names, and as JSON; the first is that by known labels."""
    text = text or ""
    every = _marks(text)
    known = [m for m in every if m[2] in LABELS]
    out = [_parts(text, known)]
    if len(every) > len(known):
        out.append(_parts(text, every))
    if members := _members(text.strip()):
        out.append(("", members, "", []))
    return out


def _cuts(lines: list[tuple[str, str]]) -> range:
    """Numbers of lines that the last field may have; the rest is text behind the fields."""
    first = next((k for k, x in enumerate(lines) if x[0]), -1) + 1
    return range(first, max(first, len(lines)) + 1)


def _reading(parts: tuple, cut: int) -> list[tuple[str, str]]:
    before, named, name, lines = parts
    out = [*named, (name, "".join(x[0] for x in lines[:cut]))] if name else [*named]
    rest = before + "".join(x[1] for x in lines[cut:])
    return [*out, ("", rest)] if rest else out


def fields(text: str | None) -> list[tuple[str, str]]:
    """(name, value) pairs in their order, both plain; the text outside of fields has the empty name. The last value ends with its line."""
    parts = _parts(text)
    return _reading(parts, _cuts(parts[3])[0])


def readings(text: str | None) -> list[list[tuple[str, str]]]:
    """All readings of a text, each for each line that its last value may end with."""
    return [_reading(parts, cut) for parts in _all_parts(text) for cut in _cuts(parts[3])]


def _hash(x: str, seed: int = 0) -> int:
    return xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass"), seed)


def _reading_hashes(parts: tuple, column: int) -> list[int]:
    """The commutative hash of each reading, by the order of _cuts; the lines are hashed once, however many readings there are."""
    before, named, name, lines = parts
    utf8 = lambda x: x.encode("utf-8", "surrogatepass")
    fixed = _hash(str(column)) + sum(_hash(f"{column}\0{n}\0{v}", 7) for n, v in named)
    cuts = _cuts(lines)
    value, rest = xxhash.xxh3_128(utf8(f"{column}\0{name}\0"), 7), xxhash.xxh3_128(utf8(f"{column}\0\0"), 7)
    values, rests = {}, {}
    for k in range(len(lines) + 1):
        if k in cuts:
            values[k] = value.intdigest() if name else 0
        if k < len(lines):
            value.update(utf8(lines[k][0]))
    # the text outside is hashed backwards, from its end to the cut and then what stands before the fields
    some, back = False, utf8(before[::-1])
    for k in range(len(lines), -1, -1):
        if k in cuts:
            outside = rest.copy()
            outside.update(back)
            rests[k] = outside.intdigest() if some or before else 0
        if k:
            rest.update(utf8(lines[k - 1][1][::-1]))
            some = some or bool(lines[k - 1][1])
    return [(fixed + values[k] + rests[k]) & _M for k in cuts]


def _all_fingerprints(texts: list[str | None]) -> tuple[int, list[int], bool]:
    """fingerprints(), with the hashes of all readings of the columns together; the first is that of fields()."""
    parts = [_all_parts(t) for t in texts]
    whole = sum(_hash(plain(t), k + 1) for k, t in enumerate(texts)) & _M
    named = [0]
    for k, p in enumerate(parts):
        hashes = dict.fromkeys(h for one in p for h in _reading_hashes(one, k))
        named = [(x + h) & _M for x in named for h in hashes]
    return whole, list(dict.fromkeys(named)), not any(p[0][2] for p in parts)


def fingerprints(texts: list[str | None]) -> tuple[int, int, bool]:
    """Of a record's text columns: the hash of their plain texts, the commutative hash of their fields, and whether it has no labels."""
    whole, named, bare = _all_fingerprints(texts)
    return whole, named[0], bare


_KEYS = "whole_hi long, whole_lo long, field_hi long, field_lo long, bare boolean"


def _signed(x: int) -> tuple[int, int]:
    hi, lo = x >> 64, x & ((1 << 64) - 1)
    return hi - (1 << 64) if hi >> 63 else hi, lo - (1 << 64) if lo >> 63 else lo


def _fingerprint_rows(n: int):
    """A row for each reading of a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(f"t{k}").to_pylist() for k in range(n)]
            whose, made = [], []
            for row, t in enumerate(zip(*cols, strict=True)):
                whole, named, bare = _all_fingerprints(list(t))
                whose += [row] * len(named)
                made += [(*_signed(whole), *_signed(f), bare) for f in named]
            at = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("part").take(at), batch.column("id").take(at), *(pa.array([x[i] for x in made], pa.int64()) for i in range(4)), pa.array([x[4] for x in made], pa.bool_())],
                names=["part", "id", "whole_hi", "whole_lo", "field_hi", "field_lo", "bare"],
            )

    return run


def _differing(n: int):
    """Pairs whose texts aren't the same after all: neither their plain texts nor the fields of any reading agree."""

    def read_alike(x: str | None, y: str | None) -> bool:
        by_hash = lambda text: {h: (p, cut) for p in _all_parts(text) for h, cut in zip(_reading_hashes(p, 0), _cuts(p[3]), strict=True)}
        p, q = by_hash(x), by_hash(y)
        return any(h in q and Counter(_reading(*p[h])) == Counter(_reading(*q[h])) for h in p)

    def same(a: list, b: list) -> bool:
        return all(plain(x) == plain(y) for x, y in zip(a, b, strict=True)) or all(read_alike(x, y) for x, y in zip(a, b, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = list(zip(*(batch.column(f"t{k}").to_pylist() for k in range(n)), strict=True))
            right = list(zip(*(batch.column(f"u{k}").to_pylist() for k in range(n)), strict=True))
            keep = pa.array([not same(a, b) for a, b in zip(left, right, strict=True)], pa.bool_())
            yield batch.select(["part", "id"]).filter(keep)

    return run


_WHOLE, _FIELD = ["part", "whole_hi", "whole_lo"], ["part", "field_hi", "field_lo"]


def _grouped(keys: DataFrame, whole: list[str], field: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups of records that are joined by equal whole or field keys, however many records stand between them.

    keys: part, id and both keys, any number of rows a record. First (part, id, first_id) of the records
    of groups of several, then (part, id, other) pairs: records with one of the same whole key, and one for each other whole key of a field key.
    """
    edges = written(keys.groupBy(*whole, *field[1:]).agg(F.min("id").alias("low")), "edges")
    shared = edges.groupBy(*field).agg(F.min("low").alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    links = written(edges.join(shared, field).withColumn("label", F.col("low")), "links")
    now = links.select(*whole, *field[1:], "label")
    while True:  # the smallest label goes from texts to fields and back until none changes
        over = now.groupBy(*field).agg(F.min("label").alias("least"))
        least = now.join(over, field).groupBy(*whole).agg(F.min("least").alias("least"))
        now = written(now.join(least, whole).select(*whole, *field[1:], F.col("least").alias("label"), (F.col("least") < F.col("label")).alias("moved")), "labels")
        if now.filter("moved").isEmpty():
            break
    labels = now.select(*whole, "label").distinct()
    texts = edges.groupBy(*whole).agg(F.min("low").alias("holder")).join(labels, whole, "left").withColumn("label", F.coalesce("label", "holder"))
    hot = hot_keys(keys, whole[1])
    members = written(join_with_hot_keys(keys.select(*whole, "id").distinct(), texts, whole[1], hot=hot, also=[c for c in whole if c != whole[1]]).select("part", "id", "holder", "label"), "members")
    groups = members.groupBy("part", "label").agg(F.min("id").alias("first_id"), F.max("id").alias("last")).filter("first_id < last").drop("last")
    copies = written(join_with_hot_keys(members, groups, "label", also=["part"]).select("part", "id", "holder", "first_id"), "copies")
    pairs = copies.filter("id <> holder").select("part", "id", F.col("holder").alias("other"))
    pairs = pairs.unionByName(links.filter("low <> other").select("part", F.col("low").alias("id"), "other")).distinct()
    return copies.select("part", "id", "first_id"), written(pairs, "pairs")


def format_copies(records: DataFrame, texts: list[str]) -> DataFrame:
    """part, id, first_id: every record that has a copy, with the smallest id of its group (itself for that one).

    records: part (records of different parts are no copies), id (unique within the part), and the text columns. A
    null text is an empty one; records without any letter or digit are copies of each other. Repeated rows of
    one id count once. Whole texts are compared. A group holds all records that a chain of copies joins: texts alike
    as a whole may be cut into different fields, and each of those leads to further copies.
    """
    n = len(texts)
    rows = records.select("part", "id", *(F.col(c).alias(f"t{k}") for k, c in enumerate(texts)))
    keys = written(rows.mapInArrow(_fingerprint_rows(n), f"part string, id long, {_KEYS}"), "formats")
    copies, pairs = _grouped(keys, _WHOLE, _FIELD)
    other = rows.select(F.col("part"), F.col("id").alias("other"), *(F.col(f"t{k}").alias(f"u{k}") for k in range(n)))
    checked = join_with_hot_keys(pairs, other, "other", also=["part"]).join(rows, ["part", "id"])
    wrong = written(checked.mapInArrow(_differing(n), "part string, id long"), "wrong")
    if wrong.isEmpty():
        return copies
    return _regrouped(copies, wrong, rows, n)


def _regrouped(copies: DataFrame, wrong: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """After a collision of hashes: members of groups with a wrong member are grouped again by their texts and fields as text."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, whole, form = [], [], []
            for row, c in enumerate(zip(*(batch.column(f"t{k}").to_pylist() for k in range(n)), strict=True)):
                forms = ["\1".join("\2".join(sorted(f"{a}\0{b}" for a, b in x)) for x in r) for r in product(*map(readings, c))]
                whose += [row] * len(forms)
                whole += ["\1".join(map(plain, c))] * len(forms)
                form += forms
            at = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("part").take(at), batch.column("id").take(at), pa.array(whole, pa.string()), pa.array(form, pa.string())], names=["part", "id", "whole", "form"])

    bad = copies.join(wrong, ["part", "id"], "left_semi").select("part", "first_id").distinct()
    sound = copies.join(bad, ["part", "first_id"], "left_anti").select("part", "id", "first_id")
    again = copies.join(bad, ["part", "first_id"], "left_semi").select("part", "id").distinct()
    forms = written(rows.join(again, ["part", "id"], "left_semi").mapInArrow(exact, "part string, id long, whole string, form string"), "forms")
    return sound.unionByName(_grouped(forms, ["part", "whole"], ["part", "form"])[0])
