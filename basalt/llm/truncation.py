"""Texts cut off by field limits or in transfer.

Per source, histograms of the lengths in characters and in bytes are tested for a spike at the
maximum: far more texts in the last few lengths than lengths below it hold. Every text is held against
the spikes of its source; one at such a length that doesn't end as a text does was cut at the limit. Of the rest, cuts in
transfer are told by the end itself: a mark or remnant of the cut, an open code block, table row, object or sentence. Lines of
lists and logs end without a full stop; of these, the words that end lines that go on to
another line are counted over all texts, and a last line that ends in a word that doesn't end lines was cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_with_hot_keys, written

#: Lengths this much below a limit count as at the limit: a cut may go back to the last blank or whole character.
SLACK = 14
#: A spike holds at least this many texts, and this many times what as many lengths below it hold on average.
LEAST, TIMES = 3, 4.0
#: One length of at least this many texts, and this many times the average of the lengths around it, is a limit too.
PEAK, PEAK_TIMES = 5, 12.0
#: A word ends lines if it ends at least this share of the lines in which it appears as a word.
LINE_END_SHARE = 0.02

_BLANK = " \t\r\n\f\v\u00a0\u200b\u200c\u200d\u2060\ufeff\u3000\u2028\u2029\u0085"
_MARK = re.compile(r"(?:[\[(<{]\s*(?:…|\.\.\.|truncated|cut(?: off)?|snip(?:ped)?|continued|(?:\+\s*)?\d+\s*(?:more\s*)?(?:chars?|characters|bytes|words|lines|tokens)\b[^\])>}]*|more)\s*[\])>}]|\ufffd)[.…]*$", re.I)
_REMNANT = re.compile(r"(?:&#?\w{0,6}|\\u[0-9a-f]{0,3}|\\|<\/?\w{0,10}|%[0-9a-f]?)$", re.I)
_DOTS = re.compile(r"(?:…|\.{3,})$")
_TERMINAL = re.compile(r"[.?!。！？](?:[\"'”’»」)\]*_`]|\s?[)])*$")
_SMILE = re.compile(r"[.?!。！？…)\"'`*_]\s*(?::-?[)(DPp]|;-?\)|<3|[^\w\s.,:;/\\|<>{}\[\]()\"'`*_+=#@$%^&~-]+)$")
_SIGN = re.compile(r"^(?:#[\w-]+(?: #[\w-]+)*|[(\[].*[)\]]|(?:--|—|–)\s?\S.*|[Ss]ee \S+\.\w{1,5}|\W+)$")
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+\S")
_LOG = re.compile(r"^\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
#: A list number without its line, a number that may go on behind the point, a path whose ending is missing.
_BROKEN = re.compile(r"(?:^|\s)(?:\d+[.)]|\S*/[^\s./]*\.)$")


def _last_word(line: str) -> str:
    """The word a line ends in; a path or name stands for its kind, if it's whole."""
    words = line.split()
    if not words:
        return ""
    w = words[-1].strip("\"'`*_(),;:")
    if re.fullmatch(r"(?:[\w.-]+/)+[\w-]+\.(?:md|sql|mjs|js|ts|py|rs|go|json|toml|yml)", w):
        return "<path>"
    if re.fullmatch(r"\d+", w):
        return "<number>"
    return w.casefold()


def _is_object(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def ending(text: str) -> tuple[str, str]:
    """How a text ends: 'cut', 'whole', 'dots' (it may be deliberate), 'open' (no full stop, but nothing is open), or 'line' with the last word of a line of a list or log."""
    s = text.rstrip(_BLANK)
    # a mark has no bracket inside, so the last one opens it, however long it is
    if _MARK.search(s, max(0, s.rfind("\ufffd"), *(s.rfind(x) for x in "[(<{"))):
        return "cut", ""
    lines = s.split("\n")
    last = lines[-1].strip(_BLANK)
    head = s.lstrip(_BLANK)[:1]
    if sum(x.lstrip().startswith("```") for x in lines) % 2:
        return "cut", ""
    if last.startswith("```"):
        return "whole", ""
    if last.startswith("|"):
        cells = last.count("|")
        before = lines[-2].strip() if len(lines) > 1 else ""
        return ("whole" if last.endswith("|") and len(last) > 1 and (not before.startswith("|") or before.count("|") == cells) else "cut"), ""
    if last[:1] == "{" and _is_object(last):
        return "whole", ""
    if head in "{[" and (last[:1] in "{[" or len(lines) == 1 or last[:1] in '"]}'):
        return ("whole" if _is_object(last) or _is_object(s) or last in ("}", "]", "},", "],") else "cut"), ""
    if _LOG.match(last):
        if text.endswith("\n"):
            return "whole", ""
        return "line", _last_word(last)
    if re.search(r"(?m)^@@ |^--- a/|^\+\+\+ b/", s) and lines[-1][:1] in "+- @":
        return ("whole" if last.endswith((";", "}")) or last.startswith("@@") and last.endswith("@@") else "cut"), ""
    if re.match(r"#{1,6}(\s|$)", last) or last.endswith(":") or _BROKEN.search(last):
        return "cut", ""
    if _DOTS.search(s):
        return "dots", ""
    if _TERMINAL.search(s):
        return "whole", ""
    if _ITEM.match(lines[-1]):
        return "line", _last_word(last)
    if re.fullmatch(r"\d+[.)]?|[-*•+]", last):
        return "cut", ""
    before = "\n".join(lines[:-1]).rstrip(_BLANK)
    if _SMILE.search(s) or before and _SIGN.match(last) and (_TERMINAL.search(before) or _DOTS.search(before) or not re.search(r"[.?!。！？]", before)):
        return "whole", ""
    if _REMNANT.search(last):
        return "cut", ""
    if re.search(r"[.?!。！？](?:\s|$)|[。！？]", s):
        return "cut", ""
    return ("cut" if len(last.split()) >= 6 and last[:1].isupper() else "open"), ""


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        state, word, size = [], [], []
        for t in batch.column("text").to_pylist():
            a, b = ending(t)
            state.append(a)
            word.append(b)
            size.append(len(t.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), batch.column("chars"), batch.column("hash"), pa.array(size, pa.int64()), pa.array(state, pa.string()), pa.array(word, pa.string())],
            names=["doc_id", "source", "chars", "hash", "bytes", "state", "word"],
        )


def _line_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, ends, uses: in lines of lists and logs that another line follows, how often a word ends the line and how often it is in one."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for t in batch.column("text").to_pylist():
            for line in t.split("\n")[:-1]:
                if _ITEM.match(line) or _LOG.match(line):
                    line = line.rstrip(_BLANK)
                    counts.setdefault(_last_word(line), [0, 0])[0] += 1
                    for w in set(line.casefold().split()):
                        counts.setdefault(w, [0, 0])[1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["word", "ends", "uses"])


def limits(lengths: DataFrame) -> DataFrame:
    """source, unit, least, most, shared: the ranges of lengths at which a source's texts are cut, and whether several texts have the very length most. lengths: source, unit, length and the text's hash, one row per text.

    A text that was delivered many times counts once, else its copies would make a spike.

    At the maximum a spike may spread over SLACK lengths; below it (where a source changed its limit) it has to
    be one length.
    """
    hist = lengths.groupBy("source", "unit", "length").agg(F.count_distinct("hash").alias("n"))
    top = hist.groupBy("source", "unit").agg(F.max("length").alias("most"))
    near = hist.join(top, ["source", "unit"]).groupBy("source", "unit", "most").agg(
        F.sum(F.when(F.col("length") > F.col("most") - SLACK, F.col("n")).otherwise(0)).alias("at"),
        F.sum(F.when(F.col("length") == F.col("most"), F.col("n")).otherwise(0)).alias("last"),
        F.sum(F.when((F.col("length") <= F.col("most") - SLACK) & (F.col("length") > F.col("most") * 0.6 - SLACK), F.col("n")).otherwise(0)).alias("below"),
    )
    expected = F.col("below") * SLACK / F.greatest(F.col("most") * 0.4, F.lit(float(SLACK)))
    ends = near.filter((F.col("at") >= LEAST) & (F.col("at") >= TIMES * expected)).select("source", "unit", (F.col("most") - SLACK + 1).alias("least"), "most", (F.col("last") > 1).alias("shared"))
    around = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-200, 200)
    peaks = hist.withColumn("around", F.sum("n").over(around)).filter((F.col("n") >= PEAK) & (F.col("n") >= PEAK_TIMES * (F.col("around") - F.col("n")) / 400.0))
    return ends.unionByName(peaks.select("source", "unit", F.col("length").alias("least"), F.col("length").alias("most"), F.lit(True).alias("shared")))


def truncated(docs: DataFrame) -> DataFrame:
    """doc_id, source, at_limit, state for the texts that were cut; at_limit tells those whose length lies in a spike of their source.

    docs: doc_id, text, source. Null, empty and blank texts are never cut; texts of a null source have no
    limits but may be cut by their end. Texts are looked at whole. Repeated rows give repeated rows.
    """
    texts = docs.filter(F.col("text").isNotNull() & (F.length(F.trim(F.regexp_replace("text", r"[\s\x{00A0}\x{3000}\x{FEFF}\x{200B}-\x{200D}]+", ""))) > 0))
    texts = texts.select("doc_id", "source", F.length("text").cast("long").alias("chars"), F.xxhash64("text").alias("hash"), "text")
    ends = written(texts.mapInArrow(_endings, "doc_id long, source string, chars long, hash long, bytes long, state string, word string"), "endings")
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    lengths = ends.filter(F.col("source").isNotNull()).select("source", "hash", unit.alias("u")).select("source", "hash", "u.unit", "u.length")
    found = limits(lengths).groupBy("source").agg(F.collect_set(F.struct("unit", "least", "most", "shared")).alias("limits"))
    size = lambda x: F.when(x["unit"] == "chars", F.col("chars")).otherwise(F.col("bytes"))
    spike = lambda test: F.coalesce(F.exists("limits", test), F.lit(False))
    met = join_with_hot_keys(ends.filter("state <> 'whole'"), found, "source", "left")
    met = met.select("doc_id", "source", "state", "word", spike(lambda x: size(x).between(x["least"], x["most"])).alias("at_limit"), spike(lambda x: x["shared"] & (size(x) == x["most"])).alias("right_at"))
    # a whole line may well end near the limit; only one that ends right at it, as others do, needs no look at its last word
    by_limit = (F.col("state") != "line") & F.col("at_limit") | F.col("right_at")
    cols = ["doc_id", "source", "at_limit", "state"]
    sure = met.filter(by_limit | (F.col("state") == "cut"))
    words = texts.select("text").mapInArrow(_line_words, "word string, ends long, uses long").groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("uses").alias("uses"))
    usual = words.filter((F.col("ends") >= 1) & ((F.col("uses") == 0) | (F.col("ends") >= F.col("uses") * LINE_END_SHARE))).select("word", F.lit(True).alias("ends_lines"))
    lines = join_with_hot_keys(met.filter((F.col("state") == "line") & ~by_limit), usual, "word", "left").filter(F.col("ends_lines").isNull())
    return sure.select(*cols).unionByName(lines.select(*cols))
