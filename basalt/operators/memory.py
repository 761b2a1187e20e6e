"""Memories: ranked search, similarity, hygiene, trust."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# Weights, boosts and priorities that define the results.
FTS_WEIGHT, RECENCY_WEIGHT, TRUST_WEIGHT, RECALL_WEIGHT = 0.4, 0.3, 0.15, 0.15
DEFAULT_TRUST, RECALL_LOG, USEFULNESS = 0.7, 0.2, 0.15
RECENCY_DAYS = 7
TYPE_BOOST = {"decision": 1.3, "architecture": 1.3, "bugfix": 1.2, "pattern": 1.2, "preference": 1.2, "config": 1.1, "session_summary": 0.7, "skill": 0.5}
TYPE_PRIORITY = {"decision": 3, "architecture": 3, "bugfix": 2, "pattern": 2, "preference": 2, "config": 1, "discovery": 1, "learning": 1}
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
STOP_WORDS = frozenset(
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from as into through during before after above "
    "below between out off over under again further then once and but or nor not so yet both either neither each every all any few more most other some such no only own same than too very just because if when where "
    "how what which who whom this that these those it its name also known keep answer concise mention explain file lives implemented".split()
)


def case_of(column: Column, table: dict, other: object) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(other))


def live(now: Column) -> Column:
    """Neither deleted nor expired at the given time."""
    return F.col("deleted_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def in_scope(project: str) -> Column:
    """Of the project, whatever its case, or personal."""
    return (F.lower("project") == project.lower()) | (F.col("scope") == "personal")


def with_now(df: DataFrame, at: DataFrame, column: str = "created_at") -> DataFrame:
    """df with the column now: the newest time in ``at``, so a result depends on the data only. One row is broadcast."""
    return df.join(F.broadcast(at.agg(F.max(column).alias("now"))))


def query_terms(query: str, most: int = 5) -> list[str]:
    """Terms of a query in its order: three letters or digits at least, no stop words, each once."""
    plain = "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower())
    return list(dict.fromkeys(w for w in plain.split() if len(w) > 2 and w not in STOP_WORDS))[:most]


def _spaced(text: Column) -> tuple[Column, Column]:
    """The text's words (runs of a-z and 0-9, in lower case), each between two blanks of its own, and their number. One pattern pass; all counting is plain replacing."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "  "))
    size = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit("  "), F.lit(" "))) + 1)
    return F.concat(F.lit(" "), words, F.lit(" ")), size


def _occurrences(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def term_counts(docs: DataFrame, terms: list[str], text: Column) -> DataFrame:
    """docs with size (words) and tf (for each term its count); words are runs of a-z and 0-9 in lower case."""
    words, size = _spaced(text)
    return docs.withColumn("size", size).withColumn("tf", F.array(*(_occurrences(words, f" {t} ") for t in terms)))


def bm25(counted: DataFrame, n_terms: int) -> DataFrame:
    """counted (size, tf) with matched (terms found) and relevance (positive; idf is floored). Statistics cover all rows given."""
    stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("size").alias("__avg"), *(F.count_if(F.col("tf")[i] > 0).alias(f"__df{i}") for i in range(n_terms)))
    x = counted.join(F.broadcast(stats))
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(n_terms):
        idf = F.greatest(F.log((F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5)), F.lit(IDF_FLOOR))
        tf = F.col("tf")[i]
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("size") / F.col("__avg")))
        matched = matched + F.when(tf > 0, 1).otherwise(0)
    return x.withColumn("relevance", score).withColumn("matched", matched).drop("__n", "__avg", *(f"__df{i}" for i in range(n_terms)))


def signals(obs: DataFrame, links: DataFrame, recalls: DataFrame) -> DataFrame:
    """obs with trust (null if unlinked), recall_count and useful_count. Logs are aggregated before they are joined."""
    trust = links.filter(F.col("memory_id").isNotNull()).groupBy("memory_id").agg(F.max("trust_score").alias("trust"))
    recall = recalls.groupBy("memory_id").agg(F.count(F.lit(1)).alias("recall_count"), F.count_if(F.col("was_useful") == 1).alias("useful_count"))
    out = obs.join(trust, obs["id"] == trust["memory_id"], "left").drop("memory_id").join(recall, obs["id"] == recall["memory_id"], "left").drop("memory_id")
    return out.withColumn("recall_count", F.coalesce("recall_count", F.lit(0))).withColumn("useful_count", F.coalesce("useful_count", F.lit(0)))


def composite_score(relevance: Column, now: Column) -> Column:
    """Blend of relevance, recency, trust and recall, times the boost of the type. A missing time counts as new."""
    age = F.when(F.col("created_at").isNull(), 0.0).otherwise((F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 86400.0)
    useful = F.when(F.col("recall_count") > 0, F.col("useful_count") / F.col("recall_count")).otherwise(0.5)
    recall = F.log1p("recall_count") * RECALL_LOG * useful + useful * USEFULNESS
    blend = relevance * FTS_WEIGHT + F.exp(-age / RECENCY_DAYS) * RECENCY_WEIGHT + F.coalesce("trust", F.lit(DEFAULT_TRUST)) * TRUST_WEIGHT + recall * RECALL_WEIGHT
    return blend * case_of(F.col("type"), TYPE_BOOST, 1.0)


def ranked_search(obs: DataFrame, links: DataFrame, recalls: DataFrame, query: str, project: str, limit: int = 10) -> DataFrame:
    """id, title, tier, score: the best live memories in scope.

    Tier 1 are those with all terms, tier 2 those with any, tier 3 those that contain a term inside a word; only the
    lowest tier that isn't empty is returned. At most three times the limit (50 at most) by relevance are scored. The tiers come from one
    pass, so no tier waits for another's emptiness. A query without terms finds nothing.
    """
    terms = query_terms(query)
    if not terms:
        return obs.limit(0).select("id", "title", F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    text = F.concat_ws(" ", "title", "content")
    inside = F.greatest(*(F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0))
    # statistics, the best tier and the best rows read the counts of this narrow table, not the texts
    here = term_counts(with_now(obs, obs), terms, text).withColumn("wanted", live(F.col("now")) & in_scope(project)).withColumn("inside", inside)
    scored = bm25(written(here.select("id", "title", "type", "created_at", "now", "size", "tf", "inside", F.coalesce("wanted", F.lit(False)).alias("wanted")), "counts"), len(terms))
    tier = F.when(F.col("matched") == len(terms), 1).when(F.col("matched") > 0, 2).when(F.col("inside") == 1, 3)
    found = scored.filter("wanted").withColumn("tier", tier).filter(F.col("tier").isNotNull())
    best = F.broadcast(found.agg(F.min("tier").alias("__best")))
    rank = F.when(F.col("tier") < 3, F.col("relevance")).otherwise(F.unix_timestamp("created_at").cast("double"))
    top = found.join(best, F.col("tier") == F.col("__best")).withColumn("__rank", rank).orderBy(F.desc("__rank"), "id").limit(min(3 * limit, 50))
    relevance = F.when(F.col("tier") < 3, F.col("relevance")).otherwise(0.0)
    out = signals(top, links, recalls).withColumn("score", F.round(composite_score(relevance, F.col("now")), 6))
    return out.orderBy(F.desc("score"), "id").limit(limit).select("id", "title", "tier", "score")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the text's letters and digits (ASCII, lower case)."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    at = F.sequence(F.lit(1), F.greatest(F.length(plain) - 2, F.lit(1)))
    return F.when(F.length(plain) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.substr(plain, i, F.lit(3)))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over the larger set's; 0 where neither has any."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def duplicate_titles(obs: DataFrame, threshold: float = 0.6, candidates: int = 20) -> DataFrame:
    """id, other_id, similarity: each live memory's titles alike among the newest earlier ones of its project and type.

    The candidates are the ``candidates`` rows before it in (created_at, id); a window frame, so no pairs are joined. Titles without trigrams are alike if they are the same but for case and blanks around.
    """
    whole = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    x = obs.filter(F.col("deleted_at").isNull() & F.col("project").isNotNull()).select("id", "project", "type", "created_at", trigrams(F.coalesce("title", F.lit(""))).alias("g"), whole.alias("t"))
    x = x.withColumn("t", F.when(F.size("g") == 0, F.col("t")))
    w = Window.partitionBy("project", "type").orderBy("created_at", "id").rowsBetween(-candidates, -1)
    pairs = x.withColumn("before", F.collect_list(F.struct("id", "g", "t")).over(w)).withColumn("c", F.explode("before")).drop("before")
    sim = F.when(F.col("t").isNotNull() & F.col("c.t").isNotNull(), (F.col("t") == F.col("c.t")).cast("double")).otherwise(F.round(trigram_similarity(F.col("g"), F.col("c.g")), 2))
    return pairs.withColumn("similarity", sim).filter(F.col("similarity") >= threshold).select("id", F.col("c.id").alias("other_id"), "similarity")


def pack_newest(rows: DataFrame, group: str, budget: int, batch: int = 256) -> DataFrame:
    """pack_budget() over all rows of a group from the newest to the oldest, however many there are. rows: group, id, created_at, title, content.

    A round offers the newest of the rows whose title still fits into what is left, a bounded number a group, and takes up where the
    round before ended; rows whose title doesn't fit never will, so they needn't be offered. The newest of a large group are
    first found in parts of it. pos counts the rows offered. Null groups are left out; rows without a time are the oldest.
    """
    at = F.struct(F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))).alias("t"), F.col("id"))
    rows = rows.filter(F.col(group).isNotNull()).select(group, "id", "title", "content", at.alias("__at"))
    state = written(rows.select(group).distinct().select(group, F.lit(budget).alias("left"), F.lit(True).alias("first"), F.lit(None).cast(rows.schema["__at"].dataType).alias("seen")), "state")
    out, base = None, 0
    while not state.isEmpty():
        # groups are few against rows: one row each
        open_ = rows.join(state, group).filter((F.col("seen").isNull() | (F.col("__at") < F.col("seen"))) & (F.col("first") | (F.ceil(F.coalesce(F.length("title"), F.lit(0)) * 2 / 7) <= F.col("left"))))
        part = Window.partitionBy(group, F.pmod(F.col("id"), F.lit(64))).orderBy(F.desc("__at"))
        few = open_.withColumn("pos", F.row_number().over(part)).filter(F.col("pos") <= batch)
        few = few.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__at")))).filter(F.col("pos") <= batch)
        offered = written(few, "offered")
        packed = written(pack_budget(offered, group, budget), "packed")
        done = packed.withColumn("pos", F.col("pos") + base)
        out, base = done if out is None else out.unionByName(done), base + batch
        used = packed.groupBy(group).agg(F.sum("tokens").alias("used"))
        ends = offered.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("seen"), F.min("left").alias("left")).filter(F.col("n") == batch)
        state = written(ends.join(used, group, "left").select(group, F.greatest(F.col("left") - F.coalesce("used", F.lit(0)), F.lit(0)).cast("int").alias("left"), F.lit(False).alias("first"), "seen"), "state")
    return out if out is not None else pack_budget(rows.withColumn("pos", F.lit(1)), group, budget)


def keep_newest(df: DataFrame, group: str, at: str, keep: int, tie: str = "id") -> DataFrame:
    """df without all but the newest rows of each group."""
    w = Window.partitionBy(group).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= keep).drop("__rn")


def ttl_until(text: Column, now: Column) -> Column:
    """End of a time to live such as 12h, 7d, 2w or 1m (30 days); null if it is none."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^([0-9]{1,6})\s*[hdwm]$", 1)
    hours = case_of(F.substring(t, -1, 1), {"h": 1, "d": 24, "w": 168, "m": 720}, None)
    count = F.when(n != "", n.cast("int"))
    return F.when(count > 0, now + F.make_dt_interval(F.lit(0), count * hours, F.lit(0), F.lit(0)))


def slug(text: Column) -> Column:
    """Topic key of a text; 'untitled' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s)


def evaluate_trust(links: DataFrame, changed_paths: DataFrame, changed_symbols: DataFrame) -> DataFrame:
    """id, new_trust, reason: links after a change of the source. A link with a path falls by 0.3 if its path changed; one without if its symbol did;
    all others rise by 0.05 while below 0.95. Scores stay within 0 and 1."""
    p = changed_paths.select(F.col("path").alias("symbol_path"), F.lit(True).alias("__p")).distinct()
    s = changed_symbols.select("symbol_id", F.lit(True).alias("__s")).distinct()
    x = links.join(p, "symbol_path", "left").join(s, "symbol_id", "left")
    hit = F.when(F.col("symbol_path").isNotNull(), F.col("__p")).otherwise(F.col("__s"))
    reason = F.when(hit, "changed").when(F.col("trust_score") < 0.95, "survived").otherwise("kept")
    delta = case_of(reason, {"changed": -0.3, "survived": 0.05}, 0.0)
    rise = F.when(reason == "survived", F.least(F.col("trust_score") + 0.05, F.lit(0.95))).otherwise(F.col("trust_score") + delta)
    return x.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rise)), 4).alias("new_trust"), reason.alias("reason"))


def pack_budget(ranked: DataFrame, group: str, budget: int) -> DataFrame:
    """Rows of a group that fit into a token budget, greedily in order of ``pos``: whole (full), else their first 100 characters
    (cut), else the title only (head); the first row always fits. group, pos, id, and text columns title and content are needed.
    Where ranked has the columns left and first, they are what a group has left of its budget, and whether its first row is still to come.

    The choice for a row depends on all choices before it, which a window sum can't say; sorted rows stream through instead.
    """
    schema = ", ".join([f"`{group}` {dict(ranked.dtypes)[group]}", "pos int, id long, mode string, tokens int"])

    def tokens(n: int) -> int:
        return -(-n * 2 // 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = object(), 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r[group] != now:
                    now, left, first = r[group], r.get("left", budget), r.get("first", True)
                title, body = len(r["title"] or ""), len(r["content"] or "")
                for mode, n in (("full", tokens(title + body)), ("cut", tokens(title + min(body, 100))), ("head", tokens(title))):
                    if n <= left or first and mode == "full":
                        out.append((r[group], r["pos"], r["id"], mode, n))
                        left, first = max(0, left - n), False
                        break
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            types = [batch.schema.field(group).type, pa.int32(), pa.int64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[group, "pos", "id", "mode", "tokens"])

    more = [c for c in ("left", "first") if c in ranked.columns]
    return ranked.select(group, "pos", "id", "title", "content", *more).repartition(group).sortWithinPartitions(group, "pos").mapInArrow(run, schema)


# Words that no needle of a topic is made of, and how much a compaction keeps.
TOPIC_STOP_WORDS = frozenset(
    "the and for with that this from what where when why how did does into instead keep answer concise you your are was were can could should would will "
    "have has had not but all any our its they them then than there here which who about also just please need want some more very been these those only each other".split()
)
SUMMARIES_KEPT, PROMPTS_KEPT, SESSIONS_KEPT, PURGE_DAYS, DECAY_DAYS, DECAY = 1, 10, 10, 30, 90, 0.05


def topic_needles(query: str | None, most: int = 64) -> list[str]:
    """What a topic's memories are searched for: the query itself, if it isn't long, and its words but stop words, each once; never empty unless the query is."""
    plain = (query or "").lower().strip()
    if not plain:
        return []
    words = [w.strip("./-") for w in re.findall(r"[a-z0-9_./-]+", plain)]
    terms = list(dict.fromkeys(w for w in words if len(w) >= 3 and w not in TOPIC_STOP_WORDS))[:most]
    return list(dict.fromkeys([plain] * (len(plain) <= 120) + terms)) or [plain[:120]]


def compacted(observations: DataFrame, prompts: DataFrame, sessions: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """observations, user_prompts, sessions and links that a compaction keeps, by name; each step sees what those before it left.

    Expired memories go; links to no live memory; memories deleted 30 days ago; all but the newest session summary of a project, its 10
    newest prompts and its 10 newest sessions, of which open ones stay; prompts of sessions that went. Trust in memories unchanged for
    90 days falls by 0.05. "Now" is the newest created_at. links: id, memory_id (long), trust_score. A null project is a project.
    """
    now = F.broadcast(observations.agg(F.max("created_at").alias("__now")))
    gone = lambda test: ~F.coalesce(test, F.lit(False))
    o = observations.join(now).filter(gone(F.col("expires_at") < F.col("__now")))
    live = o.filter("deleted_at IS NULL").select(F.col("id").alias("memory_id"))
    kept_links = links.join(live, "memory_id", "left_semi")
    o = o.filter(gone(F.col("deleted_at") < F.col("__now") - F.make_dt_interval(F.lit(PURGE_DAYS))))
    summary = F.coalesce((F.col("type") == "session_summary") & F.col("deleted_at").isNull(), F.lit(False))
    o = o.filter(~summary).unionByName(keep_newest(o.filter(summary), "project", "created_at", SUMMARIES_KEPT))
    p = keep_newest(prompts, "project", "created_at", PROMPTS_KEPT)
    newest = keep_newest(sessions, "project", "started_at", SESSIONS_KEPT).select("id", F.lit(True).alias("__new"))
    s = sessions.join(newest, "id", "left").filter(F.col("ended_at").isNull() | F.col("__new")).drop("__new")
    p = p.filter("session_id IS NULL").unionByName(p.join(s.select(F.col("id").alias("session_id")), "session_id", "left_semi").select(*p.columns))
    old = o.filter(F.col("updated_at") < F.col("__now") - F.make_dt_interval(F.lit(DECAY_DAYS))).select(F.col("id").alias("memory_id"), F.lit(True).alias("__old"))
    fallen = F.when(F.col("__old") & (F.col("trust_score") > 0), F.round(F.greatest(F.lit(0.0), F.col("trust_score") - DECAY), 6)).otherwise(F.col("trust_score"))
    aged = kept_links.join(old, "memory_id", "left").withColumn("trust_score", fallen).select(*links.columns)
    return {"observations": o.drop("__now"), "user_prompts": p, "sessions": s, "links": aged}


AUTO_CAPTURED = "**What**: Auto-detected"
TOPIC_BOOST, NO_CONTEXT = 5, ("progress", "accomplished", "session_summary")


def context_order(known: DataFrame, variant: str, project: str | None = None, topic: str | None = None, query: str | None = None, limit: int = 10) -> DataFrame:
    """place, id: the memories that a context opens with, in one of four orders. known: live memories with recall_count and trust, skills left out.

    cross: of all projects; topic: those of a topic key stand as if their type's priority were 5; query: by how many needles of the topic match;
    plain: by the priority of the type. What was captured by itself comes last in an order by query. Types that a context doesn't show fall out after the limit.
    """
    priority = case_of(F.col("type"), TYPE_PRIORITY, 0)
    recall, trust, new = F.desc("recall_count"), F.col("trust").desc_nulls_last(), [F.col("created_at").desc_nulls_last(), F.desc("id")]
    mine = known.filter(F.lower("project") == project.lower()) if project else known
    auto = F.coalesce(F.startswith("content", F.lit(AUTO_CAPTURED)), F.lit(False)).cast("int")
    if variant == "cross":
        top = known.filter("scope = 'project'").withColumn("__p", priority)
        order = [recall, trust, F.desc("__p"), *new]
    elif variant == "topic":
        top = mine.withColumn("__p", F.when(F.col("topic_key") == topic, TOPIC_BOOST).otherwise(priority))
        order = [recall, F.desc("__p"), trust, *new]
    elif variant == "query":
        fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("topic_key", "title", "content")]
        hits = sum((F.contains(f, F.lit(n)).cast("int") for n in topic_needles(query) for f in fields), F.lit(0))
        top = mine.withColumn("__m", hits).withColumn("__a", auto).withColumn("__p", priority).filter("__m > 0").orderBy("__a", F.desc("__m"), *new).limit(limit)
        order = ["__a", F.desc("__m"), recall, trust, F.desc("__p"), *new]
    elif variant == "plain":
        top = mine.withColumn("__p", priority)
        order = [recall, F.desc("__p"), trust, *new]
    else:
        raise ValueError(f"no order of a context: {variant}")
    # the limit bounds the window to so many rows
    ranked = top.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return ranked.filter(F.col("type").isNull() | ~F.col("type").isin(*NO_CONTEXT)).select("place", "id")


def code_terms(query: str) -> list[str]:
    """Terms of a query over code: words, and the words that make up a name in camel case; each once."""
    return list(dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", query or "").lower())))


def code_search(symbols: DataFrame, calls: DataFrame, imports: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """id, score: the best symbols for a query whose terms begin words of name, kind, signature and path: three parts relevance, one part how central a symbol is.

    Four times the limit are ranked by relevance; of those, calls and imports are counted (calls: src, dst; imports: src, dst). A query without terms finds nothing.
    """
    terms = code_terms(query)
    if not terms:
        return symbols.limit(0).select("id", F.lit(0.0).alias("score"))
    words, size = _spaced(F.concat_ws(" ", "name", "kind", "signature", "file_path"))
    counted = written(symbols.select("id", size.alias("size"), F.array(*(_occurrences(words, f" {t}") for t in terms)).alias("tf")), "counts")
    top = written(bm25(counted, len(terms)).filter("matched > 0").orderBy(F.desc("relevance"), "id").limit(4 * limit).select("id", "relevance"), "top")
    few = F.broadcast(top.select("id"))  # four times the limit
    n = lambda edges, side, name: edges.select(F.col(side).alias("id")).join(few, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias(name))
    x = top.join(n(calls, "dst", "in"), "id", "left").join(n(imports, "dst", "importers"), "id", "left").join(n(calls, "src", "out"), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    x = x.withColumn("c", 2.0 * zero("in") + 1.5 * zero("importers") + 0.25 * zero("out"))
    best = F.broadcast(x.agg(F.max("c").alias("m")))
    score = 0.75 * F.col("relevance") / (1 + F.col("relevance")) + 0.25 * F.col("c") / F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)
    return x.join(best).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(limit).select("id", "score")


# Fixed values of a clean-up: how sure a relation must be, how old and how little trusted what was captured by itself, and titles that say nothing.
SURE_RELATION, MIN_AGE_DAYS, LOW_TRUST, TOPIC_GROUP = 0.6, 7, 0.3, 3
SELF_CAPTURED_TYPES = ("decision", "bugfix", "discovery", "architecture", "pattern")
NOISE_TITLES = (
    r"(?i)^Architecture choice:\s*(Done!|OK|Now I|Here's what|All [0-9]+ |The complex|The symlink|Good concern|You're right|Approved)",
    r"(?i)^Constraint identified:\s*(Here's my review|Two issues|All errors)",
)


def cleaned(obs: DataFrame, relations: DataFrame, links: DataFrame, recalls: DataFrame) -> DataFrame:
    """id, phase, kept_id: what a clean-up does with each memory, as one snapshot; phase is null for those it leaves as they are.

    Phases in their order, each over what those before it left live: expired; superseded by a live memory through a sure relation; stale progress that was never useful;
    captured by itself, never useful and little trusted; corrections; noise; topics of three memories and more, consolidated into the oldest
    (which is then merged); all but the newest session summary of a project. relations: source_id, target_id, confidence. Null ages are young.
    """
    x = signals(with_now(obs, obs), links, recalls)
    gone = F.coalesce(F.col("expires_at") < F.col("now"), F.lit(False))
    live_ids = x.filter(~gone & F.col("deleted_at").isNull()).select(F.col("id").alias("source_id"))
    over = relations.filter(F.col("confidence") >= SURE_RELATION).join(live_ids, "source_id", "left_semi").select(F.col("target_id").alias("id"), F.lit(True).alias("__over")).distinct()
    old = F.coalesce(F.col("created_at") < F.col("now") - F.make_dt_interval(F.lit(MIN_AGE_DAYS)), F.lit(False))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    unused = F.col("useful_count") == 0
    noise = F.coalesce(F.col("title"), F.lit(""))
    phase = (
        F.when(gone, "expired")
        .when(F.col("deleted_at").isNotNull(), "deleted")
        .when(F.col("__over"), "superseded")
        .when(F.col("type").isin("progress", "accomplished") & unused & old, "stale")
        .when(F.col("type").isin(*SELF_CAPTURED_TYPES) & unused & F.startswith(low("content"), F.lit(AUTO_CAPTURED.lower())) & (F.col("trust").isNull() | (F.col("trust") < LOW_TRUST)) & old, "auto-detected")
        .when(F.startswith(low("title"), F.lit("correction:")) & old, "correction")
        .when((F.col("type") == "decision") & (noise.rlike(NOISE_TITLES[0]) | noise.rlike(NOISE_TITLES[1])), "noise")
    )
    x = written(x.join(over, "id", "left").withColumn("phase", phase).select("id", "project", "type", "topic_key", "expires_at", "created_at", "phase"), "phases")
    topics = x.filter("phase IS NULL AND topic_key <> '' AND expires_at IS NULL AND type NOT IN ('skill', 'session_summary')").withColumn("project", F.coalesce("project", F.lit("\0")))
    groups = topics.groupBy("topic_key", "project").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TOPIC_GROUP)
    merged = topics.join(groups, ["topic_key", "project"]).select("id", F.when(F.col("id") == F.col("kept_id"), "merged").otherwise("consolidated").alias("later"), "kept_id")
    summaries = x.filter("phase IS NULL AND type = 'session_summary'")
    extra = summaries.join(keep_newest(summaries, "project", "created_at", 1).select("id"), "id", "left_anti").select("id", F.lit("summary").alias("later"), F.lit(None).cast("long").alias("kept_id"))
    return x.join(merged.unionByName(extra), "id", "left").select("id", F.coalesce("phase", "later").alias("phase"), F.when(F.col("phase").isNull(), F.col("kept_id")).alias("kept_id"))
