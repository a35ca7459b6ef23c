"""Personal data by bootstrapped contextual extraction, in DataFrame operations throughout.

1. Seeds: spans of four formats (e-mail, IP address, payment card, phone number), each checked.
2. Instances: seeds are known ones; candidates are words of ``MIN_CHARS`` or more with two digits or an
   ``@`` that touch no seed.  An instance's lexical patterns are the two words before it, and the word
   before and the one after it.
3. The graph of patterns and instances (distinct values) is scored in ``ROUNDS`` rounds: a pattern's
   confidence is the mean confidence of its instances, zero unless at least ``SUPPORT`` distinct known
   values show it; an instance's confidence is a noisy-or over its patterns, one for known ones.
4. An occurrence outside the seeds is a new identifier if its value's confidence reaches ``INSTANCE`` and one
   of its own patterns reaches ``PATTERN``.

Counts cover all documents.  Graph steps are grouped aggregates with map-side combining and equi-joins
that adaptive execution may split, so a frequent word or value is no single task.

Positions: a text is split at the matches of an expression, and lengths of the pieces and matches add
up to code-point offsets.  Expressions never look at a character more than a bounded number of times
(possessive repeats; a start inside a run is refused unless a match has just ended there).

Null texts count as empty and hold nothing; repeated rows each get their spans; a value repeated in a
document is one instance with several spans.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MIN_CHARS = 6
ROUNDS = 3
SUPPORT = 3
PATTERN = 0.8
INSTANCE = 0.8

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
CANDIDATE = r"\s[^\s0-9@]*+[0-9@]\S*+"  # of a text with a space set before it
KINDS = ("email", "ip", "card", "phone")
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the Luhn check."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d * 2 - F.when(d > 4, 9).otherwise(0) if i % 2 == 0 else d)
    return total % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    if kind == "ip":
        return c.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(c))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(c))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def _placed(found: Column, pieces: Column, make) -> Column:
    """``make(start, end, match, index)`` for each match, from the lengths of matches and pieces."""
    none = F.array().cast("array<int>")
    lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
    ends = F.aggregate(lengths, none, lambda acc, n: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + n)))
    return F.zip_with(found, ends, lambda m, e: make(e - F.length(m), e, m))


def seed_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: seed spans (start, rank, end, kind) sorted, of code points."""
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    t = F.col(f"`{text}`")
    hint = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "ip": F.lit(True), "card": F.lit(True)}
    none = F.array().cast("array<string>")
    matches = {k: f"{out}: {k} matches" for k in KINDS}
    parts = {k: f"{out}: {k} pieces" for k in KINDS}
    df = docs.withColumns({matches[k]: F.when(t.isNotNull() & hint[k], F.regexp_extract_all(t, F.lit(patterns[k]), F.lit(0))).otherwise(none)
                           for k in KINDS})
    df = df.withColumns({parts[k]: _pieces(t, patterns[k], F.col(f"`{matches[k]}`")) for k in KINDS})
    spans = []
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    for rank, k in enumerate(KINDS):
        m, p = F.col(f"`{matches[k]}`"), F.col(f"`{parts[k]}`")
        placed = _placed(m, p, lambda s, e, v, k=k, rank=rank: F.struct(
            s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(k).alias("kind"), _valid(k, v).alias("ok")))
        good = F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))
        spans.append(F.when(F.size(m) > 0, good).otherwise(empty))
    return df.withColumn(out, F.array_sort(F.concat(*spans))).drop(*matches.values(), *parts.values())


def candidates(docs: DataFrame, text: str, seeds: str, out: str) -> DataFrame:
    """``docs`` with ``out``: candidate words (start, end, value, known, patterns)."""
    t = F.concat(F.lit(" "), F.col(f"`{text}`"))
    found, parts = f"{out}: matches", f"{out}: pieces"
    df = docs.withColumn(found, F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))
                         .otherwise(F.array().cast("array<string>")))
    df = df.withColumn(parts, _pieces(t, CANDIDATE, F.col(f"`{found}`")))
    m, p = F.col(f"`{found}`"), F.col(f"`{parts}`")
    placed = _placed(m, p, lambda s, e, v: F.struct((s - 1).alias("start"), (e - 1).alias("end"), v.alias("match")))
    # The context is the text around the word, matches before and after it included: two words before it lie in
    # the last two matches and the pieces after them, as every match is one word.
    ends = F.transform(p, lambda c: F.struct(F.right(c, F.lit(80)).alias("last"), F.left(c, F.lit(80)).alias("first")))
    near = lambda a, i, name: F.coalesce(F.get(a, i)[name], F.lit(""))
    words = F.transform(m, lambda c: F.struct(F.right(c, F.lit(80)).alias("last"), F.left(c, F.lit(80)).alias("first")))
    with_context = F.transform(placed, lambda x, i: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"),
        F.concat(near(words, i - 2, "last"), near(ends, i - 1, "last"), near(words, i - 1, "last"), near(ends, i, "last")).alias("before"),
        F.concat(near(ends, i + 1, "first"), near(words, i + 1, "first")).alias("after")))
    # Punctuation around a word is not part of it.
    lead = lambda x: F.length(F.regexp_extract(x["match"], r"^[\s\"'(\[<{,;:=]*", 0))
    trail = lambda x: F.length(F.regexp_extract(x["match"], r"[\"')\]>},;:.!?]*$", 0))

    def trimmed(x):
        a, b = lead(x), trail(x)
        n = F.greatest(F.length(x["match"]) - a - b, F.lit(0))
        return F.struct((x["start"] + a).alias("start"), (x["start"] + a + n).alias("end"),
                        F.substr(x["match"], a + 1, n).alias("value"),
                        _tail(F.concat(x["before"], F.left(x["match"], a))).alias("before"),
                        _head(F.concat(F.right(x["match"], F.length(x["match"]) - a - n), x["after"])).alias("after"))
    seed = F.col(f"`{seeds}`")
    likely = lambda x: ((F.length(x["value"]) >= MIN_CHARS) & x["value"].rlike("@|[0-9][^0-9]*[0-9]")
                        & ~F.exists(seed, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    instance = lambda x, known: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value"), F.lit(known).alias("known"),
        _patterns(x["before"], x["after"]).alias("patterns"))
    fresh = F.transform(F.filter(F.transform(with_context, trimmed), likely), lambda x: instance(x, False))
    # A seed may hold spaces, so its context is read around its span.
    own = F.col(f"`{text}`")
    first = lambda x: F.greatest(x["start"] - 80, F.lit(0))
    around = F.transform(seed, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.substr(own, x["start"] + 1, x["end"] - x["start"]).alias("value"),
        _tail(F.substr(own, first(x) + 1, x["start"] - first(x))).alias("before"), _head(F.substr(own, x["end"] + 1, F.lit(80))).alias("after")))
    known = F.transform(around, lambda x: instance(x, True))
    return df.withColumn(out, F.when(F.size(m) > 0, F.concat(known, fresh))).drop(found, parts)


# Contexts: the last two words before, the first after, within 80 characters; digits read 0.
def _near(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[0-9]", "0")


def _tail(c: Column) -> Column:
    return _near(F.regexp_extract(F.right(c, F.lit(80)), r"((?:\S+\s+)?\S+)\s*$", 1))


def _head(c: Column) -> Column:
    return _near(F.regexp_extract(F.left(c, F.lit(80)), r"^\s*(\S+)", 1))


def _patterns(before: Column, after: Column) -> Column:
    last = F.regexp_extract(before, r"(\S+)$", 1)
    return F.filter(F.array(F.when(before.rlike(r"\S\s+\S"), F.concat(before, F.lit(" _"))),
                            F.when((before != "") & (after != ""), F.concat_ws(" ", last, F.lit("_"), after))),
                    lambda y: y.isNotNull())


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Confidence of patterns and of values from ``occurrences`` (value, known, pattern): two tables.

    Each distinct (pattern, value) is one link however often it occurs.
    """
    links = cut_lineage(occurrences.groupBy("pattern", "value").agg(F.max("known").alias("known")), "pattern-graph")
    values = links.groupBy("value").agg(F.max("known").alias("known")).withColumn("score", F.col("known").cast("double"))
    patterns = None
    for _ in range(rounds):
        patterns = (links.select("pattern", "value").join(values, "value").groupBy("pattern")
                    .agg(F.avg("score").alias("mean"), F.sum(F.col("known").cast("long")).alias("seeds"))
                    .select("pattern", F.when(F.col("seeds") >= support, F.col("mean")).otherwise(0.0).alias("confidence")))
        patterns = cut_lineage(patterns, "pattern-scores")
        # One minus the product of (1 - confidence): a sum of logarithms, with a floor for certainty.
        doubt = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))
        values = (links.join(patterns, "pattern").groupBy("value").agg(F.max("known").alias("known"), F.sum(doubt).alias("doubt"))
                  .select("value", "known", F.when(F.col("known"), 1.0).otherwise(1 - F.exp("doubt")).alias("score")))
        values = cut_lineage(values, "value-scores")
    return patterns, values


def find_personal(docs: DataFrame, text: str = "text", out: str = "personal", rounds: int = ROUNDS,
                  keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (by default all but the text) with ``out``: spans (start, rank, end, kind) by
    start, then kind; kind ``context`` is discovered.

    Texts are scanned once; what is found in them, and ``keep``, is written to the shared folder.
    """
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c != out]
    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))
    # Rows are told apart by their text alone: equal texts have equal spans.
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(29), "text").alias("b"), F.length("text").alias("n"))
    scanned = cut_lineage(candidates(seed_spans(src, "text", "seeds"), "text", "seeds", "cands")
                          .select(*[f"k{i}" for i in range(len(kept))], key.alias("key"), "seeds", "cands"), "personal-scan")
    occurrences = (scanned.where(F.size("cands") > 0).groupBy("key").agg(F.first("cands").alias("cands"))
                   .select("key", F.explode("cands").alias("c")).select("key", "c.*"))
    occurrences = cut_lineage(occurrences, "candidates")
    patterns, values = bootstrap(occurrences.select("value", "known", F.explode("patterns").alias("pattern")), rounds)
    sure = values.where(~F.col("known") & (F.col("score") >= INSTANCE)).select("value")
    strong = patterns.where(F.col("confidence") >= PATTERN).select("pattern")
    hits = (occurrences.where(~F.col("known")).select("key", "start", "end", "value", F.explode("patterns").alias("pattern"))
            .join(strong, "pattern").join(sure, "value").select("key", "start", "end").distinct())
    span = F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), F.lit("context").alias("kind"))
    found = cut_lineage(hits.groupBy("key").agg(F.collect_set(span).alias("new")), "personal-contexts")  # one text's spans
    joined = scanned.drop("cands").join(found, "key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    spans = F.array_sort(F.concat("seeds", F.coalesce("new", none)))
    return joined.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], spans.alias(out))


def personal_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the seed kinds, a digest of the seed spans and all spans as text."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = find_personal(src, keep=["doc_id"])
    as_text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    seeds = F.filter("personal", lambda x: x["kind"] != "context")
    count = lambda k: F.size(F.filter("personal", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(F.array_join(F.transform(seeds, as_text), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("personal", as_text), ",").alias("spans"))
