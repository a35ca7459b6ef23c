"""Phrase collocations by Toivonen's sampling: a sample proposes, a full pass verifies, failures expand.

Words are A-Z lowered and lie between spaces and tabs inside pieces of text; a phrase is a run of words of
one piece.  All is counted per language.  A phrase can only be frequent if the two phrases left by dropping
its last or first word are, so:

1. A sample of the rows proposes a set S of phrases that may be frequent.
2. A full pass counts every phrase whose two shorter phrases are in S: S itself and its negative border
   (phrases just outside S), every word included.  Counts are exact.
3. A border phrase that turns out frequent is a failure: phrases that hold it were not counted.  Failures join
   S, and a further full pass counts only the phrases this brings in, until no pass has a failure.

The result is thus exact whatever the sample held.  S travels to the tasks as a bit filter of bounded size
(``FILTER_BITS``); a false positive there only has a phrase counted that need not be.  Texts are turned into slices
of word numbers, each of one language, once; every full pass reads these.  Tasks count slices in numpy and send
one row a distinct phrase and slice; Spark adds them up with map-side combining, so a phrase that every
document holds is a few rows, and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import top_n_per_group
from ..session import cut_lineage
from .common import slices

MIN_COUNT = 10
SAMPLE_RATE = 0.0625
SAMPLE_COUNT = 2              # a phrase is proposed if the sample holds it so often
FILTER_BITS = 1 << 27         # 16 MB, the most that is sent to a task
COVER = 50                    # a phrase goes if a longer one has this percent of its occurrences or more
SLICE_BYTES = 2_000_000
HELD_BYTES = 4 * SLICE_BYTES  # texts that a task holds back until a language fills a slice
ROWS_OUT = 100_000
# A slice is one row of some MB: Parquet looks at its memory after every row.
SLICE_FILES = {"parquet.block.size": str(1 << 23), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
NO_LANGUAGE = "und"

# Every separator becomes a full stop, which no word holds; A-Z become a-z.
_TABLE = bytes.maketrans(b",;:!?\n\x0b\x0c\r" + bytes(range(65, 91)), b"." * 9 + bytes(range(97, 123)))


def words_of(texts: list[str]) -> list[bytes]:
    """Words of the texts in order, with b"." wherever a piece ends."""
    joined = b".".join(t.encode("utf-8") for t in texts).translate(_TABLE)
    return joined.replace(b".", b" . ").split()


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and the last word's."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Hashes of many phrases, those of ``count_slice``."""
    place: dict[tuple[str, str], int] = {}
    at = [[place.setdefault((x, w), len(place)) for w in p.split(" ")] for x, p in zip(langs, phrases, strict=True)]
    seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
    of = np.array([xxhash.xxh64_intdigest(w.encode(), seeds[x]) for x, w in place], np.uint64)
    size = np.array([len(x) for x in at], np.int64)
    out = np.zeros(len(at), np.uint64)
    for k in np.unique(size).tolist():
        rows = np.flatnonzero(size == k)
        words = of[np.array([at[i] for i in rows], np.int64)]
        h = words[:, 0]
        for j in range(1, k):
            h = _mix(h, words[:, j])
        out[rows] = h
    return out


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return h & m, (h >> np.uint64(32)) & m


class PhraseFilter:
    """Set of phrases as bits, two a phrase; ``has`` may say yes to others, never no to one of the set."""

    def __init__(self, words: np.ndarray):
        self.words = words  # 64 bits each; their number is a power of two

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for s in _slots(h, 64 * len(self.words)):
            out &= (self.words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1
        return out


def _filter_of(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bits of ``phrases`` (lang, phrase), put together by Spark; at most ``bits`` / 64 rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist())
            slot = np.concatenate(_slots(h, bits))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], ["at", "bit"])
    rows = phrases.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    got = rows.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return words


def _bits_for(n: int, most: int) -> int:
    """A power of two with about 16 bits a phrase, within bounds."""
    return min(most, max(1 << 12, 1 << (16 * max(n, 1) - 1).bit_length()))


def numbered_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The different words of the texts and the numbers of all words in order; number 0 is b".", the end of a piece."""
    number: dict[bytes, int] = {b".": 0}
    ids = np.array([number.setdefault(w, len(number)) for w in words_of(texts)], np.int32)
    return list(number), ids.astype(_number_type(len(number)))


def _number_type(n_words: int) -> type:
    return np.uint16 if n_words <= 1 << 16 else np.int32


def word_slices(texts: DataFrame) -> DataFrame:
    """``texts`` (lang, text) as slices (lang, words, ids) of one language each: the different words, joined by spaces,
    and the numbers of all words in order (``_number_type``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}

        def slice_of(lang: str) -> pa.RecordBatch:
            del size[lang]
            words, ids = numbered_words(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b" ".join(words)], pa.binary()), pa.array([ids.tobytes()], pa.binary())],
                                              ["lang", "words", "ids"])

        for whole in batches:
            for b in slices(whole, [1], SLICE_BYTES):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if lang in held and size[lang] + len(text) > SLICE_BYTES:
                        yield slice_of(lang)
                    held.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                while sum(size.values()) > HELD_BYTES:
                    yield slice_of(max(size, key=size.get))
        for lang in list(held):
            yield slice_of(lang)
    return texts.mapInArrow(run, "lang string, words binary, ids binary")


def count_slice(lang: str, words: list[bytes], ids: np.ndarray, longest: int, now: PhraseFilter | None, before: PhraseFilter | None,
                all_words: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases and counts of one slice, ``ROWS_OUT`` at a time.

    Words are counted if ``all_words``, and then the empty phrase counts all of them.  A longer phrase is counted
    if both its shorter phrases are in ``now`` (None: any), but not if both are in ``before``: a former
    pass has counted it.
    """
    names = pa.array(words, pa.binary()).cast(pa.string())
    wh = word_hashes(lang, words)
    n_words = len(words)

    def rows(at: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for i in range(0, len(n), ROWS_OUT):
            parts = [names.take(pa.array(a[i:i + ROWS_OUT])) for a in at]
            yield pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0], n[i:i + ROWS_OUT]

    inside = ids > 0
    if all_words:
        c = np.bincount(ids, minlength=n_words)
        c[0] = 0
        at = np.flatnonzero(c)
        yield pa.array([""], pa.string()), np.array([inside.sum()], np.int64)
        yield from rows([at], c[at])
    # h: hash of the phrase of k words that begins at each place; has_*: both its shorter phrases are in the set
    h = wh[ids]

    def members(which):
        return inside if which is None else inside & which.has(wh)[ids]

    has_now, has_before = members(now), None if before is None else members(before)
    for k in range(2, longest + 1):
        if len(has_now) < 2:
            break
        can = has_now[:-1] & has_now[1:]
        seen = None if has_before is None else has_before[:-1] & has_before[1:]
        start = np.flatnonzero(can if seen is None else can & ~seen)
        if len(start):
            yield from rows(*_distinct([ids[start + i] for i in range(k)], n_words))
        if k == longest:
            break
        h = _mix(h[:-1], wh[ids[k - 1:]])
        has_now = can if now is None else _both(can, now, h)
        has_before = None if seen is None else _both(seen, before, h)


def _both(places: np.ndarray, which: PhraseFilter, h: np.ndarray) -> np.ndarray:
    """``places`` whose phrase is in the filter."""
    out, at = np.zeros(len(places), bool), np.flatnonzero(places)
    out[at] = which.has(h[at])
    return out


def _distinct(words: list[np.ndarray], n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of word numbers, column by column, and how often each occurs."""
    if n_words ** len(words) >= 1 << 62:
        _, first, n = np.unique(_numbered(words, n_words), return_index=True, return_counts=True)
        return [w[first] for w in words], n
    key = words[0].astype(np.int64)
    for w in words[1:]:
        key = key * n_words + w
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, key, out = np.diff(np.append(first, len(key))), key[first], []
    for _ in words:
        key, w = np.divmod(key, n_words)
        out.append(w)
    return out[::-1], n


def _numbered(words: list[np.ndarray], n_words: int) -> np.ndarray:
    """One whole number for each row of word numbers, equal for equal rows only."""
    key, most = words[0].astype(np.int64), n_words
    for w in words[1:]:
        if most * n_words >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            most = len(key)
        key, most = key * n_words + w, most * n_words
    return key


def count_phrases(some: DataFrame, longest: int, now=None, before=None, all_words: bool = True) -> DataFrame:
    """(lang, phrase, n) of ``some`` (``word_slices``) for the phrases that ``count_slice`` names.  ``now`` and
    ``before`` are broadcasts of filter words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [None if b is None else PhraseFilter(b.value) for b in (now, before)]
        for b in batches:
            for lang, words, ids in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                own = words.as_py().split(b" ")
                numbers = np.frombuffer(ids.as_buffer(), _number_type(len(own)))
                for p, n in count_slice(lang, own, numbers, longest, *sets, all_words):
                    yield pa.RecordBatch.from_arrays(
                        [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(p), np.int32)), pa.array([lang])).cast(pa.string()),
                         p, pa.array(n, pa.int64())], ["lang", "phrase", "n"])
    rows = some.select("lang", "words", "ids").mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int, min_count: int = MIN_COUNT, rate: float = SAMPLE_RATE,
                     sample_count: int = SAMPLE_COUNT, lang: str = "lang", text: str = "text", seed: int = 7,
                     most_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, n): every phrase of 1 to ``longest`` words that occurs ``min_count`` times or more, and under the
    empty phrase the number of words, exact."""
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Written between the two steps in Python: a task with both would hold two workers, which stay for later passes.
    some = cut_lineage(word_slices(src.sample(rate, seed)), "sample", **SLICE_FILES)
    proposed = count_phrases(some, max(longest - 1, 1)).where((F.col("n") >= sample_count) & (F.col("phrase") != ""))
    fresh = cut_lineage(proposed, "proposed")
    src = cut_lineage(word_slices(src), "words", **SLICE_FILES)
    found, before, bits, members = None, None, None, 0
    while True:
        members += fresh.count()
        if bits is None:  # room for what later passes add
            bits = _bits_for(4 * members, most_bits)
            words = np.zeros(bits // 64, np.uint64)
        words = words | _filter_of(fresh, bits)
        now = sc.broadcast(words)
        counted = count_phrases(src, longest, now, before, found is None).where((F.col("n") >= min_count) | (F.col("phrase") == ""))
        part = cut_lineage(counted, "counted")
        found = part if found is None else found.unionByName(part)
        fresh = cut_lineage(_outside(part, now, longest), "failures")
        if before is not None:
            before.unpersist()
        before = now
        if fresh.isEmpty():
            break
    return found


def _outside(part: DataFrame, now, longest: int) -> DataFrame:
    """Phrases of ``part`` shorter than ``longest`` words that are not in the filter: failures of the border."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = PhraseFilter(now.value)
        for b in batches:
            h = phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield b.filter(pa.array(~held.has(h)))
    some = part.where((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) < longest)).select("lang", "phrase")
    return some.mapInArrow(run, "lang string, phrase string")


def _length(c: str) -> Column:
    return F.size(F.split(c, " "))


def collocations(docs: DataFrame, shortest: int = 2, longest: int = 3, min_count: int = MIN_COUNT, top: int | None = 2000,
                 cover: int = COVER, lang: str = "lang", text: str = "text", **sampling) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of ``shortest`` to ``longest`` words.

    ``a`` occurrences of the phrase; ``l`` and ``r`` those of the two parts at its weakest cut; ``score``
    floor(1000000 a a / (l r)) there, in decimals; ``n`` words of the language.  Phrases that a longer one covers by
    ``cover`` percent or more are left out.  ``top`` phrases a language (None: all) by score, occurrences, phrase.
    A null language is ``und``, a null text is empty, repeated rows count each; an empty table gives no rows.
    """
    found = cut_lineage(frequent_phrases(docs, longest, min_count, lang=lang, text=text, **sampling), "phrases")
    sizes = found.where("phrase = ''").select("lang", F.col("n").alias("words"))
    counts = found.where("phrase <> ''")
    long = counts.where(_length("phrase") >= shortest).withColumn("k", _length("phrase"))
    cuts = (long.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .withColumn("left", F.expr("substring_index(phrase, ' ', cut)"))
            .withColumn("right", F.expr("substring(phrase, char_length(left) + 2)")))
    of_left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    of_right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    both = cut_lineage(cuts.join(of_left, ["lang", "left"]), "cuts").join(of_right, ["lang", "right"])
    score = F.expr("(cast(a as decimal(38,0)) * cast(a as decimal(38,0)) * 1000000) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    weakest = (both.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a")
               .agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score"))
    parts = F.expr(f"""flatten(transform(sequence({shortest}, k - 1), m ->
        transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))""")
    longer = (long.where(F.col("k") > shortest).select("lang", F.col("n").alias("more"), F.explode(parts).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("more").alias("more")))
    kept = (weakest.join(longer, ["lang", "phrase"], "left")
            .where(F.col("more").isNull() | (100 * F.col("more") < cover * F.col("a"))).drop("more"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is None:
        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    else:
        ranked = top_n_per_group(kept, ["lang"], order, top, "phrase")
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def oracle_sql(shortest: int = 2, longest: int = 3, min_count: int = MIN_COUNT, top: int = 2000, cover: int = COVER) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), g AS (
  SELECT lang, k.range AS k, unnest(list_transform(range(1, len(w) - k.range + 2), lambda i: array_to_string(w[i:i + k.range - 1], ' '))) AS phrase
  FROM w, range(1, {longest + 1}) k WHERE len(w) >= k.range
), f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL
), size AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS p FROM f WHERE k >= {shortest} AND n >= {min_count}
), cuts AS (
  SELECT c.lang, c.k, c.phrase, a, l.n AS l, r.n AS r, cut.range AS cut,
    CAST((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM c, range(1, {longest}) cut
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:cut.range], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(p[cut.range + 1:], ' ')
  WHERE cut.range < c.k
), weak AS (SELECT lang, k, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts
), parts AS (
  SELECT lang, array_to_string(p[i.range:i.range + m.range - 1], ' ') AS phrase, max(a) AS more
  FROM c, range({shortest}, {longest}) m, range(1, {longest}) i WHERE m.range < k AND i.range + m.range - 1 <= k GROUP BY ALL
), kept AS (
  SELECT weak.lang, weak.phrase, a, l, r, score FROM weak LEFT JOIN parts ON parts.lang = weak.lang AND parts.phrase = weak.phrase
  WHERE nth = 1 AND (more IS NULL OR 100 * more < {cover} * a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(size.n AS BIGINT) AS n, score FROM ranked JOIN size USING (lang) WHERE rank <= {top}"""
