"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one binary n-gram classifier per bit predicts on which side of
the bit a text's language lies, and loss-weighted decoding takes the nearest codeword.  Features are
hashed 1- to 4-grams of lower-cased letters, words set off by a space; a bit's weights are the
smoothed log odds of each feature between the two sides.

Learning reads texts with a label, at most about ``rows_per_language`` a language (chosen by a hash
of their text, so independent of order); the counts are summed by Spark, and only the table of
languages by hash bins reaches the driver (its size is fixed by those two numbers).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

UNDETERMINED = "und"
BINS = 1 << 15
ROWS_PER_LANGUAGE = 3000
CODE_SEED = 7
AMBIGUOUS_BELOW = 0.6
SLICE_CHARS = 1_000_000  # a slice's n-grams take about 100 bytes a character
_ORDERS = 4
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point 1 if it is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash bins of all n-grams, text number of each, whether each text has a letter)."""
    is_letter = _letters()
    codes = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "replace"), "<u4") if t else np.full(2, 32, "<u4")
             for t in texts]
    sizes = np.array([len(c) for c in codes])
    all_codes = np.concatenate(codes) if codes else np.zeros(0, "<u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = is_letter[all_codes]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    # One space between words; n-grams never reach into the next text, which begins with its own.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = np.cumsum(sizes) - sizes
    keep[first] = True
    c = np.where(letter, all_codes, 32).astype(np.uint32)[keep]
    owner = owner[keep]
    bins, owners = [], []
    h = np.zeros(len(c), np.uint32)
    for n in range(_ORDERS):
        m = len(c) - n
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + c[n:n + m] * _MIX[n]
        x = h ^ (h >> np.uint32(15))
        ok = owner[:m] == owner[n:]
        if n == 0:
            ok &= c != 32
        bins.append(((x * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int32)[ok])
        owners.append(owner[:m][ok])
    return np.concatenate(bins), np.concatenate(owners), has


def pieces(texts: list[str | None]) -> Iterator[tuple[list[str | None], np.ndarray]]:
    """Groups of texts of ``SLICE_CHARS`` at most, with the number of the text each belongs to.  A longer text
    comes in several pieces; only the n-grams across their borders differ."""
    part, of, held = [], [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(len(t or ""), 1), SLICE_CHARS):
            piece = t[a:a + SLICE_CHARS] if t else t
            if part and held + len(piece or "") > SLICE_CHARS:
                yield part, np.array(of)
                part, of, held = [], [], 0
            part.append(piece)
            of.append(k)
            held += len(piece or "")
    if part:
        yield part, np.array(of)


def codewords(n: int, seed: int = CODE_SEED) -> np.ndarray:
    """n x bits matrix of 0 and 1 with every bit telling languages apart and rows far from each other.

    Up to six languages: every split once (2^(n-1) - 1 bits).  More: of 200 random codes of
    10 log2(n) bits the one whose nearest two rows differ most.
    """
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        return np.array([[(s >> i) & 1 for s in range(1, 1 << (n - 1))] for i in range(n)], np.int8)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        m = rng.integers(0, 2, (n, bits), dtype=np.int8)
        if ((s := m.sum(0)) == 0).any() or (s == n).any():
            continue
        d = min(int((m[i] != m[i + 1:]).sum(1).min()) for i in range(n - 1))
        if d > far:
            best, far = m, d
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # BINS x bits
    reliability: np.ndarray  # per bit, weight of its loss

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score in 0 to 1 and the lead over the second language, per text."""
        n, bits = len(texts), self.code.shape[1]
        if not self.languages:
            return [UNDETERMINED] * n, [0.0] * n, [0.0] * n
        size, side, has = np.zeros(n), np.zeros((n, bits)), np.zeros(n, bool)
        for part, of in pieces(texts):
            bins, owner, letters = features(part)
            size += np.bincount(of, np.bincount(owner, minlength=len(part)), n)
            for b in range(bits):
                side[:, b] += np.bincount(of, np.bincount(owner, self.weights[:, b][bins], len(part)), n)
            has[of[letters]] = True
        size = np.maximum(size, 1)
        side /= np.sqrt(size)[:, None]  # n-grams of a text overlap: its evidence grows slower than their number
        signs = 2.0 * self.code - 1
        loss = np.stack([(np.logaddexp(0, -signs[k] * side) * self.reliability).sum(1) for k in range(len(signs))], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, 1, kind="stable")
        best = order[:, 0]
        top = p[np.arange(n), best]
        second = p[np.arange(n), order[:, 1]] if p.shape[1] > 1 else np.zeros(n)
        return ([self.languages[k] if h else UNDETERMINED for k, h in zip(best.tolist(), has.tolist(), strict=True)],
                np.where(has, top, 0.0).tolist(), np.where(has, top - second, 0.0).tolist())


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang",
                  rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learns from rows with non-null ``text`` and ``lang``.  No such rows: a model without languages."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        "lang is not null and text is not null")
    totals = rows.groupBy("lang").count().collect()  # one row a language
    if not totals:
        return LanguageModel([], np.zeros((0, 0), np.int8), np.zeros((BINS, 0)), np.zeros(0))
    share = F.create_map(*[x for r in totals for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_language / r["count"])))])
    # A hash of the text decides, so copies of one text go together and the order never matters.
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(float(1 << 30)))

    def make():
        def work(texts, langs):
            # One row of counts a language and slice, on the slice's last row of that language.
            names = sorted(set(langs))
            at = np.array([names.index(x) for x in langs])
            table = np.zeros((len(names), BINS), np.int64)
            for part, of in pieces(texts):
                bins, owner, _ = features(part)
                table += np.bincount(at[of][owner] * BINS + bins, minlength=len(names) * BINS).reshape(-1, BINS)
            out = [None] * len(texts)
            for k, name in enumerate(names):
                some = np.flatnonzero(table[k])
                out[len(langs) - 1 - langs[::-1].index(name)] = [{"bin": b, "n": n} for b, n in zip(some.tolist(), table[k][some].tolist(), strict=True)]
            return [out]
        return work
    cell = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])
    counts = (append_columns(picked, ["text", "lang"], [("cells", T.ArrayType(cell))], make, ["lang"], SLICE_CHARS)
              .select("lang", F.explode("cells").alias("cell"))
              .groupBy("lang", "cell.bin").agg(F.sum("cell.n").alias("n")).toPandas())  # languages x BINS at most
    names = sorted(r["lang"] for r in totals)
    table = np.zeros((len(names), BINS))
    np.add.at(table, (counts["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), counts["bin"].to_numpy(int)), counts["n"].to_numpy(float))
    rate = (table + 0.5 * table.sum(1, keepdims=True).clip(1) / 1e6) / (table.sum(1, keepdims=True) + 0.5)
    code = codewords(len(names))
    weights, reliability = np.zeros((BINS, code.shape[1])), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        one, zero = rate[code[:, b] == 1].mean(0), rate[code[:, b] == 0].mean(0)
        weights[:, b] = np.clip(np.log(one / zero), -4, 4)
        # Expected margin of the two sides: bits that separate well count more.
        reliability[b] = max(1e-3, (one * weights[:, b]).sum() - (zero * weights[:, b]).sum())
    reliability /= reliability.mean() if len(reliability) else 1
    return LanguageModel(names, code, weights.astype(np.float32), reliability)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with ``<prefix>pred``, ``<prefix>score`` (0 to 1) and ``<prefix>ambiguous``.

    Null texts and texts without a letter: ``und``, 0 and true.  Ambiguous: the nearest codeword's
    share of the decoding is under 0.6.  Whole texts, one pass, no shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages and BINS fix its size

    def make():
        def work(texts):
            lang, score, _ = shipped.value.predict(texts)
            return [lang, score, [s < AMBIGUOUS_BELOW for s in score]]
        return work
    return append_columns(docs, [text], [(prefix + "pred", T.StringType()), (prefix + "score", T.DoubleType()),
                                         (prefix + "ambiguous", T.BooleanType())], make, most=SLICE_CHARS)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the quarter of documents that learning must not see."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """The model of all labelled documents that are not held out."""
    return fit_languages(docs.where(~held_out(doc_id)), text, lang)


def language_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, ambiguous."""
    model = learn(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    found = identify(rows, model, "text", "p_")
    return found.select("doc_id", "held_out", F.col("p_pred").alias("lang_pred"), F.col("p_score").alias("score"),
                        F.col("p_ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without the documents whose language cannot be told (no letter, or no text).

    A model without languages tells none; then documents with a letter stay as well.
    """
    found = identify(docs, model, text, "language of the text: ")
    told = (F.col("`language of the text: pred`") != UNDETERMINED) | F.col(f"`{text}`").rlike(r"\p{L}")
    return found.where(told).select(*[F.col(f"`{c}`") for c in docs.columns])
