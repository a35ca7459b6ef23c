"""Token counts by field or section: encode whole texts once, then share out the tokens by their place.

Every token has a span of characters (a token that begins or ends inside a character covers it).
Token spans meet section spans in one sorted interval join.  A token within one section counts
there.  A token across a border goes, whole, to the section that ``rule`` names:

* ``majority``: the one with most of its characters, the first of equals;
* ``start``: the one that holds its first character that lies in any section.

Tokens outside all sections (gaps) are counted in a row without a section number.  Counts of a text
always add up to its number of tokens.  Sections are taken by start; one that overlaps the one
before begins where that ends.  Null texts count as empty and have what sections an empty text has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SLICE_BYTES, MergeReplay, _shipped, coder
from .common import append_columns

Spans = list[tuple[int, int]]


def line_spans(text: str) -> Spans:
    """Lines with their line ends; the empty text is one empty line."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def token_spans(c: MergeReplay, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in code points."""
    stop = np.cumsum(c.token_len[ids])
    start = stop - c.token_len[ids]
    if text.isascii():
        return start, stop
    lead = (np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    return char[start], char[stop - 1] + 1


def share_out(start: np.ndarray, end: np.ndarray, sections: Spans, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens of none)."""
    if not sections:
        return np.zeros(0, np.int64), len(start)
    order = sorted(range(len(sections)), key=lambda i: sections[i])
    lo = np.array([sections[i][0] for i in order])
    hi = np.maximum.accumulate(np.array([sections[i][1] for i in order]))
    lo[1:] = np.maximum(lo[1:], hi[:-1])
    full = np.flatnonzero(hi > lo)  # empty sections hold nothing
    lo, hi = lo[full], hi[full]
    first = np.searchsorted(hi, start, "right")
    last = np.searchsorted(lo, end, "left") - 1
    inside = first <= last
    to = np.where(inside, first, 0)
    if rule == "majority":
        for t in np.flatnonzero(last > first).tolist():
            k = np.arange(first[t], last[t] + 1)
            to[t] = k[np.argmax(np.minimum(hi[k], end[t]) - np.maximum(lo[k], start[t]))]
    elif rule != "start":
        raise ValueError(f"unknown rule {rule!r}")
    counts = np.zeros(len(sections), np.int64)
    counts[np.array(order)[full]] = np.bincount(to[inside], minlength=len(full))
    return counts, int((~inside).sum())


COUNT = T.StructType([T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()),
                      T.StructField("end", T.LongType()), T.StructField("n_tokens", T.LongType())])


def count_by_section(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "sections",
                     sections: Callable[[str], Spans] = line_spans, rule: str = "majority",
                     keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: per section (section, start, end, n_tokens), and a row without a section number
    for tokens in none, if any.  One pass, no shuffle."""
    ranks = _shipped(docs, path)

    def make():
        c = coder(ranks.value, pattern)

        def work(texts):
            result = []
            for t, ids in zip(texts, c.encode(texts), strict=True):
                t = t or ""
                spans = sections(t)
                counts, rest = share_out(*token_spans(c, t, ids), spans, rule)
                row = [(k, s, e, n) for k, ((s, e), n) in enumerate(zip(spans, counts.tolist(), strict=True))]
                result.append([*row, (None, None, None, rest)] if rest else row)
            return [result]
        return work
    return append_columns(docs, [text], [(out, T.ArrayType(COUNT))], make, keep, SLICE_BYTES)


def count_by_field(docs: DataFrame, fields: list[str], path: str, pattern: str, out: str = "fields",
                   rule: str = "majority") -> DataFrame:
    """``docs`` with ``out``: tokens of each of ``fields`` when the fields, joined by line ends, are encoded as
    one text; section ``k`` is ``fields[k]``.  Null fields count as empty; joints belong to no field."""
    if not fields:
        raise ValueError("no fields")
    joined = F.concat_ws("\n", *[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields])
    lengths = F.array(*[F.coalesce(F.length(F.col(f"`{f}`").cast("string")), F.lit(0)) for f in fields])
    ranks = _shipped(docs, path)
    src = docs.withColumns({"joined fields": joined, "lengths of fields": lengths})

    def make():
        c = coder(ranks.value, pattern)

        def work(texts, sizes):
            result = []
            for t, n, ids in zip(texts, sizes, c.encode(texts), strict=True):
                at = np.cumsum([0, *[x + 1 for x in n]])
                spans = [(int(a), int(a) + x) for a, x in zip(at[:-1], n, strict=True)]
                counts, rest = share_out(*token_spans(c, t, ids), spans, rule)
                row = [(k, s, e, m) for k, ((s, e), m) in enumerate(zip(spans, counts.tolist(), strict=True))]
                result.append([*row, (None, None, None, rest)] if rest else row)
            return [result]
        return work
    return append_columns(src, ["joined fields", "lengths of fields"], [(out, T.ArrayType(COUNT))], make, docs.columns,
                          SLICE_BYTES)


def line_table(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line of each document row: doc_id, section, start, end, n_tokens."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = count_by_section(src, path, pattern, keep=["doc_id"])
    return found.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*")
