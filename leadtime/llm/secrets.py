"""Secret scan: one byte pass of a combined automaton over whole texts.

All rule patterns are compiled together (subset construction, minimisation) into one transition
array.  One pass over a text's UTF-8 bytes meets every position where a match of some rule can first
end; only there the rule's mirrored automaton finds the leftmost start and its own automaton the longest
end.  Matches are leftmost and do not overlap within a kind; a match that the rule's ``confirm``
pattern refuses is dropped without another try inside it.

Condition on rules: of two matches of one rule that overlap, the one that starts first also has
the first possible end (true of any keyword-then-value rule).  Defined results: a null text counts
as empty; repeated rows are scanned each for itself; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import compile_rules, earliest, parse, reverse
from .common import append_columns


class Rule(NamedTuple):
    kind: str
    pattern: str
    confirm: str | None = None  # must match the whole span


_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
BASE_RULES = (
    Rule("assign", _KEY + "+", _KEY + "{6,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),  # a shorter run is a match that would be dropped
)
MORE_RULES = (
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
         r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("map_key", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35,}"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """Compiled ``rules``; ``spans(text)`` lists (start, end, rule number) in code points."""

    def __init__(self, rules: Iterable[Rule] = RULES):
        self.rules = tuple(rules)
        trees = [parse(r.pattern) for r in self.rules]
        self.all = compile_rules([earliest(t) for t in trees], anywhere=True)
        self.forward = [compile_rules([t]) for t in trees]
        self.backward = [compile_rules([reverse(t)]) for t in trees]
        self.confirm = [compile_rules([parse(r.confirm)]) if r.confirm else None for r in self.rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(position after the byte, mask of rules with a match first ending there), in one pass."""
        table, s, first = self.all.table, self.all.start, self.all.first_accept
        found = []
        for i, b in enumerate(data, 1):
            if (s := table[s + b]) >= first:
                found.append((i, s))
        masks = self.all.accepts
        return [(i, masks[s >> 8]) for i, s in found]

    @staticmethod
    def _furthest(dfa, data: bytes, at: Iterable[int]) -> int:
        """How many steps along positions ``at`` the last accepting one is; 0 if none."""
        table, s, first, dead = dfa.table, dfa.start, dfa.first_accept, dfa.dead
        best = 0
        for n, i in enumerate(at, 1):
            s = table[s + data[i]]
            if s >= first:
                best = n
            elif s == dead:
                break
        return best

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        out = []
        done = [0] * len(self.rules)
        for end, mask in self.ends(data):
            k = 0
            while mask:
                if mask & 1 and end > done[k]:
                    back = self._furthest(self.backward[k], data, range(end - 1, done[k] - 1, -1))
                    if back:
                        start = end - back
                        stop = start + self._furthest(self.forward[k], data, range(start, len(data)))
                        done[k] = stop
                        c = self.confirm[k]
                        if c is None or self._whole(c, data[start:stop]):
                            out.append((start, stop, k))
                mask >>= 1
                k += 1
        return sorted(out, key=lambda x: (x[0], x[2]))

    @staticmethod
    def _whole(dfa, span: bytes) -> bool:
        s = dfa.start
        for b in span:
            s = dfa.table[s + b]
        return s >= dfa.first_accept

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        data = (text or "").encode("utf-8", "replace")
        found = self.byte_spans(data)
        if not found or data.isascii():
            return found
        out, at, chars = [], 0, 0
        place = {}
        for p in sorted({p for s, e, _ in found for p in (s, e)}):
            chars += len(data[at:p].decode("utf-8"))
            at, place[p] = p, chars
        for s, e, k in found:
            out.append((place[s], place[e], k))
        return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("kind", T.StringType())])


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", rules: Iterable[Rule] = RULES) -> DataFrame:
    """``docs`` with ``out``: all secret spans (start, end, kind) of each text by start, then rule order.

    Code points, end exclusive.  Null or empty text: no spans.  One pass, no shuffle.
    """
    rules = tuple(rules)

    def make():
        scanner = Scanner(rules)

        def work(texts):
            return [[[{"start": s, "end": e, "kind": rules[k].kind} for s, e, k in scanner.spans(t)] for t in texts]]
        return work
    return append_columns(docs, [text], [(out, T.ArrayType(SPAN))], make)


def mask_spans(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """``text`` with every maximal run of overlapping spans replaced by ``mark``."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for s, e in merged([(x["start"], x["end"]) for x in spans]):
        parts += [text[at:s], mark]
        at = e
    return "".join([*parts, text[at:]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redact_secrets(docs: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``[SECRET]`` and, if present, ``n_chars`` adjusted.

    No document is dropped; texts without secrets and null texts stay as they are.
    """
    found = "secret spans of " + text  # a name that no table has
    scanned = scan_secrets(docs, text, found, rules)

    def make():
        return lambda texts, spans: [[mask_spans(t, s) for t, s in zip(texts, spans, strict=True)]]
    dirty = F.size(F.col(f"`{found}`")) > 0
    masked = append_columns(scanned, [text, found], [("masked " + text, docs.schema[text].dataType)], make)
    new = F.when(dirty, F.col(f"`masked {text}`")).otherwise(F.col(f"`{text}`"))
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(new.alias(c))
        elif c == "n_chars":
            cols.append(F.when(dirty, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return masked.select(*cols)


def secret_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans and all spans as text."""
    kinds = [r.kind for r in BASE_RULES]
    found = scan_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "secrets")
    as_text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secrets", lambda x: x["kind"].isin(kinds))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in kinds],
                        F.sha2(F.array_join(F.transform(base, as_text), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("secrets", as_text), ",").alias("spans"))
