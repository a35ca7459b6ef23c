import hashlib
import random

import pytest
import public_tokenizers as P
import tiktoken

from leadtime.llm import attribution, bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.MergeReplay(RANKS, P.PATTERN)


def random_text(rng):
    kind = rng.random()
    if kind < .4:
        blocks = [(32, 127), (0, 0x250), (0x370, 0x3000), (0x4e00, 0x9fff), (0x1f300, 0x1f6ff)]
        return "".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(rng.randrange(80)))
    if kind < .7:
        return "".join(rng.choice("aab thein  \n\t0129'st") for _ in range(rng.randrange(200)))
    return "".join(rng.choice(["\x1c", "\x85", " ", " ", "\n", "é", "a", "²", "Ⅷ", "aaaa"]) for _ in range(rng.randrange(60)))


def test_ids_equal_the_library_and_round_trip(coder, monkeypatch):
    rng = random.Random(6)
    texts = [random_text(rng) for _ in range(3000)] + ["a" * 5000, "ha" * 3000, " " * 2000, ""]
    for ids, t in zip(coder.encode(texts), texts, strict=True):
        assert ids.tolist() == REFERENCE.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()
    monkeypatch.setattr(bpe, "WORDS_KEPT", 10)  # a table that is forgotten changes nothing
    assert [x.tolist() for x in coder.encode(texts[:50])] == [REFERENCE.encode_ordinary(t) for t in texts[:50]]
    assert [x.tolist() for x in coder.encode(texts[50:90])] == [REFERENCE.encode_ordinary(t) for t in texts[50:90]]


def test_unknown_ids_and_vocabularies_are_refused(coder):
    import numpy as np
    with pytest.raises(ValueError):
        coder.decode(np.array([60000], np.uint32))
    with pytest.raises(ValueError):
        bpe.MergeReplay({b"a": 0}, P.PATTERN)


def test_query_equals_the_library(spark, sf):
    from leadtime.llm.catalog import QUERIES
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op8_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = REFERENCE.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = bpe.bpe_digest(odd_docs.withColumnRenamed("lang", "ids"), PATH, P.PATTERN).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert bpe.bpe_digest(no_docs, PATH, P.PATTERN).count() == 0
    assert {r.n_tokens for r in bpe.checked_ids(odd_docs, PATH, P.PATTERN).collect()} == {r.n_tokens for r in rows}


def slow_counts(t, rule="majority"):
    """Tokens of each line of ``t``, from the library's ids."""
    lines = attribution.line_spans(t)
    counts, at = [0] * len(lines), 0
    data = t.encode()
    for i in REFERENCE.encode_ordinary(t):
        n = len(REFERENCE.decode_single_token_bytes(i))
        start = len(data[:at].decode("utf-8", "ignore"))
        end = len(data[:at + n].decode("utf-8", "ignore")) + (len(data[:at + n].decode("utf-8", "ignore").encode()) < at + n)
        share = [min(e, end) - max(s, start) for s, e in lines]
        best = max(range(len(lines)), key=lambda k: (share[k], -k)) if rule == "majority" else next(k for k, x in enumerate(share) if x > 0)
        counts[best] += 1
        at += n
    return counts


@pytest.mark.parametrize("rule", ["majority", "start"])
def test_line_counts(coder, rule):
    rng = random.Random(7)
    for t in ["a\n\n\n\nb", "\n\n", "", "é\n 😀 x\n\n  y", *("".join(rng.choices(["a", "the ", "\n", " ", "é", "😀"], k=30)) for _ in range(300))]:
        ids = coder.encode([t])[0]
        counts, rest = attribution.share_out(*attribution.token_spans(coder, t, ids), attribution.line_spans(t), rule)
        assert counts.tolist() == slow_counts(t, rule) and rest == 0, repr(t)


def test_gaps_overlaps_and_unknown_rules(coder):
    t = "one two three four"
    spans = attribution.token_spans(coder, t, coder.encode([t])[0])
    counts, rest = attribution.share_out(*spans, [(8, 18), (0, 3), (2, 8)], "majority")
    assert counts.sum() + rest == len(spans[0]) and rest == 0
    counts, rest = attribution.share_out(*spans, [(0, 3)], "majority")
    assert counts.tolist() == [1] and rest == len(spans[0]) - 1
    with pytest.raises(ValueError):
        attribution.share_out(*spans, [(0, 3), (3, 6)], "other")


def test_line_table_covers_every_row(spark, sf, odd_docs, no_docs):
    from leadtime.llm.catalog import QUERIES
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {}
    for r in QUERIES["op10_token_counts"](spark, sf).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert got == {i: slow_counts(t or "") for i, t in texts.items()}
    odd = attribution.line_table(odd_docs.withColumnRenamed("lang", "section"), PATH, P.PATTERN)
    assert odd.where("doc_id = 1").collect()[0].n_tokens == 0 and odd.where("doc_id = 5").count() == 2
    assert attribution.line_table(no_docs, PATH, P.PATTERN).count() == 0


def test_fields(spark):
    df = spark.createDataFrame([("A title", "Body text\nmore"), (None, "x"), (None, None)], "title string, fields string")
    rows = attribution.count_by_field(df.withColumnRenamed("fields", "body"), ["title", "body"], PATH, P.PATTERN).collect()
    for r in rows:
        t = "\n".join([r.title or "", r.body or ""])
        assert sum(f.n_tokens for f in r.fields) == len(REFERENCE.encode_ordinary(t))
        assert [f.section for f in r.fields][:2] == [0, 1]
