import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from leadtime.llm import collocations as C


def slow(rows, shortest=2, longest=3, min_count=10, top=2000, cover=50):
    """By the contract: rows (lang, text) -> rows of the result."""
    f, size = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) >= shortest and a >= min_count}
        kept = []
        for p, a in cand.items():
            inside = [b for q, b in cand.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= cover * a for b in inside):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, size[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "delta", "ÉTÉ", "été", "x\xa0y", "zeta", "new", "york", "city", "hall", "\x1f", "und"]
    seps = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b", " ! "]
    docs = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice(seps) for w in words) + rng.choice(["", "new york city hall", "New York", "beta beta beta beta"])
        docs.append((i, rng.choice(["en", "de", None]), text))
    return docs


@pytest.mark.parametrize("rate,count", [(0.3, 2), (0.02, 5), (1.0, 1)])
def test_equals_brute_force_whatever_the_sample(spark, rate, count):
    docs = corpus(700)
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(5)
    got = rows_of(C.collocations(df, rate=rate, sample_count=count))
    want = slow([(x, t) for _, x, t in docs])
    assert len(want) > 50 and got == want


def test_a_full_small_filter_changes_nothing(spark, monkeypatch):
    """All bits set: every phrase is taken for a member, and counted in the first pass."""
    docs = corpus(120, 2)
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    assert rows_of(C.collocations(df, most_bits=64, min_count=4)) == slow([(x, t) for _, x, t in docs], min_count=4)


def test_border_failures_are_counted_in_further_passes(spark):
    """An empty sample: every frequent phrase is a failure of the border first."""
    docs = [(i, "en", "one two three four") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    found = {r["phrase"]: r["n"] for r in C.frequent_phrases(df, 4, rate=0.0001, sample_count=1000).collect()}
    assert found == {"": 120} | dict.fromkeys(["one", "two", "three", "four", "one two", "two three", "three four", "one two three",
                                               "two three four", "one two three four"], 30)


def test_longer_phrases_and_other_limits(spark):
    docs = corpus(100, 3)
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    for kw in (dict(longest=4, min_count=3), dict(longest=2, min_count=5), dict(shortest=3, longest=4, min_count=3, cover=80), dict(top=7)):
        assert rows_of(C.collocations(df, **kw)) == slow([(x, t) for _, x, t in docs], **kw), kw
    assert rows_of(C.collocations(df, top=None)) == slow([(x, t) for _, x, t in docs], top=10**9)


def test_products_past_64_bits(spark):
    one, many = "a b. " * 40, 3
    df = spark.createDataFrame([(1, "en", one)] * many, "doc_id long, lang string, text string")
    assert rows_of(C.collocations(df)) == [("en", 1, "a b", 120, 120, 120, 240, 1_000_000)]
    big = spark.createDataFrame([(4_000_000_000, 5_000_000_000, 6_000_000_000)], "a long, l long, r long").selectExpr(
        "(cast(a as decimal(38,0)) * cast(a as decimal(38,0)) * 1000000) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as s").first()["s"]
    assert big == 10**6 * 4_000_000_000**2 // (5_000_000_000 * 6_000_000_000)


def test_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.withColumnRenamed("source", "phrase").withColumnRenamed("n_chars", "n")
    want = slow([(r["lang"], r["text"]) for r in odd_docs.collect()])
    assert rows_of(C.collocations(df)) == want and want
    assert C.collocations(no_docs).count() == 0
    assert rows_of(C.collocations(odd_docs.where("doc_id in (1, 2, 3)"))) == []


def test_hashes_of_slices_and_of_phrases_agree():
    words = [b"new", b"york", "été".encode()]
    h = C.word_hashes("en", words)
    with np.errstate(over="ignore"):
        two = C._mix(h[:1], h[1:2])
        three = C._mix(two, h[2:3])
    got = C.phrase_hashes(["en", "en", "en", "de", "en"], ["new york", "new", "new york été", "new", "york"])
    assert got.tolist() == [two[0], h[0], three[0], C.word_hashes("de", words)[0], h[1]] and got[3] != got[1]
    assert len(C.phrase_hashes([], [])) == 0


def test_slices_hold_one_language_and_every_word(spark, monkeypatch):
    """Texts of mixed languages come as full slices of one language; a text alone may be longer than a slice."""
    docs = [(i, x, t) for i, x, t in corpus(300, 8) if x] + [(1000, "en", "very long " * 400)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").select("lang", "text").coalesce(1)
    monkeypatch.setattr(C, "SLICE_BYTES", 2000)
    monkeypatch.setattr(C, "HELD_BYTES", 8000)
    got = {"en": [], "de": []}
    for r in C.word_slices(df).collect():
        words, ids = bytes(r["words"]).split(b" "), np.frombuffer(r["ids"], C._number_type(1))
        got[r["lang"]].append([words[i] for i in ids if i])
    for lang, some in got.items():
        own = [t for _, x, t in docs if x == lang]
        assert [w for s in some for w in s] == [w for w in C.words_of(own) if w != b"."]
        assert len(some) <= 2 + sum(map(len, own)) // 1000
    assert rows_of(C.collocations(spark.createDataFrame(docs, "doc_id long, lang string, text string"))) == slow([(x, t) for _, x, t in docs])


def test_many_words_need_no_wide_numbers():
    """Rows of numbers are told apart whether or not they fit one number; more than 65,536 words have wider numbers."""
    words, ids = C.numbered_words([" ".join(str(i) for i in range(70_000))])
    assert [words[i] for i in ids] == [str(i).encode() for i in range(70_000)]
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 5, 200) for _ in range(3)]
    for n_words in (5, 1 << 30):
        at, n = C._distinct(words, n_words)
        got = dict(zip(zip(*[a.tolist() for a in at], strict=True), n.tolist(), strict=True))
        assert got == dict(Counter(zip(*[w.tolist() for w in words], strict=True)))


def test_query_equals_brute_force_and_sql(spark, sf):
    from leadtime.llm.catalog import ORACLE, QUERIES
    got = rows_of(QUERIES["op13_collocations"](spark, sf))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got == slow(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(con.execute(ORACLE["op13_collocations"]).fetchall()) == got
