import random
import re

import numpy as np
from brute import edit_distance_within

from leadtime.llm import decontaminate as D


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def make_items(rng, vocab, n, low=8, high=50):
    return [" ".join(rng.choices(vocab, k=rng.randrange(low, high))) for _ in range(n)]


VOCAB = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(300)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = "zz" + str(rng.randrange(99))
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, "yy" + str(rng.randrange(99)))
    return words


def test_words_are_positions_of_the_text():
    t = "Ab, éÀ x_9 漢字 İ!\n" + "a" * 700
    h, owner, start, end = D.words([None, t, ""])
    assert set(owner.tolist()) == {1}
    got = [t[s:e] for s, e in zip(start, end)]
    assert got == ["Ab", "éÀ", "x", "9", "漢", "字", "İ", "a" * 700]
    assert D.words(["AB"])[0][0] == h[0] and len(set(h.tolist())) == len(h)


def test_closest_equals_plain_edit_distance():
    rng = random.Random(8)
    for _ in range(300):
        item, text = rng.choices("abcd", k=rng.randrange(1, 8)), rng.choices("abcd", k=rng.randrange(1, 20))
        edits, s, e = D.closest(np.array([ord(c) for c in item]), np.array([ord(c) for c in text]))
        assert edits == edit_distance_within(item, text)
        assert edit_distance_within(item, text[s:e]) == edits and 0 <= s <= e <= len(text)


def test_recall_of_edited_passages_and_no_false_leak():
    rng = random.Random(9)
    items = make_items(rng, VOCAB, 150)
    index = D.Index([D.words([t])[0] for t in items], D.Plan(), 2)
    found = wanted = 0
    for share in (0.0, 0.1, 0.2):
        texts = []
        for t in items:
            w = t.split()
            texts.append(" ".join(rng.choices(VOCAB, k=rng.randrange(70)) + edited(rng, w, int(share * len(w))) + rng.choices(VOCAB, k=rng.randrange(70))))
        for k, rows in enumerate(D.leaks_in(texts, index)):
            got = {r[0]: r for r in rows}
            words = tokens(texts[k])
            for i, r in got.items():
                item = tokens(items[i])
                assert r[1] == edit_distance_within(item, words) and r[2] >= 0.8
                assert edit_distance_within(item, tokens(texts[k][r[3]:r[4]])) == r[1]
            own = tokens(items[k])
            if edit_distance_within(own, words) <= 0.2 * len(own):
                wanted += 1
                found += k in got
    assert wanted > 300 and found >= 0.97 * wanted


def test_query_finds_exactly_the_planted_leaks(spark, sf):
    from leadtime.llm.catalog import QUERIES
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    want = set()
    for d in docs:
        words = tokens(d.text)
        have = set(words)
        for i in items:
            item = tokens(i.text)
            most = int(0.2 * len(item) + 1e-9)
            if len(item) >= D.MIN_WORDS and sum(w in have for w in item) >= len(item) - most and edit_distance_within(item, words) <= most:
                want.add((d.doc_id, i.item_id))
    assert {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, sf).collect()} == want and want


def test_odd_rows_blocks_and_empty_tables(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, "too short"),
                                   (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    extra = spark.createDataFrame([(20, "x ONE, two-three four five six seven!", None, None, None), (20, "x ONE, two-three four five six seven!", None, None, None),
                                   (21, "alpha beta gamma delta epsilon zeta", None, None, None)], odd_docs.schema)
    docs = odd_docs.unionByName(extra).withColumnRenamed("lang", "leaks")
    for block in (2000, 1):
        monkeypatch.setattr(D, "BLOCK_ITEMS", block)
        got = sorted((r.doc_id, str(r.item_id), r.edits) for r in D.leak_rows(docs, bench).collect())
        assert got == [(20, "1", 0)] * 4 + [(21, "None", 0)]
    assert D.leak_rows(no_docs, bench).count() == 0 and D.leak_rows(docs, bench.limit(0)).count() == 0
    kept = D.without_leaks(odd_docs.unionByName(extra), bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_every_length_is_found_whatever_its_block():
    rng = random.Random(21)
    lengths = [n for n in (5, 6, 7, 8, 9, 10, 11, 14, 15, 19, 20, 24, 30, 45, 60) for _ in range(40)]
    items = [" ".join(rng.choices(VOCAB, k=n)) for n in lengths]
    hashes = [D.words([t])[0] for t in items]
    wanted, found = {}, {}
    for low in (0, 16):                                     # a block with short items, and one without
        own = [k for k, n in enumerate(lengths) if n >= low]
        stride = max(1, min(D.STRIDE, min(lengths[k] for k in own) // 4))       # as find_leaks takes it
        index = D.Index([hashes[k] for k in own], D.Plan(), stride)
        for share in (0.0, 0.2):
            texts = [" ".join(rng.choices(VOCAB, k=rng.randrange(70)) + edited(rng, items[k].split(), int(share * lengths[k] + 1e-9))
                              + rng.choices(VOCAB, k=rng.randrange(70))) for k in own]
            for k, text, rows in zip(own, texts, D.leaks_in(texts, index), strict=True):
                edits = edit_distance_within(tokens(items[k]), tokens(text))
                if edits <= int(0.2 * lengths[k] + 1e-9):
                    at = (low, lengths[k], share)
                    wanted[at] = wanted.get(at, 0) + 1
                    found[at] = found.get(at, 0) + any((own[r[0]], r[1]) == (k, edits) for r in rows)
    assert found == wanted and all(n == 40 for n in wanted.values()), {k: (found[k], n) for k, n in wanted.items() if found[k] < n}


def test_item_that_outlasts_a_text_on_both_sides():
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"
    for stride in (1, 4):
        index = D.Index([D.words([item])[0]], D.Plan(), stride)
        rows = D.leaks_in(["some other words", "b2 c3 d4 e5 f6 g7 h8 i9", "more words here"], index)
        assert [[(r[0], r[1]) for r in x] for x in rows] == [[], [(0, 2)], []]


def test_match_at_the_end_is_not_taken_for_one_seen_before():
    item = "a b c d e f g h i j".split()
    index = D.Index([D.words([" ".join(item)])[0]], D.Plan(), 4)
    rng = random.Random(4)
    for _ in range(400):
        text = rng.choices(item, k=rng.randrange(6)) + item[:rng.randrange(10)] + rng.choices(item, k=rng.randrange(5)) + item[rng.randrange(3):]
        want = edit_distance_within(item, text)
        assert [r[1] for r in D.leaks_in([" ".join(text)], index)[0]] == ([want] if want <= 2 else [])
