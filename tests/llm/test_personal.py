import hashlib
import math
import random
import re

from brute import joined, personal_spans

from leadtime.llm import personal as P


def check(df):
    rows = P.personal_digest(df).collect()
    texts = {}
    for r in df.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, r.text)
    assert len(rows) == df.count()
    for r in rows:
        want = personal_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in want) for k in range(4)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), texts[r.doc_id]
        base = [s for s in r.spans.split(",") if s and not s.startswith("context")]
        assert ",".join(base) == joined(want)
    return rows


def test_query_equals_brute_force_on_base_spans(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_random_texts_and_long_runs(spark):
    rng = random.Random(12)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", "256.1.1.1", "4026537531562331", "4111 1111 1111 1111", "+1 (277) 555-1865", "+", "@", ".", "-", " ", "12", "3",
             "é", "😀", "x", "@@", "..", "(", ")", "0001.2.3.4", "\n", "9" * 22 + ".1.1.1"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randrange(15)))) for k in range(1500)]
    rows += [(9000, "a" * 50000), (9001, "1" * 50000), (9002, "1." * 20000), (9003, "a@" + "b." * 20000), (9004, "+1" + " " * 40000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = check(odd_docs.withColumnRenamed("lang", "n_email"))
    assert len(rows) == 10 and P.personal_digest(no_docs).count() == 0


def test_contexts_lead_to_unseen_identifiers(spark):
    texts = [f"please call me at +1 277 555 18{k:02d} today" for k in range(10, 20)]
    texts += ["please call me at ext-277-77 today", "the bill was no-277-77 then", "some words without any number"]
    found = {r.doc_id: r.spans for r in P.personal_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(found[k].startswith("phone:18:") for k in range(10))
    assert found[10] == "context:18:28" and found[11] == "" and found[12] == ""


def test_scores_of_a_small_graph(spark):
    rows = [("a", True, "p"), ("b", True, "p"), ("c", True, "p"), ("d", False, "p"), ("d", False, "q"), ("e", False, "q"), ("a", True, "p")]
    patterns, values = P.bootstrap(spark.createDataFrame(rows, "value string, known boolean, pattern string"), rounds=1)
    assert {r.pattern: r.confidence for r in patterns.collect()} == {"p": 0.75, "q": 0.0}
    got = {r.value: round(r.score, 9) for r in values.collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.75, "e": 0.0}


def near(c):
    return re.sub("[0-9]", "0", c.lower())


def slow_occurrences(t):
    """(start, end, value, known, patterns) by the definition: contexts are read from the text around each span."""
    def patterns(start, end):
        m = re.search(r"((?:\S+\s+)?\S+)\s*$", t[max(0, start - 80):start], re.A)
        before = near(m[1]) if m else ""
        m = re.match(r"\s*(\S+)", t[end:end + 80], re.A)
        after = near(m[1]) if m else ""
        out = {before + " _"} if re.search(r"\S\s+\S", before, re.A) else set()
        return out | ({before.split()[-1] + " _ " + after} if before and after else set())
    seeds = personal_spans(t)
    out = [(s, e, t[s:e].lower(), True, patterns(s, e)) for s, _, e, _ in seeds]
    for m in re.finditer(r"\s[^\s0-9@]*[0-9@]\S*", " " + t, re.A):
        word, at = m[0], m.start() - 1
        a = len(re.match(r"[\s\"'(\[<{,;:=]*", word, re.A)[0])
        b = len(re.search(r"[\"')\]>},;:.!?]*$", word, re.A)[0])
        s, e = at + a, at + a + max(len(word) - a - b, 0)
        value = t[s:e]
        if len(value) >= P.MIN_CHARS and re.search("@|[0-9][^0-9]*[0-9]", value) and not any(x[0] < e and s < x[2] for x in seeds):
            out.append((s, e, value.lower(), False, patterns(s, e)))
    return out


def slow_spans(texts):
    """{text: all spans as text}, by scoring the graph over all distinct texts."""
    found = {t: slow_occurrences(t) for t in texts}
    known, links = {}, set()
    for occ in found.values():
        for _, _, value, sure, patterns in occ:
            known[value] = known.get(value, False) or (sure and bool(patterns))
            links |= {(p, value) for p in patterns}
    score = {v: float(known[v]) for _, v in links}
    for _ in range(P.ROUNDS):
        confidence = {}
        for p in {p for p, _ in links}:
            of = [v for q, v in links if q == p]
            confidence[p] = sum(score[v] for v in of) / len(of) if sum(known[v] for v in of) >= P.SUPPORT else 0.0
        for v in score:
            doubt = sum(math.log(max(1 - confidence[p], 1e-9)) for p, u in links if u == v)
            score[v] = 1.0 if known[v] else 1 - math.exp(doubt)
    out = {}
    for t, occ in found.items():
        spans = [(s, r, e, k) for s, r, e, k in personal_spans(t)]
        spans += {(s, 4, e, "context") for s, e, v, sure, ps in occ if not sure and not known[v] and score.get(v, 0) >= P.INSTANCE
                  and any(confidence[p] >= P.PATTERN for p in ps)}
        out[t] = joined(sorted(spans))
    return out


def test_discovery_equals_brute_force(spark):
    rng = random.Random(8)
    lead = ["room 12 code", "room 14 code", "call \"", "mail", "id no.", "on 3rd of", "ref:", "é 7"]
    value = ["+1 277 555 18{:02d}", "ext-277-{:02d}", "AB-12{:02d}", "a{}@b.org", "10.0.0.{}", "(X9-88{:02d}),", "1234-56-{:02d}", "{:02d}"]
    tail = ["today", "\" then 5", ", ok", "", "\n99 more", "room 12 code"]
    texts = []
    for _ in range(500):
        t = ""
        for _ in range(rng.randrange(5)):
            t += f"{rng.choice(lead)} {rng.choice(value).format(rng.randrange(40))} {rng.choice(tail)} "
        texts.append(t)
    texts += texts[:40] + ["x " * 200 + "code " + "room 12 code ZZ-9911 today", "", "no number at all"]
    want = slow_spans(set(texts))
    rows = P.personal_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum("context" in s for s in want.values()) > 30
    for r in rows:
        assert r.spans == want[texts[r.doc_id]], texts[r.doc_id]


def test_a_context_with_digits_leads_to_an_identifier(spark):
    texts = [f"room 12 code +1 277 555 18{k} now" for k in range(10, 20)] + ["room 14 code AB-1234 then"]
    found = {r.doc_id: r.spans for r in P.personal_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[10] == "context:13:20"
