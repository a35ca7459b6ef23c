import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from leadtime.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def originals(rows):
    """{conv_id: [(role, text)]}; ties of a turn go by the digest of role and text."""
    out = {}
    def tie(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c in {r[0] for r in rows if r[0] is not None}:
        mine = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c]
        mine.sort(key=lambda t: (t[0] is not None, t[0] or 0, tie(t[1], t[2])))
        out[c] = [t[1:] for t in mine]
    return out


def rebuild(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def slow(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in below)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLS).collect()), key=str)


def made(n=260, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.choice([i, i - 120])
        for t in range(rng.randrange(9)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "hi", "é𝄞", "go on", f"w{i}"])))
    rows += [(700, t, "user", "same") for t in range(45)] + [(701, t, "user", "same") for t in range(60)]
    rows += [(None, 1, "user", "no id"), (5, 1, "user", "twice"), (5, 1, "user", "twice")]
    return rows


def test_equals_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, c int").repartition(6)
    convs = originals(rows)
    assert rows_of(trie.conversation_trie(df)) == slow(convs)
    want = slow(rebuild(convs))
    assert len(want) > 400 and rows_of(trie.rebuilt_trie(df)) == want


def test_long_and_equal_conversations(spark, monkeypatch):
    """Chains of hundreds of turns, many equal conversations, ids hashed in many pieces."""
    monkeypatch.setattr(trie, "CHUNK_IDS", 7)
    rows = [(1, t, "user", "same") for t in range(300)] + [(2, t, "user", "same" if t < 150 else "other") for t in range(300)]
    rows += [(c, t, "user", "again") for c in range(100, 260) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert rows_of(trie.conversation_trie(df)) == slow(originals(rows))


def test_turnless_conversations_and_empty_tables(spark):
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "only turn")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(trie.rebuilt_trie(df))
    assert got == slow(rebuild(originals(rows))) and len(got) == 1 and got[0][1] == 0
    assert trie.rebuilt_trie(df.where("false")).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_subtree_totals_of_any_forest(spark):
    rng = random.Random(4)
    up = {i: None if i < 3 else rng.choice([i - 1, i - 1, i - 1, rng.randrange(i), 0]) for i in range(400)}
    value = {i: (rng.randrange(10), 1) for i in up}
    tree = spark.createDataFrame([(i, p, *value[i]) for i, p in up.items()], "key long, parent long, v long, w long").repartition(5)
    want = {i: list(value[i]) for i in up}
    for i in sorted(up, reverse=True):
        if up[i] is not None:
            want[up[i]][0] += want[i][0]
            want[up[i]][1] += want[i][1]
    got = {r["key"]: [r["v"], r["w"]] for r in trie.subtree_totals(tree, ["v", "w"]).collect()}
    assert got == want
    assert trie.subtree_totals(tree.where("false"), ["v", "w"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_a_single_chain(spark, n):
    tree = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(n)], "key long, parent long, v long")
    got = {r["key"]: r["v"] for r in trie.subtree_totals(tree, ["v"]).collect()}
    assert got == {i: sum(range(i, n)) for i in range(n)}


def test_running_sums_over_borders(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id")
    got = trie.running_sums(df.repartition(4), "g", ["id"], {"pos": F.lit(1).cast("long"), "total": F.col("id")}).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["id"]):
        n, s = seen.get(r["g"], (0, 0))
        seen[r["g"]] = (n + 1, s + r["id"])
        assert (r["pos"], r["total"]) == seen[r["g"]]
    assert len(got) == 5000


def test_query_equals_brute_force_and_sql(spark, sf):
    from leadtime.llm.catalog import ORACLE, QUERIES
    got = rows_of(QUERIES["op11_conversation_trie"](spark, sf))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == slow(rebuild(originals(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    assert sorted(con.execute("SELECT " + ", ".join(COLS) + " FROM (" + ORACLE["op11_conversation_trie"] + ")").fetchall(), key=str) == got
