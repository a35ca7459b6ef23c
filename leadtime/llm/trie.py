"""Prefix trie of conversations, and totals of every subtree by parallel tree contraction.

Nodes: a node is a distinct sequence of first turns.  A prefix is named by its length and the sums of
position-bound digests of its turns (SHA-256, four parts of 32 bits), which are running sums; so a trie of any
depth takes two passes of running sums and one grouping, not one join a level.  Running sums are taken over a
range partitioning of (conversation, turn), so one very long conversation is spread over many tasks.  Texts
are read once; only digests and lengths are shuffled.

Contraction: each round (a few joins, each written to the shared folder)
* compresses: in chains of nodes with one child, pointers double until each names the first node below its
  chain; the chain's own values go to the node above it and the chain leaves the tree;
* rakes: the leaves' values, now totals, are added to their parents and the leaves leave the tree.
Without chains every inner node has two children or more, so a round at least halves the tree.  When nothing
is left, compressed nodes are re-expanded, last round first: chain sum plus the total of the node below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PARTS = 4                   # parts of 32 bits in the name of a prefix
CHUNK_IDS = 4096            # ids joined in one row before they are hashed
GROUP = 100                 # conversations that share the first one's turns
MOST_SHARED = 6             # shared turns are 0 to MOST_SHARED - 1
NO_IDS = hashlib.sha256(b"").hexdigest()


def running_sums(df: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (this row included) of expressions in the order of each group.

    Rows are range-partitioned by group and order; each piece of a group in a partition is summed for itself,
    and only groups that cross a border get an offset (two a border at most, so they are broadcast).
    """
    keys = [group, *order]
    placed = cut_lineage(df.withColumns({f"_{n}": e for n, e in sums.items()}).repartitionByRange(*keys)
                         .sortWithinPartitions(*keys)
                         .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranged")
    pieces = placed.groupBy(group, "_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    crossing = pieces.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.join(crossing, group, "left_semi")
               .select(group, "_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_o{n}") for n in sums]))
    here = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(*df.columns, "_part", *[F.sum(f"_{n}").over(here).alias(f"_{n}") for n in sums])
    out = local.join(F.broadcast(offsets), [group, "_part"], "left")
    return out.select(*df.columns, *[(F.col(f"_{n}") + F.coalesce(F.col(f"_o{n}"), F.lit(0))).alias(n) for n in sums])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, content, chars): place of each turn in its conversation from 1, digest of role and text, code points.

    Null role or text is empty.  Turns go by ``turn``, null first, ties by the digest.  Rows without a conv_id
    belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.encode(F.concat(F.char_length(role), F.lit(":"), role, text), "utf-8"), 256).alias("content"),
        F.char_length(text).cast("long").alias("chars"))
    return running_sums(rows, "c", ["turn", "content"], {"pos": F.lit(1).cast("long")}).drop("turn")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations whose first turns come from the first conversation of their hundred.

    Conversation c gets the first h turns of conversation c - c % GROUP (fewer if that has fewer, none if it is
    absent) before its own turns after the h-th; h is the CRC-32 of the decimal c, modulo MOST_SHARED.
    """
    c = F.col("c")
    lengths = cut_lineage(turns.groupBy("c").agg(F.max("pos").alias("own"))
                          .withColumns({"h": F.crc32(c.cast("string").cast("binary")) % MOST_SHARED, "b": c - c % GROUP}), "own")
    first = turns.where((c % GROUP == 0) & (F.col("pos") < MOST_SHARED)).select(
        c.alias("b"), "pos", "content", "chars")
    shared = lengths.where("own > 0").join(lengths.select(F.col("c").alias("b"), F.col("own").alias("given")), "b", "left") \
        .select("c", "h", "b", "own", F.least("h", F.coalesce("given", F.lit(0))).alias("m"))
    shared = cut_lineage(shared, "shared")
    front = shared.where("m > 0").join(first, "b").where("pos <= h").select("c", "pos", "content", "chars")
    rest = turns.join(shared.select("c", "h", "m"), "c").where("pos > h").select(
        "c", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "content", "chars")
    n = (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")
    return front.unionByName(rest), shared.select("c", n)


def turn_lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("c").agg(F.max("pos").alias("n_turns"))


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])))


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, pos, chars, key, parent): the prefix of each conversation that ends with each of its turns."""
    digest = F.sha2(F.concat_ws(":", "pos", "content"), 256)
    part = [F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long") for i in range(PARTS)]
    cut = turns.withColumn("d", digest).select("c", "pos", "chars", *[p.alias(f"p{i}") for i, p in enumerate(part)])
    summed = running_sums(cut, "c", ["pos"], {f"s{i}": F.col(f"p{i}") for i in range(PARTS)})
    return summed.select("c", "pos", "chars", _name(F.col("pos"), [F.col(f"s{i}") for i in range(PARTS)]).alias("key"),
                         _name(F.col("pos") - 1, [F.col(f"s{i}") - F.col(f"p{i}") for i in range(PARTS)]).alias("parent"))


def _root() -> Column:
    return _name(F.lit(0), [F.lit(0)] * PARTS)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ``ends`` (key, c): SHA-256 of each key's ids in order, comma-joined.

    A digest is one pass over its ids in order, so ids are joined to rows of up to ``CHUNK_IDS`` in a range
    partitioning, and one task only streams the rows of a key; it holds one row at a time.
    """
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows, i = [], 0
            while i < len(keys):
                j = i
                while j < len(keys) and j - i < CHUNK_IDS and keys[j] == keys[i]:
                    j += 1
                rows.append((keys[i], ids[i], ",".join(map(str, ids[i:j]))))
                i = j
            k, c, t = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(c, pa.int64()), pa.array(t, pa.string())],
                                             ["key", "c", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            names, out = [], []
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if h is not None:
                        names.append(key)
                        out.append(h.hexdigest())
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends_sha256"])

    chunks = (ends.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c")
              .mapInArrow(chunk, "key binary, c long, ids string"))
    return (chunks.repartition("key").sortWithinPartitions("key", "c")
            .mapInArrow(digest, "key binary, ends_sha256 string"))


def trie_nodes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes (key, parent, depth, conv_id, n_convs, chars), root included; ends (key, c)."""
    paths = cut_lineage(prefixes(turns), "prefixes")
    nodes = paths.groupBy("key").agg(F.min("parent").alias("parent"), F.min("pos").alias("depth"), F.min("c").alias("conv_id"),
                                     F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    root = (lengths.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
            .select(_root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
                    "conv_id", "n_convs", F.lit(0).cast("long").alias("chars")))
    last = paths.select("c", F.col("pos").alias("n_turns"), "key").join(lengths, ["c", "n_turns"]).select("key", "c")
    none = lengths.where("n_turns = 0").select(_root().alias("key"), "c")
    return cut_lineage(nodes.unionByName(root), "nodes"), last.unionByName(none)


def _add(a: DataFrame, b: DataFrame, values: list[str]) -> DataFrame:
    """``a`` with the values of ``b`` (key, values) added to its own."""
    more = b.groupBy("key").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    return a.join(more, "key", "left").select(
        *[c for c in a.columns if c not in values], *[(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values])


def _compress(unary: DataFrame, values: list[str]) -> DataFrame:
    """Chains of ``unary`` (key, parent, child, values): (key, parent, top, end, values), where ``end`` is the first
    node below the chain, values are summed from the node to the chain's end and ``top`` marks its first node."""
    below = unary.select(F.col("key").alias("child"), F.lit(True).alias("more"))
    above = unary.select(F.col("child").alias("key"), F.lit(False).alias("top"))
    state = cut_lineage(unary.join(below, "child", "left").join(above, "key", "left").select(
        "key", "parent", F.coalesce("top", F.lit(True)).alias("top"), F.col("child").alias("end"),
        F.coalesce("more", F.lit(False)).alias("more"), *values), "chains")
    settled = []
    while True:
        waiting = state.where("more")
        if waiting.isEmpty():
            break
        # Every waiting node looks up the node it points to, settled or not; no two point to the same one.
        settled.append(state.where("not more"))
        all_of = reduce(DataFrame.unionByName, settled, waiting).select(
            F.col("key").alias("end"), F.col("end").alias("_end"), F.col("more").alias("_more"), *[F.col(v).alias(f"_{v}") for v in values])
        state = cut_lineage(waiting.join(all_of, "end").select(
            "key", "parent", "top", F.col("_end").alias("end"), F.col("_more").alias("more"),
            *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]), "chains")
    return reduce(DataFrame.unionByName, settled, state).drop("more")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(key, values): sums over each node's subtree, itself included, of a forest (key, parent, values).

    Roots have a null parent; every other parent is a key.  Keys are unique.
    """
    active = cut_lineage(tree.select("key", "parent", *values), "active")
    totals, chains = [], []
    while True:
        kids = active.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"), F.min("key").alias("child"))
        seen = cut_lineage(active.join(kids, "key", "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "children")
        shape = seen.agg(F.count_if(F.col("kids") == 1).alias("unary"), F.count_if(F.col("kids") > 1).alias("inner"), F.count("*").alias("n")).first()
        if not shape["n"]:
            break
        if not shape["unary"]:
            rest, gained = seen.where("kids <> 1"), []
        else:
            chain = _compress(seen.where("kids = 1").select("key", "parent", "child", *values), values)
            chains.append(chain)
            tops = chain.where("top").select(F.col("end").alias("key"), F.col("parent").alias("_up"), F.lit(True).alias("_moved"))
            rest = cut_lineage(seen.where("kids <> 1").join(tops, "key", "left").withColumn(
                "parent", F.when(F.col("_moved"), F.col("_up")).otherwise(F.col("parent"))).drop("_up", "_moved"), "rest")
            gained = [chain.where("top").select(F.col("parent").alias("key"), *values)]
        leaves = rest.where("kids = 0")
        totals.append(leaves.select("key", *values))
        if not shape["inner"]:
            break
        gained.append(leaves.select(F.col("parent").alias("key"), *values))
        sums = reduce(DataFrame.unionByName, gained).where("key IS NOT NULL")
        active = cut_lineage(_add(rest.where("kids > 1").select("key", "parent", *values), sums, values), "active")
    known = reduce(DataFrame.unionByName, totals) if totals else tree.select("key", *values).limit(0)
    for chain in reversed(chains):
        below = known.select(F.col("key").alias("end"), *[F.col(v).alias(f"_{v}") for v in values])
        # Written tables on both sides: a long chain is many rows of one end, which adaptive execution splits.
        found = cut_lineage(chain.join(below, "end").select("key", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]), "expanded")
        known = known.unionByName(found)
    return known


def trie_table(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, ends = trie_nodes(turns, lengths)
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    with_kids = cut_lineage(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    own = with_kids.select("key", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    up = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = cut_lineage(with_kids.join(up, "parent", "left"), "named")
    return (named.join(totals, "key").join(cut_lineage(ends_digest(ends), "ends"), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are.  An empty table gives no rows."""
    turns = cut_lineage(ordered_turns(conversations), "turns")
    return trie_table(turns, turn_lengths(turns))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share first turns (``rebuilt_turns``)."""
    turns, lengths = rebuilt_turns(cut_lineage(ordered_turns(conversations), "turns"))
    return trie_table(turns, lengths)


def oracle_sql() -> str:
    crc = """xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda acc, b: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(acc, b)), 4294967295::BIGINT), 4294967295)"""
    return f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT c, {crc} % {MOST_SHARED} AS h, c - c % {GROUP} AS b FROM t
), r AS (
  SELECT ids.c, pos, role, text FROM ids JOIN t ON t.c = ids.b AND pos <= h
  UNION ALL SELECT ids.c, pos, role, text FROM ids JOIN t ON t.c = ids.c AND pos > h
), p AS (
  SELECT c, row_number() OVER w AS depth, length(text) AS chars, sha256(string_agg(sha256(role) || sha256(text), '') OVER w) AS key
  FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)
  UNION ALL SELECT c, 0, 0, '' FROM ids
), node AS (
  SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY depth, key
), top AS (SELECT c, max(depth) AS depth FROM p GROUP BY c
), ended AS (
  SELECT p.key, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM p JOIN top USING (c, depth) GROUP BY p.key
), link AS (
  SELECT DISTINCT a.key AS parent, b.key FROM p a JOIN p b ON a.c = b.c AND b.depth = a.depth + 1
), kids AS (SELECT parent AS key, count(*) AS n FROM link GROUP BY parent
), below AS (
  SELECT DISTINCT a.key, b.key AS other FROM p a JOIN p b ON a.c = b.c AND b.depth >= a.depth
), total AS (
  SELECT below.key, count(*) FILTER (kids.key IS NULL) AS n_leaves, sum((o.n_convs - 1) * o.chars) AS saved
  FROM below JOIN node o ON o.key = below.other LEFT JOIN kids ON kids.key = below.other GROUP BY below.key
)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN total USING (key) LEFT JOIN kids USING (key) LEFT JOIN ended USING (key)
LEFT JOIN link ON link.key = node.key LEFT JOIN node up ON up.key = link.parent"""
