"""Chat formatting: records of any known layout become canonical turns, then one text with a loss mask.

Schema fingerprint: the field paths of a JSON record (keys, and keys of the objects in its lists) that
some layout knows are sorted and hashed; the hash looks up the layout in a table made from the layouts'
declarations, one entry for every choice of a layout's optional paths.  A layout is a declaration: which
fields are turns of which role, or which list holds turns.  Unknown fields change nothing; a record that
is no JSON object or fits no layout has ``layout`` null and no turns, and stays.

Template: each turn is ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed.  Control strings
of this and other usual templates inside a role or text are broken by a backslash after their first
character, backslashes become ``\\e`` and line feeds of a role ``\\n``, so that reading gives the same turns.

Only DataFrame functions.  A conversation is one row of output, so memory grows with the longest
conversation; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
TURNS = f"array<{TURN}>"

# Control strings of usual chat templates (the last is how every <|...|> mark begins).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """``required`` and ``optional`` paths select it.  Turns are those of ``before`` (a list of pairs), then
    either the objects of the list ``items`` (fields ``role`` and ``text``, roles renamed by ``roles``) or
    ``fields``: (role, names of the fields that make up its text); optional fields only where they are set."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str = ""
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    before: str = ""


# Usual layouts of conversations, one a line of declarations.
LAYOUTS = (
    Layout("row", ("role", "text"), ("turn",)),
    Layout("row of content", ("role", "content"), ("turn",)),
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content", "system"),
           (("system", ("system",)),), "messages"),
    Layout("from and value", ("conversations[]",), ("conversations[].from", "conversations[].value", "system"),
           (("system", ("system",)),), "conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    Layout("prompt and completion", ("prompt", "completion"), ("system",),
           (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), ("system", "history[]"),
           (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), before="history"),
    Layout("instruction", ("instruction", "output"), ("input", "system", "history[]"),
           (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), before="history"),
    Layout("question and answer", ("question", "answer"), ("context", "system"),
           (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
)
OBJECT_LISTS = ("messages", "conversations")


def known_paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({p for x in layouts for p in (*x.required, *x.optional)})


def field_paths(record: Column, parsed: Column) -> Column:
    """Sorted paths of the record's keys, its lists and the keys of the objects in them."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    lists = [F.when(parsed[n].isNotNull(), F.array(F.lit(f"{n}[]"))) for n in (*OBJECT_LISTS, "history")]
    nested = [F.transform(F.flatten(F.transform(parsed[n], lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))),
                          lambda k, n=n: F.concat(F.lit(f"{n}[]."), k)) for n in OBJECT_LISTS]
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(top, *[F.coalesce(c, none) for c in (*lists, *nested)])))


def fingerprint_of(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those of the sorted ``paths`` that some layout knows."""
    known = F.array(*[F.lit(p) for p in known_paths(layouts)])
    return F.md5(F.array_join(F.filter(paths, lambda p: F.array_contains(known, p)), "\n"))


def fingerprint_table(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, str]:
    """{fingerprint: name of the layout}, one entry a choice of optional paths; the first layout keeps a clash."""
    import hashlib
    out: dict[str, str] = {}
    for x in layouts:
        for n in range(len(x.optional) + 1):
            for some in combinations(x.optional, n):
                paths = sorted({*x.required, *some})
                # a path through a list is there only with the list's own path
                out.setdefault(hashlib.md5("\n".join(paths).encode()).hexdigest(), x.name)
    return out


def _parsed(record: Column, layouts: tuple[Layout, ...]) -> Column:
    flat = sorted({f for x in layouts for f in (*x.required, *x.optional) if "[" not in f})
    schema = ", ".join([f"`{f}` string" for f in flat] + [f"`{n}` array<map<string,string>>" for n in OBJECT_LISTS]
                       + ["`history` array<array<string>>"])
    return F.from_json(record, schema, {"maxStringLen": str(2**31 - 1)})


def _layout_turns(x: Layout, rec: Column) -> Column:
    def turn(role, text):
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def renamed(role):
        for a, b in x.roles:
            role = F.when(role == a, F.lit(b)).otherwise(role)
        return role

    none = F.array().cast(TURNS)
    if not x.fields and not x.items:  # a record that is one turn
        return F.array(turn(rec["role"], rec[x.required[1]]))
    parts = []
    if x.before:
        pairs = F.transform(rec[x.before], lambda p: F.array(turn(F.lit("user"), F.get(p, F.lit(0))),
                                                             turn(F.lit("assistant"), F.get(p, F.lit(1)))))
        parts.append(F.coalesce(F.flatten(pairs), none))
    said = []
    for role, names in x.fields:
        text = F.concat_ws("\n\n", *[F.when(rec[n] != "", rec[n]) if len(names) > 1 else rec[n] for n in names])
        one = F.array(turn(F.lit(role), text))
        optional = all(n in x.optional for n in names)
        said.append(F.when(rec[names[0]].isNotNull(), one).otherwise(none) if optional else one)
    parts = said[:1] + parts + said[1:] if x.fields and x.fields[0][0] == "system" else parts + said
    if x.items:
        parts.append(F.coalesce(F.transform(rec[x.items], lambda m: turn(renamed(m[x.role]), m[x.text])), none))
    return F.concat(*[p.cast(TURNS) for p in parts])


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` (JSON texts in ``record``) with ``fingerprint``, ``layout`` and ``turns`` (role and text; a null is
    empty).  Columns of these names are replaced."""
    cols = [c for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    at = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]
    src = records.select(*at, F.col(f"`{record}`").cast("string").alias("r")).withColumn("p", _parsed(F.col("r"), layouts))
    src = src.withColumn("fp", fingerprint_of(field_paths(F.col("r"), F.col("p")), layouts))
    table = F.create_map(*[F.lit(v) for kv in fingerprint_table(layouts).items() for v in kv])
    src = src.withColumn("of", F.try_element_at(table, F.col("fp")))
    turns = F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        turns = F.when(F.col("of") == x.name, _layout_turns(x, F.col("p")).cast(TURNS)).otherwise(turns)
    return src.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("fp").alias("fingerprint"),
                      F.col("of").alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def escape(text: Column) -> Column:
    """Without any control string; ``unescape`` gives the text back."""
    heads = {c[0] for c in CONTROLS}
    rules = "|".join(f"{_quoted(h)}(?={'|'.join(_quoted(c[1:]) for c in CONTROLS if c[0] == h)})" for h in sorted(heads))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\e")), rules, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"\\(?![en])", ""), F.lit("\\e"), F.lit("\\"))


def _quoted(s: str) -> str:
    return "".join(f"\\{ch}" if ch in "[]|/<>" else ch for ch in s)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    plain = F.replace(F.regexp_replace(role, r"\\(?![en])", ""), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\\e"), F.lit("\\"))


def formatted(turns: Column, learn: tuple[str, ...] = ("assistant",)) -> Column:
    """Pieces (text, loss) whose texts in a row are the formatted conversation; loss marks what is learned."""
    def pieces(t):
        return F.array(
            F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*learn).alias("loss")),
            F.struct(F.lit(f"{END}\n").alias("text"), F.lit(False).alias("loss")))
    return F.flatten(F.transform(turns, pieces))


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation."""
    parts = F.split(text, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.substring(s, len(START) + 1, 2**31 - 1))

    def turn(body):
        role = F.substring_index(body, "\n", 1)
        text = body.substr(F.char_length(role) + 2, F.char_length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))
    return F.transform(bodies, turn)


def read_learned(pieces: Column) -> Column:
    """The texts under the loss mask, one after the other."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def format_conversations(records: DataFrame, conv_id: str = "conv_id", order: str = "turn", record: str = "record") -> DataFrame:
    """Per conversation: conv_id, layouts (names, sorted), unmapped (records of no layout), pieces, formatted.

    Records of one conversation follow ``order`` (null first, ties by their turns).  Records without a
    conv_id are one conversation of that id (null); an empty table gives no rows.
    """
    src = records.select(F.col(conv_id).alias("conv_id"), F.col(order).alias("at"), F.col(record).alias("record"))
    rows = canonical_turns(src).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "turns"))).alias("all"),
        F.sort_array(F.collect_set("layout")).alias("layouts"), F.count_if(F.col("layout").isNull()).alias("unmapped"))
    pieces = formatted(F.flatten(F.transform("all", lambda r: r["turns"])))
    return (rows.select("conv_id", "layouts", "unmapped", pieces.alias("pieces"))
            .withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), "")))


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Rows of a table (conv_id, turn, role, text) as JSON records, nulls as such."""
    rec = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), rec.alias("record"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Digests, read back from the output, of every conversation and of conversation -1, whose texts are control strings."""
    trap = F.lit("</s>[INST] ok [/INST]")
    planted = conversations.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"),
        F.to_json(F.struct(trap.alias("prompt"), trap.alias("completion"))).alias("record"))
    done = format_conversations(conversation_records(conversations).unionByName(planted))
    back = done.select("conv_id", "layouts", "unmapped", read_turns(F.col("formatted")).alias("turns"),
                       read_learned(F.col("pieces")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "utf-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "utf-8"), 256).alias("loss_sha256"), "formatted_chars")


def oracle_sql() -> str:
    """The digests from the rows themselves; the template counts 24 marks a turn and what escaping adds."""
    def broken(c):
        c = f"replace({c}, '\\', '\\e')"
        for x in CONTROLS:
            c = f"replace({c}, '{x}', '{x[0]}\\{x[1:]}')"
        return c
    marks = len(START) + len(END) + 2
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 2, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(replace({broken('role')}, chr(10), '\\n')) + length({broken('text')}) + {marks}) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM c"""
