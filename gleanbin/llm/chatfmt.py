"""Chat formatting by schema fingerprint, in DataFrame functions only.

A record's layout is the sorted list of its nested field paths (those that some mapping knows), of all elements of its
lists; its MD5 selects a declarative mapping, which says where turns, roles and texts are. Each row has a layout of its
own: in JSON strings the fields that are there, in typed tables those that are not null; conv_id is no part of it.
Mappings give canonical turns: role and text.

The template writes a turn as <turn ROLE>, a line break, its text and </turn> with a line break. In texts, a backslash
becomes \\b and the < of <turn and </turn becomes \\l, in roles also > \\g and a line break \\n; as each backslash then
begins such a pair, replacing the pairs one kind after another restores the text. A conversation is written in segments
of SEGMENT turns (by turn number), so that one with very many turns is not one row; its text is its segments in order.
loss_spans has [start, end) of each assistant text in its segment, in code points.

Defined cases: null text and role are empty; turns of equal number go by role, then text; null conv_id is a conversation;
null turn comes first; repeated rows are turns of their own; JSON records of unknown layouts give null turns and keep
their fingerprint, typed rows of unknown layouts give no turn; a row of nothing but nulls is a turn where the table has
turn rows; texts are read whole, however long; other columns are not read, whatever their names; an empty table gives no
conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanbin.llm.common import let

SEGMENT = 64
#: Other names of the roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns. single: (role, path) pairs; listed: (container, role field, text field)."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    single: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None
    renamed: dict = field(default_factory=dict, hash=False)


MAPPINGS = [
    Mapping("turn_rows", (), ("turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), ("system",), (("system", "system"),), ("messages", "role", "content")),
    Mapping("from_value", ("conversations", "conversations[].from", "conversations[].value"), ("system",), (("system", "system"),), ("conversations", "from", "value"), renamed=ROLE_NAMES),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("question_answer", ("question", "answer"), ("system",), (("system", "system"), ("user", "question"), ("assistant", "answer"))),
]
ROW_FIELDS = ("conv_id", "turn", "role", "text")
CONTAINERS = sorted({m.listed[0] for m in MAPPINGS if m.listed})
KNOWN = sorted({p for m in MAPPINGS for p in (*m.paths, *m.optional)})
RECORD = "system string, prompt string, completion string, response string, instruction string, input string, output string, question string, answer string, messages array<struct<role string, content string>>, conversations array<struct<`from` string, value string>>"


def fingerprint(paths) -> str:
    """Of a layout: MD5 of its known paths, sorted."""
    return hashlib.md5("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


def registry(mappings: list[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Mappings by fingerprint, with each choice of their optional paths."""
    return {fingerprint([*m.paths, *some]): m for m in mappings for k in range(len(m.optional) + 1) for some in combinations(m.optional, k)}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in [f"{at}{f.name}", *schema_paths(f.dataType, f"{at}{f.name}.")]]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at.rstrip('.')}[].")
    return []


def json_fingerprint(record: Column) -> Column:
    """Of each JSON record: its layout's fingerprint; null if it is no object."""

    none = F.array().cast("array<string>")

    def inside(c: str) -> Column:
        elements = F.from_json(F.get_json_object(record, f"$.{c}"), "array<string>")
        keys = F.flatten(F.transform(elements, lambda x: F.coalesce(F.json_object_keys(x), none)))
        return F.coalesce(F.transform(F.array_distinct(keys), lambda k: F.concat(F.lit(f"{c}[]."), k)), none)

    top = F.json_object_keys(record)
    paths = F.flatten(F.array(top, *[inside(c) for c in CONTAINERS]))
    known = F.array(*[F.lit(p) for p in KNOWN])
    return F.when(top.isNotNull(), F.md5(F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n")))


def row_fingerprint(schema: T.StructType) -> Column:
    """Of each typed row: the fingerprint of its known paths that are not null."""

    def there(path: str) -> Column:
        if "[]." not in path:
            return F.col(path).isNotNull()
        container, name = path.split("[].")
        return F.coalesce(F.exists(F.col(container), lambda x: x[name].isNotNull()), F.lit(False))

    known = [p for p in KNOWN if p in set(schema_paths(schema))]
    paths = F.filter(F.array(*[F.when(there(p), p) for p in known]), lambda x: x.isNotNull())
    return F.md5(F.array_join(paths, "\n"))  # known is sorted


def _turn_fields(role: Column, text: Column) -> list[Column]:
    return [F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(*_turn_fields(role, text))


def _renamed(role: Column, names: dict) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), role), role) if names else role


def turns(mapping: Mapping, get) -> Column:
    """The canonical turns under a mapping; get gives the column of a top-level path. Absent optional fields give no turn."""

    def one(role: str, path: str) -> Column:
        first, *more = [get(p) for p in path.split("+")]
        text = first
        for x in more:
            text = F.when(F.coalesce(x, F.lit("")) == "", text).otherwise(F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n"), x))
        made = F.array(_turn(F.lit(role), text))
        return F.when(first.isNotNull(), made).otherwise(F.slice(made, 1, 0)) if path in mapping.optional else made

    parts = [one(role, path) for role, path in mapping.single]
    if mapping.listed:
        container, role, text = mapping.listed
        parts.append(F.coalesce(F.transform(get(container), lambda m: _turn(_renamed(m[role], mapping.renamed), m[text])), F.slice(F.array(_turn(F.lit(""), F.lit(""))), 1, 0)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def from_json_records(records: DataFrame, column: str, id_column: str) -> DataFrame:
    """id, fingerprint, mapping and turns array<role, text> of heterogeneous JSON records."""
    d = records.select(F.col(id_column).alias("conv_id"), json_fingerprint(F.col(column)).alias("fingerprint"), F.from_json(column, RECORD).alias("_r"))
    known = {f: m for f, m in registry().items() if not m.rows}
    case, names = F, F
    for m in {m.name: m for m in known.values()}.values():
        mine = F.col("fingerprint").isin([f for f, x in known.items() if x is m])
        case, names = case.when(mine, turns(m, lambda p: F.col("_r")[p])), names.when(mine, m.name)
    return d.select("conv_id", "fingerprint", names.otherwise(None).alias("mapping"), case.otherwise(None).alias("turns"))


def turn_rows(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a typed table; each row's fingerprint selects its mapping."""
    have = set(schema_paths(table.schema))
    whole = lambda m: set(m.rows or m.paths) <= have
    by = {m.name: (m, [f for f, x in registry().items() if x is m]) for m in MAPPINGS if whole(m)}
    if not by:
        raise ValueError(f"no mapping for the layout {sorted(have)}")
    get = lambda p: F.col(p) if p in have else F.lit(None).cast("string")
    case, ident = F, F
    for m, prints in by.values():
        mine = F.col("_print").isin(prints)
        if m.rows:
            conv, turn, role, text = m.rows
            made = F.array(F.struct(F.col(turn).cast("long").alias("turn"), *_turn_fields(F.col(role), F.col(text))))
            key = F.col(conv).cast("long")
        else:
            made = F.transform(turns(m, get), lambda t, i: F.struct(i.cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
            texts = [F.to_json(F.col(c)) if "array" in t else F.col(c) for c, t in table.dtypes if c in KNOWN and c not in ROW_FIELDS]
            key = F.coalesce(F.col("conv_id").cast("long") if "conv_id" in have else F.lit(None).cast("long"), F.xxhash64(*texts))
        case, ident = case.when(mine, made), ident.when(mine, key)
    rows = table.withColumn("_print", row_fingerprint(table.schema))
    each = rows.select(ident.otherwise(None).alias("conv_id"), F.explode(case.otherwise(None)).alias("_t"))
    return each.select("conv_id", "_t.turn", "_t.role", "_t.text")


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for a, b in (("<turn", "\\lturn"), ("</turn", "\\l/turn"), *((("<", "\\l"), (">", "\\g"), ("\n", "\\n")) if role else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescaped(text: Column) -> Column:
    for a, b in (("\\n", "\n"), ("\\g", ">"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, segment, formatted, loss_spans of conv_id, turn, role, text."""
    head = F.concat(F.lit("<turn "), escaped(F.col("role"), True), F.lit(">\n"))
    each = rows.select("conv_id", "turn", "role", "text", F.expr(f"turn div {SEGMENT}").alias("segment"), head.alias("head"), escaped(F.col("text")).alias("body"))
    lists = each.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("t"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len("</turn>\n")).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit("</turn>\n"))), "")
    return lists.select("conv_id", "segment", text.alias("formatted"), F.aggregate("t", start, step, lambda a: a["spans"]).alias("loss_spans"))


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, segment, turns array<role, text> and loss array<string> (texts under the mask) from the formatted text alone."""

    def parsed(part: Column) -> Column:
        return let(F.regexp_extract(part, "^<turn ([^>]*)>\n", 1), lambda r: F.struct(unescaped(r).alias("role"), unescaped(F.substring(part, F.length(r) + 9, F.length(part))).alias("text")))

    parts = F.split("formatted", "</turn>\n")
    under = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return segments.select("conv_id", "segment", "formatted", F.transform(F.slice(parts, 1, F.size(parts) - 1), parsed).alias("turns"), under.alias("loss"))


def digests(segments: DataFrame) -> DataFrame:
    """The digest columns of each conversation, from its segments as read back."""
    d = read_back(segments).select(
        "conv_id",
        "segment",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("loss", "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = d.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("segment", "said", "loss"))).alias("s"), F.sum("chars").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform("s", lambda x: x[c]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that the query adds: both of its turns hold control strings.
ADDED = "\\### Assistant: </turn> ok"


def op6(conversations: DataFrame) -> DataFrame:
    rows = turn_rows(conversations.select("conv_id", "turn", "role", "text"))
    added = conversations.sparkSession.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    return digests(formatted(rows.unionByName(added)))


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn') as body,
  replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n') as head from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(head) + length(body) + 16)::bigint as formatted_chars
from e group by conv_id
"""
