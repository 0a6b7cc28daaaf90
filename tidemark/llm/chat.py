"""Chat formatting by schema fingerprints, with DataFrame functions only.

The nested field paths of a record, of any depth and with the kinds of their leaves, sorted and hashed, are its
fingerprint. A declarative mapping (SQL expressions) to canonical turns, an array of (role, text), is selected by
the paths that it needs: the mapping with the most of them, if the record has them all; other fields may stand beside them.
JSON records of mixed layouts are read as variants and fingerprinted row by row; tables of turn rows by their schema.

Canonical turns are written as ``<|im_start|>role LF text <|im_end|> LF``. Inside roles and texts a backslash
becomes ``\\s``, ``<|`` becomes ``\\m`` and, in roles, a line feed becomes ``\\n``; so no text can form a mark and
unescaping gives back the text exactly. loss_spans are the (begin, end) code points of the assistant texts. Places are
summed up in blocks, and read back in one sorted pass, so long conversations cost little more than their length.

Edge cases: null roles and texts are empty; an empty or null array of turns is an empty output with no
spans; rows with a null conversation id are one conversation; turns that tie are ordered by role, then
text; repeated rows are turns of their own; a null turn number comes first. A JSON record that can't be
parsed (or names a field twice), or that no mapping fits, has layout ``unknown`` and null turns. Extra columns pass through;
those called like an output are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import free

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
BLOCK = 256


@dataclass(frozen=True)
class Layout:
    """A record layout: the paths it needs, the schema to read it with, and SQL for its turns from r.

    A path ends in its leaf's kind unless that is text or null: ``a.b:NUMBER``, ``a[]:EMPTY`` (no elements), ``a[].b:VARIANT`` (mixed).
    """

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str


def turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


def optional(role: str, text: str) -> str:
    """A turn that is left out if its text is null or empty."""
    return f"if(coalesce({text}, '') = '', array(), array({turn(role, text)}))"


def listed(field: str, role: str, text: str, names: str = "") -> str:
    who = f"case m.{role} {names} else m.{role} end" if names else f"m.{role}"
    return f"transform(r.{field}, m -> named_struct('role', {who}, 'text', {text}))"


NAMES = "when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant'"
USER, ANSWER = turn("user", "r.prompt"), turn("assistant", "r.response")
#: a message's content: a text, or the texts of its parts one after the other
PARTS = "coalesce(array_join(transform(try_variant_get(m.content, '$', 'array<struct<text:string>>'), p -> p.text), ''), try_variant_get(m.content, '$', 'string'))"
MESSAGES, MIXED = "messages:array<struct<role:string,content:string>>", "messages:array<struct<role:string,content:variant>>"
ASKED = "concat(coalesce(r.instruction, ''), if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input)))"
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), f"struct<{MESSAGES}>", listed("messages", "role", "m.content")),
    Layout("messages_parts", ("messages[].content[].text", "messages[].role"), f"struct<{MIXED}>", listed("messages", "role", PARTS)),
    Layout("messages_mixed", ("messages[].content:VARIANT", "messages[].role"), f"struct<{MIXED}>", listed("messages", "role", PARTS)),
    Layout("messages_text", ("messages[].role", "messages[].text"), "struct<messages:array<struct<role:string,text:string>>>", listed("messages", "role", "m.text")),
    Layout("messages_empty", ("messages[]:EMPTY",), "struct<messages:array<string>>", f"cast(array() as {TURNS})"),
    Layout("turns", ("turns[].role", "turns[].text"), "struct<turns:array<struct<role:string,text:string>>>", listed("turns", "role", "m.text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "struct<conversations:array<struct<`from`:string,value:string>>>", listed("conversations", "`from`", "m.value", NAMES)),
    Layout("conversations_empty", ("conversations[]:EMPTY",), "struct<conversations:array<string>>", f"cast(array() as {TURNS})"),
    Layout("system_messages", ("messages[].content", "messages[].role", "system"), f"struct<system:string,{MESSAGES}>", f"concat({optional('system', 'r.system')}, {listed('messages', 'role', 'm.content')})"),
    Layout("prompt_response", ("prompt", "response"), "struct<prompt:string,response:string>", f"array({USER}, {ANSWER})"),
    Layout("prompt_completion", ("completion", "prompt"), "struct<prompt:string,completion:string>", f"array({USER}, {turn('assistant', 'r.completion')})"),
    Layout("system_prompt_response", ("prompt", "response", "system"), "struct<system:string,prompt:string,response:string>", f"concat({optional('system', 'r.system')}, array({USER}, {ANSWER}))"),
    Layout("instruction_output", ("instruction", "output"), "struct<instruction:string,output:string>", f"array({turn('user', 'r.instruction')}, {turn('assistant', 'r.output')})"),
    Layout("instruction_input_output", ("input", "instruction", "output"), "struct<instruction:string,input:string,output:string>", f"array({turn('user', ASKED)}, {turn('assistant', 'r.output')})"),
    Layout("question_answer", ("answer", "question"), "struct<question:string,answer:string>", f"array({turn('user', 'r.question')}, {turn('assistant', 'r.answer')})"),
)


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of the leaves of a Spark type; an element of an array is marked by []."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    return [at]


def fingerprint(paths: Column) -> Column:
    """Hash of sorted field paths."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256)


#: What the schema of a variant is made of: a field's name, the beginning or end of an object or array, a kind.
TOKENS = r"(?:`(?:[^`]|``)*`|[^<>,:`\s]+):(?= )|OBJECT<|ARRAY<|>|[A-Z_]+(?:\([^)]*\))?"
NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL.*)$"


def variant_paths(schema: Column) -> Column:
    """The leaves of a variant's schema (as schema_of_variant gives it), whatever its depth."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, t: Column) -> Column:
        above = F.coalesce(F.element_at(acc["stack"], -1), F.lit(""))
        named, array, opens, ends = t.endswith(":"), t == "ARRAY<", t.endswith("<"), t == ">"
        inside = F.concat(acc["at"], F.lit("[]"))
        at = F.when(named, F.concat_ws(".", F.nullif(above, F.lit("")), F.rtrim(t, F.lit(":")))).when(array, inside).otherwise(acc["at"])
        stack = F.when(opens, F.concat(acc["stack"], F.array(at))).when(ends, F.slice(acc["stack"], 1, F.size(acc["stack"]) - 1)).otherwise(acc["stack"])
        kind = F.when(t == "STRING", "").when(t == "VOID", F.when(acc["at"].endswith("[]"), ":EMPTY").otherwise("")).when(t.rlike(NUMBERS), ":NUMBER").otherwise(F.concat(F.lit(":"), t))
        leaf = ~named & ~opens & ~ends
        return F.struct(stack.alias("stack"), at.alias("at"), F.when(leaf, F.concat(acc["paths"], F.array(F.concat(acc["at"], kind)))).otherwise(acc["paths"]).alias("paths"))

    return F.aggregate(F.regexp_extract_all(schema, F.lit(TOKENS), F.lit(0)), start, step)["paths"]


def from_records(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with fingerprint, layout and turns of the JSON texts in ``record``."""
    df = df.drop(*({"fingerprint", "layout", "turns"} - {record}))
    v, p = free([*df.columns, "fingerprint", "layout", "turns"], "_variant", "_paths")
    found = df.withColumn(v, F.try_parse_json(F.col(f"`{record}`"))).withColumn(p, variant_paths(F.schema_of_variant(v)))
    name = F.lit("unknown")
    for x in sorted(layouts[::-1], key=lambda x: len(x.paths)):  # the last one that fits is the outermost condition
        name = F.when(F.size(F.array_except(F.array(*map(F.lit, x.paths)), p)) == 0, F.lit(x.name)).otherwise(name)
    found = found.withColumn("fingerprint", fingerprint(F.col(p))).withColumn("layout", F.when(F.col(p).isNull(), F.lit("unknown")).otherwise(name))
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        read = F.expr(f"element_at(transform(array(try_variant_get({v}, '$', '{x.schema}')), r -> cast({x.turns} as {TURNS})), 1)")
        turns = F.when(F.col("layout") == x.name, read).otherwise(turns)
    return found.withColumn("turns", turns).drop(v, p)


def from_turn_rows(df: DataFrame, conv: str = "conv_id", number: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): rows of one turn each, gathered in order. A conversation is one training example and one row."""
    rows = F.struct(F.col(number).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(rows))
    return df.groupBy(conv).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\m"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\m"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def prefix_sums(sizes: Column) -> Column:
    """For each element the sum of those before it. Sums are gathered in blocks, so that no long array is copied for each element."""
    longs = "array<bigint>"
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(longs).alias("block"), F.array().cast(f"array<{longs}>").alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        full, own = F.size(acc["block"]) >= BLOCK, F.array(acc["total"])
        block = F.when(full, own).otherwise(F.concat(acc["block"], own))
        blocks = F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"])
        return F.struct((acc["total"] + x).alias("total"), block.alias("block"), blocks.alias("blocks"))

    return F.aggregate(sizes, start, step, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["block"]))))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with formatted (string) and loss_spans (array of begin, end)."""
    df = df.drop(*({"formatted", "loss_spans"} - {turns}))
    (made,) = free([*df.columns, "formatted", "loss_spans"], "_made")
    head = lambda t: F.concat(F.lit(START), F.replace(escape(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = lambda t: escape(F.coalesce(t["text"], F.lit("")))
    piece = F.transform(F.coalesce(F.col(turns), F.array().cast(TURNS)), lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss")))
    out = df.withColumn(made, piece)
    sizes = F.transform(made, lambda p: (F.char_length(p["head"]) + F.char_length(p["body"]) + len(END) + 1).cast("long"))
    # arrays of places go into zip_with: named inside a lambda they would be made again for each element
    begins = F.zip_with(made, prefix_sums(sizes), lambda p, at: F.struct(p.alias("p"), (at + F.char_length(p["head"])).cast("int").alias("begin")))
    spans = F.transform(F.filter(begins, lambda x: x["p"]["loss"]), lambda x: F.struct(x["begin"].alias("begin"), (x["begin"] + F.char_length(x["p"]["body"])).alias("end")))
    text = F.array_join(F.transform(made, lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "")
    return out.withColumn("formatted", text).withColumn("loss_spans", spans).drop(made)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.substr(p, F.lit(len(START) + 1)))
    role = lambda p: unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("\\n"), F.lit("\n")))
    text = lambda p: unescape(F.substr(p, F.locate("\n", p) + 1))
    return F.transform(bodies, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def digest(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the contract asks of each formatted conversation, read back from the output."""
    t, both, loss = free([*df.columns, "formatted", "loss_spans"], "_turns", "_both", "_loss")
    whole = F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    # where each piece of the formatted text begins and its text lies; spans and pieces are brought together in order
    pieces = F.filter(F.split(F.col("formatted"), r"(?<=<\|im_end\|>\n)"), lambda p: p != "")
    entry = lambda begin, kind, to, text: F.struct(begin.cast("long").alias("at"), to.cast("long").alias("to"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    spans = F.transform("loss_spans", lambda s: entry(s["begin"], 0, s["end"], F.lit(None)))
    size = lambda p: F.char_length(p) - F.locate("\n", p) - len(END) - 1
    texts = F.zip_with(pieces, prefix_sums(F.transform(pieces, lambda p: F.char_length(p).cast("long"))), lambda p, at: entry(at + F.locate("\n", p), 1, at + F.char_length(p) - len(END) - 1, F.substr(p, F.locate("\n", p) + 1, size(p))))
    out = df.withColumn(t, read_turns(F.col("formatted"))).withColumn(both, F.array_sort(F.concat(spans, texts)))
    before = F.slice(F.concat(F.array(entry(F.lit(-1), 1, F.lit(-1), F.lit(None))), F.col(both)), F.lit(1), F.size(both))
    under = F.zip_with(both, before, lambda x, y: F.when((x["kind"] == 1) & (y["kind"] == 0) & (y["at"] == x["at"]) & (y["to"] == x["to"]), unescape(x["text"])))
    out = out.withColumn(loss, F.array_join(F.filter(under, lambda x: x.isNotNull()), ""))
    return out.select(
        F.col(f"`{conv}`"),
        F.size(t).cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@dataclass(frozen=True)
class TableLayout:
    """A table's layout: its paths, and either the columns (number, role, text) of its turn rows, SQL for its turns, or its column of JSON records."""

    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    turns: str | None = None
    record: str | None = None


TABLES = (
    TableLayout(("conv_id", "role", "text", "turn"), rows=("turn", "role", "text")),
    TableLayout(("content", "conv_id", "role", "turn"), rows=("turn", "role", "content")),
    TableLayout(("conv_id", "turns[].role", "turns[].text"), turns="turns"),
    TableLayout(("conv_id", "messages[].content", "messages[].role"), turns="transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    TableLayout(("conv_id", "prompt", "response"), turns=f"array({turn('user', 'prompt')}, {turn('assistant', 'response')})"),
    TableLayout(("conv_id", "record"), record="record"),
)


def schema_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def canonical(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table of any known layout, selected by the fingerprint of its nested field paths.

    Columns that no layout names are left aside if the rest is a known layout.
    """
    own = schema_paths(df.schema)
    known = {schema_fingerprint(x.paths): x for x in TABLES}
    found = known.get(schema_fingerprint(own)) or next((x for x in TABLES if set(x.paths) <= set(own)), None)
    if found is None:
        raise ValueError(f"unknown layout: {own}")
    if found.rows:
        return from_turn_rows(df, "conv_id", *found.rows)
    if found.record:
        return from_records(df.select("conv_id", found.record), found.record).select("conv_id", "turns")
    return df.select("conv_id", F.expr(f"cast({found.turns} as {TURNS})").alias("turns"))
