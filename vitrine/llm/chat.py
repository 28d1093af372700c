"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record is a JSON object in any of the known layouts.  Its fingerprint is a
hash of its nested field paths (types left out); the fingerprint chooses a
mapping, which says where roles and texts stand.  The canonical turns are then
formatted with a template that marks turns; control strings inside roles and
texts are escaped, so that ``parse_chat`` gives every turn back exactly, and a
loss mask names the spans of assistant text.

Everything is DataFrame functions.  Rows are shuffled once, by conversation;
what a task holds is one conversation's text, which the output needs in one row
anyway.

Edge cases: null roles and texts are empty; turns are in the order of turn
(null first), then role, then text; repeated rows are repeated turns; fields
named in ``BESIDE`` don't count for a layout; records of any other layout give no
turn and a null layout, by which they can be told; very long texts are formatted
whole, and a record too long for a variant raises an error; empty tables give empty results; ``canonical_turns`` keeps all columns (those
named layout and turns it replaces), ``format_chats`` reads its own only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: What may not stand unescaped in a text: this template's marks and those of other common templates.
CONTROL = r"(<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\]))"
#: Characters from which on a record must parse: Spark's variants end at 128 MB.
LONG_RECORD = 64 << 20
_TURNS = "array<struct<role:string,text:string>>"
#: Fields that stand beside a layout's own, at any depth, and are left out of the fingerprint where they hold a plain value.
BESIDE = ("id", "name", "source", "model", "lang", "language", "timestamp", "created", "category", "weight")


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths it is known by, and its turns as a Spark SQL expression over the variant ``v``."""

    name: str
    paths: str
    turns: str


def _pair(user: str, answer: str, system: str | None = None) -> str:
    get = lambda f: f"variant_get(v, '$.{f}', 'string')"
    turns = [f"struct('system' as role, {get(system)} as text)"] if system else []
    return f"array({', '.join([*turns, f"struct('user' as role, {user if '(' in user else get(user)} as text)", f"struct('assistant' as role, {get(answer)} as text)"])})"


def _list(field: str, role: str, text: str, names: dict[str, str] | None = None) -> str:
    named = "m." + role
    for a, b in (names or {}).items():
        named = f"if(m.{role} = '{a}', '{b}', {named})"
    return f"transform(variant_get(v, '$.{field}', 'array<struct<{role}:string,{text}:string>>'), m -> struct({named} as role, m.{text} as text))".replace(f"{role}:string", f"`{role}`:string").replace(f"m.{role}", f"m.`{role}`")


_INSTRUCTION = "concat(variant_get(v, '$.instruction', 'string'), if(coalesce(variant_get(v, '$.input', 'string'), '') = '', '', concat('\\n\\n', variant_get(v, '$.input', 'string'))))"
MAPPINGS = (
    Mapping("turn_rows", "OBJECT<role, text>", "array(struct(variant_get(v, '$.role', 'string') as role, variant_get(v, '$.text', 'string') as text))"),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", _list("messages", "role", "content")),
    Mapping("from_value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", _list("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Mapping("instruction_input", "OBJECT<input, instruction, output>", _pair(_INSTRUCTION, "output")),
    Mapping("instruction", "OBJECT<instruction, output>", _pair("instruction", "output")),
    Mapping("prompt_response", "OBJECT<prompt, response>", _pair("prompt", "response")),
    Mapping("prompt_completion", "OBJECT<completion, prompt>", _pair("prompt", "completion")),
    Mapping("question_answer", "OBJECT<answer, question>", _pair("question", "answer")),
    Mapping("system_prompt_response", "OBJECT<prompt, response, system>", _pair("prompt", "response", "system")),
)


def field_paths(v: Column) -> Column:
    """The nested field names of a variant, without types and without those of BESIDE."""
    paths = F.regexp_replace(F.schema_of_variant(v), r": (?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]+\))?", "")
    names = "|".join(BESIDE)
    return F.regexp_replace(F.regexp_replace(paths, rf"(?<=<)(?:(?:{names}), )+", ""), rf", (?:{names})(?=[,>])", "")


def fingerprint(v: Column) -> Column:
    return F.xxhash64(field_paths(v))


def parsed(record: Column) -> Column:
    """The record as a variant, null if it isn't JSON.  A very long one that can't be held as a variant raises instead of losing its turns."""
    return F.when(F.length(record) >= LONG_RECORD, F.parse_json(record)).otherwise(F.try_parse_json(record))


def canonical_turns(records: DataFrame, json: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add layout (null if unknown) and turns, an array of (role, text), by each record's schema fingerprint."""
    # the caller's columns stand apart, whatever their names
    df = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("given"), parsed(F.col(json)).alias("v"))
    df = df.withColumn("shape", fingerprint(F.col("v")))
    layout, turns = F.lit(None).cast("string"), F.array().cast(_TURNS)
    for m in reversed(mappings):
        own = F.col("shape") == F.xxhash64(F.lit(m.paths))
        layout, turns = F.when(own, m.name).otherwise(layout), F.when(own, F.expr(m.turns).cast(_TURNS)).otherwise(turns)
    return df.select(*[F.col("given")[c].alias(c) for c in records.columns if c not in ("layout", "turns")], layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """Backslashes doubled, then one put behind the first character of every control string."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\(?=[^\\])", "$1"), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per conversation: formatted, and loss, the spans (start, stop in code points) of assistant texts.

    turns: conv, order, role, text.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    body = escape(F.col("text"))
    rows = turns.select(F.col(conv), F.col(order).alias("o"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(conv, "o", "role", "text", head.alias("head"), body.alias("body")).withColumn("piece", F.concat("head", "body", F.lit(END)))
    upto = Window.partitionBy(conv).orderBy("o", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.length("piece")).over(upto)).withColumn("n", F.row_number().over(Window.partitionBy(conv).orderBy("o", "role", "text")))
    start = F.col("stop") - F.length("piece") + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("stop")))
    whole = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("n", "piece", span.alias("span")))).alias("all"))
    return whole.select(conv, F.array_join(F.col("all.piece"), "").alias("formatted"), F.filter("all.span", lambda s: s.isNotNull()).alias("loss"))


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        two = F.split(F.substring(piece, len(TURN) + 1, 2**31 - 1), r"<\|says\|>", 2)
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(pieces, turn)


def digest_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and hashes of what a formatted table holds: its turns, and the text under its loss mask."""
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.withColumns({"turns": parse_chat(F.col("formatted")), "loss_text": loss})
    return rows.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
