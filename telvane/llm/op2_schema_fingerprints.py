"""Chat formatting by schema fingerprints.

A record (a row of any table, or a JSON text) is fingerprinted by hashing its sorted nested field paths; array elements
share one path. The fingerprint selects a declarative mapping, which says where in the record the turns, roles and
texts stand. ``MAPPINGS`` covers rows of single turns, lists of messages (two spellings), prompt with response, and
instruction with input and output; more can be passed. Records of unknown layout come out with a null layout.

The template writes each turn as ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Inside roles and texts the first
character of every control string (of this and other common templates) is replaced by an escape, and a backslash is
escaped where it would read as one, so that a formatted text is split and read back exactly. The loss mask lists the
assistant texts as (start, length) in code points of the formatted text.

Turns are ordered by turn, role, text; null turns come first, null roles and texts are empty, a null conv_id is one
conversation of its own. Equal rows are separate turns. Other columns are ignored. Only DataFrame operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates that start with < or [.
CONTROL_ANGLE = r"<(?=\||/?s>|</?SYS>>|/?(?:start|end)_of_turn>|/?think>|/?tool_call>|SYS>>|/SYS>>)"
CONTROL_SQUARE = r"\[(?=/?INST\]|/?SYSTEM_PROMPT\]|/?TOOL_CALLS\]|/?AVAILABLE_TOOLS\])"
ESCAPES = [("<", "\\l"), ("[", "\\b")]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. ``turns``: SQL over the variant ``v`` giving array<struct<role, text>>."""

    layout: str
    paths: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = field(default=())


def listed(path: str, role: str, text: str) -> str:
    item = f"array<struct<{role} string, {text} string>>"
    return f"transform(try_variant_get(v, '$.{path}', '{item}'), x -> named_struct('role', x.`{role}`, 'text', x.`{text}`))"


def told(role: str, *paths: str) -> str:
    parts = ", ".join(f"nullif(try_variant_get(v, '$.{p}', 'string'), '')" for p in paths)
    return f"named_struct('role', '{role}', 'text', concat_ws('\\n', {parts}))"


#: Layouts of public instruction and chat datasets.
MAPPINGS = [
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), "array(named_struct('role', try_variant_get(v, '$.role', 'string'), 'text', try_variant_get(v, '$.text', 'string')))"),
    Mapping("messages", ("messages[].content", "messages[].role"), listed("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), listed("conversations", "from", "value")),
    Mapping("prompt", ("prompt", "response"), f"array({told('user', 'prompt')}, {told('assistant', 'response')})"),
    Mapping("completion", ("completion", "prompt"), f"array({told('user', 'prompt')}, {told('assistant', 'completion')})"),
    Mapping("question", ("answer", "question"), f"array({told('user', 'question')}, {told('assistant', 'answer')})"),
    Mapping("instruction", ("input", "instruction", "output"), f"array({told('user', 'instruction', 'input')}, {told('assistant', 'output')})"),
    Mapping("instruction only", ("instruction", "output"), f"array({told('user', 'instruction')}, {told('assistant', 'output')})"),
]
#: Role names of those datasets.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(v: Column) -> Column:
    """Sorted field paths of a variant's top level and of objects or arrays of objects one level below."""
    schema = F.schema_of_variant(v)
    # OBJECT<a: STRING, b: ARRAY<OBJECT<c: STRING>>> -> [a, b[].c]; names are the words before a colon
    body = F.regexp_replace(schema, r"^OBJECT<|>$", "")
    nested = F.regexp_extract_all(body, F.lit(r"(\w+: (?:ARRAY<)?OBJECT<[^<>]*>|\w+: [^,<>]+(?:<[^<>]*>)?)"), F.lit(1))
    paths = F.flatten(F.transform(nested, lambda x: F.when(
        x.rlike(r"OBJECT<"),
        F.transform(
            F.regexp_extract_all(F.regexp_extract(x, r"OBJECT<([^<>]*)", 1), F.lit(r"(\w+): "), F.lit(1)),
            lambda y: F.concat(F.regexp_extract(x, r"^(\w+)", 1), F.when(x.contains("ARRAY<"), "[].").otherwise("."), y),
        ),
    ).otherwise(F.array(F.regexp_extract(x, r"^(\w+)", 1)))))
    return F.sort_array(paths)


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def with_turns(records: DataFrame, variant: Column, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """``records`` with fingerprint, layout and turns (array of role and text; null for unknown layouts)."""
    own = records.columns
    records = records.withColumn("v", variant).withColumn("fingerprint", fingerprint(field_paths(F.col("v"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role string, text string>>")
    for m in mappings:
        hit = F.col("fingerprint") == fingerprint(F.array(*[F.lit(p) for p in sorted(m.paths)]))
        layout = F.when(hit, F.lit(m.layout)).otherwise(layout)
        turns = F.when(hit, F.expr(m.turns)).otherwise(turns)
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    clean = F.transform(turns, lambda x: F.struct(F.coalesce(named[x["role"]], x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return records.select(*own, "fingerprint", layout.alias("layout"), clean.alias("turns"))


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\(?=[elb])", r"\\e")
    out = F.regexp_replace(out, CONTROL_ANGLE, r"\\l")
    return F.regexp_replace(out, CONTROL_SQUARE, r"\\b")


def unescape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (array of start, length) from turns as rows: conv_id, turn, role, text."""
    piece = F.struct(F.col("turn"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss"))
    grouped = rows.select("conv_id", piece.alias("piece")).groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    head = len(OPEN) + 1
    grouped = grouped.select(
        "conv_id", F.col("pieces"),
        F.array_join(F.transform("pieces", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE), F.lit("\n"))), "").alias("formatted"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start int, length int>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + head + F.length(x["role"])
        span = F.struct(begin.alias("start"), F.length(x["text"]).alias("length"))
        return F.struct(
            (begin + F.length(x["text"]) + len(CLOSE) + 1).alias("at"),
            F.when(x["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return grouped.select("conv_id", "formatted", F.aggregate("pieces", zero, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (role, text) and loss_text, both read from the formatted text and unescaped."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    turns = F.transform(pieces, lambda x: F.struct(
        unescape(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - (len(CLOSE) + 1))).alias("text"),
    ))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of turn rows (conv_id, turn, role, text)."""
    own = rows.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    record = F.to_variant_object(F.struct(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    turned = with_turns(own.select("conv_id", "turn", record.alias("record")), F.col("record"), MAPPINGS)
    turned = turned.select("conv_id", "turn", F.explode("turns").alias("x")).select("conv_id", "turn", "x.role", "x.text")
    back = read_back(format_turns(turned))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
