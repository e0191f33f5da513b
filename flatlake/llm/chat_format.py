"""Chat formatting with native column expressions only.

Layouts. Conversations come as messages, as prompt and response, as instruction and output, or as rows by
turn. A mapping is declarative: the nested field paths that it needs, and which of them are the turns' role and
text; it makes canonical turns, an array of (role, text). It is selected by its schema fingerprint, the hash of its
sorted paths: the first mapping whose fingerprint is that of the paths that a table or record shares with it. Further
fields are thus ignored. `from_table` takes the paths of a DataFrame's schema; `from_json` takes them row by row from
JSON records of mixed layouts, over all members of an array, and also from objects inside the record, two levels deep,
where the record itself has no known layout. A list of messages stands for a record that has only them.

Template. A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. So that no text or role can hold a control string,
"<|" becomes "<\\|", "<\\|" becomes "<\\\\|" and so on, one backslash more; in roles, line breaks become "\\n" and
backslashes double. Both are undone on reading. The loss mask is run-length coded, in
code points of the output: for each turn, how many stand before its text, how long the text is as written,
how many follow it, and whether the text is the assistant's and so under the mask.

Defined results: null roles and texts are empty. Turns are ordered by (turn, role, text), null turns first;
repeated rows are turns of their own. Rows of a null conv_id form one conversation. A record of an unknown
layout has null turns (`from_json`), or raises for a table. An empty list of messages is a conversation without turns;
a message that lacks a field has it empty; content in parts is the texts of its parts, a line each. An empty table gives
an empty result. Other columns are ignored, whatever their names. A conversation is one row of the output and so has to
fit in one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texts import let

START, STOP = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role: string, text: string>>"

#: Mappings, in the order in which they are tried. "each" is an array whose members have role and text; otherwise the
#: listed (role, path) fields are turns in that order, empty ones with a "?" left out.
LAYOUTS: dict[str, dict] = {
    "rows": {"paths": ["conv_id", "turn", "role", "text"], "rows": True},
    "messages": {"paths": ["messages[].content", "messages[].role"], "each": "messages", "role": "role", "text": "content"},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "each": "conversations", "role": "from", "text": "value"},
    "system_prompt": {"paths": ["system", "prompt", "response"], "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "instruction_input": {"paths": ["instruction", "input", "output"], "fields": [("user", "instruction"), ("user?", "input"), ("assistant", "output")]},
    "prompt_response": {"paths": ["prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    "prompt_completion": {"paths": ["prompt", "completion"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    "instruction": {"paths": ["instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    "question_answer": {"paths": ["question", "answer"], "fields": [("user", "question"), ("assistant", "answer")]},
}
#: Role names that mean a canonical one.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


PRINTS = {name: fingerprint(layout["paths"]) for name, layout in LAYOUTS.items()}


def layout_of(paths: list[str]) -> str | None:
    """The first mapping whose fingerprint is that of the paths that these share with it."""
    return next((name for name, layout in LAYOUTS.items() if fingerprint([p for p in layout["paths"] if p in set(paths)]) == PRINTS[name]), None)


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def _role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    out = role
    for name, canonical in ROLES.items():
        out = F.when(role == name, F.lit(canonical)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _fields(layout: dict, get) -> Column:
    parts = []
    for role, path in layout["fields"]:
        turn = _turn(F.lit(role.rstrip("?")), get(path))
        parts.append(F.when(F.coalesce(get(path), F.lit("")) != "", F.array(turn)).otherwise(F.array().cast(TURNS)) if role.endswith("?") else F.array(turn))
    return F.concat(*parts)


def from_table(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table in a known layout; ids are a column conv_id or id, else null. Further columns and
    fields are allowed."""
    paths = field_paths(df.schema)
    name = layout_of(paths)
    if name is None:
        raise ValueError(f"no mapping for a table with the fields {', '.join(paths)}")
    layout = LAYOUTS[name]
    if layout.get("rows"):
        turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        every = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        return every.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    key = next((F.col(c) for c in ("conv_id", "id") if c in df.columns), F.lit(None).cast("long"))
    if "each" in layout:
        members = F.transform(F.col(layout["each"]), lambda m: _turn(m[layout["role"]], m[layout["text"]]))
        turns = F.coalesce(members, F.array().cast(TURNS))
    else:
        turns = _fields(layout, F.col)
    return df.select(key.alias("conv_id"), turns.alias("turns"))


def _at(record: Column, key: Column) -> Column:
    """The JSON text of a field of a JSON object."""
    return F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("']")))


def _keys(record: Column) -> Column:
    return F.coalesce(F.call_function("json_object_keys", record), F.array().cast("array<string>"))


def json_paths(record: Column) -> Column:
    """The nested field paths of a JSON object: its fields, and those of all members of its arrays of objects. An empty
    array stands for the paths of the mapping that looks into it."""

    def below(key: Column) -> Column:
        members = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>"))
        inner = lambda m: F.array_distinct(F.flatten(F.transform(F.filter(m, lambda x: x.startswith("{")), _keys)))
        empty = F.array().cast("array<string>")
        for layout in LAYOUTS.values():
            if "each" in layout:
                empty = F.when(key == layout["each"], F.array(*map(F.lit, layout["paths"]))).otherwise(empty)
        of_array = lambda m: F.when(m.isNull(), F.array(key)).when(F.size(m) == 0, empty).otherwise(F.transform(inner(m), lambda i: F.concat(key, F.lit("[]."), i)))
        return let(members(_at(record, key)), of_array)

    return F.flatten(F.transform(_keys(record), below))


def _json_layout(record: Column) -> Column:
    """The name of the first mapping whose fingerprint is that of the paths that the record shares with it."""

    def first(paths: Column) -> Column:
        shared = lambda layout: F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, layout["paths"])))), "\n")
        return F.coalesce(*(F.when(F.sha2(shared(layout), 256) == PRINTS[name], F.lit(name)) for name, layout in LAYOUTS.items() if not layout.get("rows")))

    return let(json_paths(record), first)


def _inside(records: Column) -> Column:
    """The objects that are fields of these objects."""
    return F.flatten(F.transform(records, lambda r: F.filter(F.transform(_keys(r), lambda k: _at(r, k)), lambda v: F.coalesce(v.startswith("{"), F.lit(False)))))


def _content(member: Column, field: str) -> Column:
    """A text, or the texts of its parts."""
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"))
    parts = F.try_variant_get(member, f"$.{field}", "array<variant>")
    texts = F.filter(F.transform(parts, lambda p: F.when(F.schema_of_variant(p) == "STRING", part(p)).otherwise(F.try_variant_get(p, "$.text", "string"))), lambda x: x.isNotNull())
    return F.when(parts.isNotNull(), F.array_join(texts, "\n")).otherwise(F.try_variant_get(member, f"$.{field}", "string"))


def _json_turns(layout: dict) -> Column:
    members = F.filter(F.try_variant_get("__value", f"$.{layout['each']}", "array<variant>"), lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    return F.transform(members, lambda m: _turn(F.try_variant_get(m, f"$.{layout['role']}", "string"), _content(m, layout["text"])))


def from_json(df: DataFrame, json_col: str = "record", id_col: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) of JSON records, each in a layout of its own."""
    text = F.trim(F.col(json_col))
    record = F.when(text.startswith("["), F.concat(F.lit('{"messages":'), text, F.lit("}"))).otherwise(text)
    named = lambda records: F.get(F.filter(F.transform(records, lambda r: F.struct(r.alias("record"), _json_layout(r).alias("layout"))), lambda x: x["layout"].isNotNull()), F.lit(0))
    # The record itself, then the objects in it, then those in them.
    found = let(F.array(record), lambda one: F.coalesce(named(one), let(_inside(one), lambda two: F.coalesce(named(two), named(_inside(two))))))
    rows = df.select(F.col(id_col).alias("conv_id"), found.alias("__found")).select("conv_id", F.col("__found.layout").alias("layout"), F.col("__found.record").alias("__record"))
    rows = rows.withColumn("__value", F.try_parse_json("__record"))
    turns = F.lit(None).cast(TURNS)
    for name, layout in LAYOUTS.items():
        if layout.get("rows"):
            continue
        if "each" in layout:
            own = _json_turns(layout)
        else:
            own = _fields(layout, lambda p: F.get_json_object("__record", f"$.{p}"))
        turns = F.when(F.col("layout") == name, own).otherwise(turns)
    return rows.select("conv_id", "layout", turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")  # at each doubled backslash
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(chats: DataFrame) -> DataFrame:
    """chats: conv_id, turns. Adds formatted, and mask: (before, text, after, loss) of each turn."""
    written = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    rows = chats.withColumn("__written", written)
    formatted = F.array_join(F.transform("__written", lambda w: F.concat(F.lit(START), w["role"], F.lit("\n"), w["text"], F.lit(STOP + "\n"))), "")
    before = lambda w: F.length(w["role"]) + F.lit(len(START) + 1)
    mask = F.transform("__written", lambda w: F.struct(before(w).alias("before"), F.length(w["text"]).alias("text"), F.lit(len(STOP) + 1).alias("after"), w["loss"].alias("loss")))
    return rows.withColumn("formatted", formatted).withColumn("mask", mask).drop("__written")


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted and mask alone: turns (role, text), and loss_text, all text under the mask, unescaped."""
    pieces = F.slice(F.split("formatted", START.replace("|", r"\|")), 2, 2**31 - 1)  # turns without their START
    rows = formatted.withColumn("__pieces", pieces)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        text = F.substring(piece, cut + F.lit(1), F.length(piece) - cut - F.lit(len(STOP) + 1))
        return F.struct(unescape_role(F.substring(piece, F.lit(1), cut - F.lit(1))).alias("role"), unescape(text).alias("text"))

    masked = F.zip_with("__pieces", "mask", lambda p, m: F.when(m["loss"], unescape(F.substring(p, m["before"] - F.lit(len(START) - 1), m["text"]))).otherwise(""))
    return rows.withColumn("turns", F.transform("__pieces", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("__pieces")


def round_trip(chats: DataFrame) -> DataFrame:
    """Digests of what is read back from the output."""
    out = read_back(format_chats(chats).select("conv_id", "formatted", "mask"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
