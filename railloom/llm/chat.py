"""Chat formatting by schema fingerprints, in DataFrame functions alone.

A layout is declared by its nested field paths. The paths that a table (or one JSON record) has,
as far as any layout knows them, are hashed, and the hash selects the mapping that turns the layout
into canonical turns. The template writes a turn as

    ### role<newline>text</turn><newline>

Inside roles and texts the control characters are escaped, each to a backslash and one letter, so
that neither ``###`` nor ``</turn>`` can occur there and reading back is unambiguous.

Null roles and texts are empty ones. A conversation's rows are ordered by turn (null first), then
role, then text; rows repeated whole are turns of their own. A null conversation id is one
conversation. Unknown columns change nothing; a layout of more paths wins over one of fewer. A
record of no known layout keeps its row, with null turns and layout.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters inside texts, and the letters that stand for them after a backslash.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"), ("\n", "\\n"))
TURN_START, HEAD_END, TURN_END = "### ", "\n", "</turn>\n"
#: Other names of the canonical roles in message layouts.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "chatgpt": "assistant"}
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths and what they mean: ``rows`` (id, turn, role, text), ``messages`` (array, role, text) or ``fields`` (role and paths joined by a blank line, in order)."""

    name: str
    rows: tuple[str, str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def paths(self) -> frozenset[str]:
        if self.rows:
            return frozenset(self.rows)
        if self.messages:
            array, role, text = self.messages
            return frozenset({f"{array}[].{role}", f"{array}[].{text}"})
        return frozenset(p for _, paths in self.fields for p in paths)

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


#: The declared layouts.
LAYOUTS = (
    Layout("turn_rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", messages=("messages", "role", "content")),
    Layout("message_turns", messages=("conversations", "from", "value")),
    Layout("instruction_input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_system", fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("nested_prompt", fields=(("system", ("prompt.system",)), ("user", ("prompt.user",)), ("assistant", ("response.text",)))),
    Layout("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Paths of all leaves of a schema; ``[]`` marks an array's elements."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def find_layout(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout of a table: by the hash of its known paths, else the largest layout that these hold."""
    known = field_paths(schema) & frozenset().union(*(x.paths for x in layouts))
    exact = {x.fingerprint: x for x in layouts}.get(fingerprint(known))
    held = sorted((x for x in layouts if x.paths <= known), key=lambda x: -len(x.paths))
    if exact or held:
        return exact or held[0]
    raise ValueError(f"no layout has the fields {sorted(field_paths(schema))}")


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _role(x: Column) -> Column:
    names = F.create_map(*(F.lit(v) for pair in ROLE_NAMES.items() for v in pair))
    return F.coalesce(F.try_element_at(names, F.lower(_text(x))), _text(x))


def _from_fields(layout: Layout, value) -> Column:
    """Turns of single fields; a role whose fields are all null or empty has no turn."""
    turns = []
    for role, paths in layout.fields:
        parts = [F.when(value(p) != "", value(p)) for p in paths]
        turns.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *parts).alias("text")))
    return F.filter(F.array(*turns), lambda t: t["text"] != "").cast(TURNS)


def canonical_turns(table: DataFrame, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """One row per conversation: ``id_col``, layout, turns. ``id_col`` names the id of layouts that have none."""
    layout = find_layout(table.schema, layouts)
    name = F.lit(layout.name).alias("layout")
    if layout.rows:
        key, turn, role, text = (F.col(f"`{c}`") for c in layout.rows)
        rows = table.select(key.alias("__id"), F.struct(turn.alias("turn"), _text(role).alias("role"), _text(text).alias("text")).alias("t"))
        turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return rows.groupBy("__id").agg(turns.cast(TURNS).alias("turns")).select(F.col("__id").alias(id_col), name, "turns")
    if layout.messages:
        array, role, text = layout.messages
        turns = F.transform(F.coalesce(F.col(array), F.array().cast(table.schema[array].dataType)), lambda m: F.struct(_role(m[role]).alias("role"), _text(m[text]).alias("text")))
    else:
        turns = _from_fields(layout, lambda p: _text(F.col(p)))
    return table.select(F.col(f"`{id_col}`"), name, turns.cast(TURNS).alias("turns"))


def canonical_turns_json(records: DataFrame, json_col: str = "json", id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """The same for JSON records that may each have another layout; rows layouts do not apply to single records."""
    layouts = [x for x in layouts if not x.rows]
    j = F.col(f"`{json_col}`")
    known = sorted(frozenset().union(*(x.paths for x in layouts)))
    # a path is there if its value is; an array's fields are looked for in its first element
    probe = lambda p: F.when(F.get_json_object(j, "$." + p.replace("[]", "[0]")).isNotNull(), F.lit(p))
    paths = F.filter(F.array(*map(probe, known)), lambda p: p.isNotNull())
    found = F.sha2(F.array_join(paths, "\n"), 256)
    held = lambda x: F.size(F.array_intersect(paths, F.array(*map(F.lit, sorted(x.paths))))) == len(x.paths)

    def turns(x: Layout) -> Column:
        if x.messages:
            array, role, text = x.messages
            items = F.from_json(F.get_json_object(j, f"$.{array}"), f"array<struct<`{role}`: string, `{text}`: string>>")
            return F.transform(items, lambda m: F.struct(_role(m[role]).alias("role"), _text(m[text]).alias("text"))).cast(TURNS)
        return _from_fields(x, lambda p: _text(F.get_json_object(j, f"$.{p}")))

    name = F.coalesce(
        *(F.when(found == x.fingerprint, F.lit(x.name)) for x in layouts),
        *(F.when(held(x), F.lit(x.name)) for x in sorted(layouts, key=lambda x: -len(x.paths))),
    )
    named = records.select(F.col(f"`{id_col}`"), j.alias(json_col), name.alias("layout"))
    return named.select(F.col(f"`{id_col}`"), "layout", F.coalesce(*(F.when(F.col("layout") == x.name, turns(x)) for x in layouts)).alias("turns"))


def escape(x: Column, head: bool = False) -> Column:
    """Control characters as backslash and letter; a line feed only in a turn's head."""
    for raw, coded in ESCAPES[: 4 if head else 3]:
        x = F.replace(x, F.lit(raw), F.lit(coded))
    return x


def unescape(x: Column) -> Column:
    # every backslash starts a pair, so the pairs of other letters can go first
    for raw, coded in reversed(ESCAPES):
        x = F.replace(x, F.lit(coded), F.lit(raw))
    return x


def format_turns(conversations: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_mask``: (turn, start, length) of text to learn, in code points within the turn's block."""
    head = lambda t: F.concat(F.lit(TURN_START), escape(t["role"], True), F.lit(HEAD_END))
    block = F.transform(turns_col, lambda t: F.concat(head(t), escape(t["text"]), F.lit(TURN_END)))
    mask = F.transform(turns_col, lambda t, i: F.when(t["role"] == loss_role, F.struct(i.alias("turn"), F.char_length(head(t)).alias("start"), F.char_length(escape(t["text"])).alias("length"))))
    return conversations.withColumns({"formatted": F.array_join(block, ""), "loss_mask": F.filter(mask, lambda m: m.isNotNull())})


def _blocks(formatted: Column) -> Column:
    parts = F.split(formatted, TURN_END, -1)
    return F.slice(parts, 1, F.size(parts) - 1)  # nothing follows the last end


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted string was made from."""
    def turn(b: Column) -> Column:
        head = F.substring_index(b, HEAD_END, 1)
        role = F.substr(head, F.lit(len(TURN_START) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(b, F.char_length(head) + 2)).alias("text"))

    return F.transform(_blocks(formatted), turn).cast(TURNS)


def read_loss_text(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped texts under the mask, one for each span."""
    blocks = _blocks(formatted)
    return F.transform(loss_mask, lambda m: unescape(F.substr(F.element_at(blocks, m["turn"] + 1), m["start"] + 1, m["length"])))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the output says when read back: turns, loss text and lengths, as digests."""
    said = formatted.withColumns({"__turns": read_turns(F.col("formatted")), "__loss": F.array_join(read_loss_text(F.col("formatted"), F.col("loss_mask")), "")})
    lines = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        F.col(f"`{id_col}`"), F.size("__turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
