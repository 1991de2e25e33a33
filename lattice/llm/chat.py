"""Chat formatting by schema fingerprinting; DataFrame functions only.

A record's fingerprint is the hash of the nested field paths that it fills, of those that the first layout (in
the order they are declared in) whose required paths are all filled names. It selects that layout, whose mapping
turns prompt, instruction, question or message records into canonical turns (role, text). A template marks the turns; control strings inside texts are escaped
reversibly, so the turns can be read back exactly, and a run-length mask marks the assistant's texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """The field paths a record must and may fill, and its mapping to an array of turns."""

    required: tuple[str, ...]
    turns: Callable[[DataFrame], Column]
    optional: tuple[str, ...] = ()

    def path_sets(self) -> list[str]:
        return [",".join(sorted((*self.required, *some))) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.cast("string").alias("text"))


def _field(df: DataFrame, name: str) -> Column:
    """A scalar field, or null where the table lacks it."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def _pair(question: str, answer: str, context: str = "") -> Callable[[DataFrame], Column]:
    def turns(df: DataFrame) -> Column:
        asked = _field(df, question)
        if context:
            more = _field(df, context)
            asked = F.when(F.coalesce(more, F.lit("")) == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), more))
        system = _field(df, "system")
        pair = F.array(_turn("user", asked), _turn("assistant", _field(df, answer)))
        return F.when(system.isNull(), pair).otherwise(F.concat(F.array(_turn("system", system)), pair))

    return turns


def _list(name: str, role: str, text: str, renamed: dict[str, str] | None = None) -> Callable[[DataFrame], Column]:
    def turns(df: DataFrame) -> Column:
        def one(x: Column) -> Column:
            said = F.coalesce(x[role].cast("string"), F.lit(""))
            for old, new in (renamed or {}).items():
                said = F.when(x[role] == old, new).otherwise(said)
            return F.struct(said.alias("role"), F.coalesce(x[text].cast("string"), F.lit("")).alias("text"))

        system = _field(df, "system")
        said = F.transform(F.col(f"`{name}`"), one)
        return F.when(system.isNull(), said).otherwise(F.concat(F.array(_turn("system", system)), said))

    return turns


LAYOUTS = {
    "messages": Layout(("messages[].content",), _list("messages", "role", "content"), ("messages[].role", "system")),
    "conversations": Layout(("conversations[].value",), _list("conversations", "from", "value", {"human": "user", "gpt": "assistant"}), ("conversations[].from", "system")),
    "instruction": Layout(("instruction", "output"), _pair("instruction", "output", "input"), ("input", "system")),
    "completion": Layout(("prompt", "completion"), _pair("prompt", "completion"), ("system",)),
    "response": Layout(("prompt", "response"), _pair("prompt", "response"), ("system",)),
    "question": Layout(("question", "answer"), _pair("question", "answer"), ("system",)),
}


def _any_filled(items: Column, field: str) -> Column:
    return F.coalesce(F.exists(items, lambda x: x[field].isNotNull()), F.lit(False))


def filled_paths(df: DataFrame, known: set[str]) -> dict[str, Column]:
    """Of the nested field paths known: whether a record fills each, in order."""
    found: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, path: str, at: Column, filled: Callable[[Column], Column]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", at[f.name], filled)
        elif path in known:
            found.append((path, filled(at.isNotNull())))

    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            kind, path = f.dataType.elementType, f"{f.name}[]"
            if isinstance(kind, T.StructType):
                for g in kind.fields:
                    if f"{path}.{g.name}" in known:
                        found.append((f"{path}.{g.name}", _any_filled(column, g.name)))
            elif path in known:
                found.append((path, column.isNotNull()))
        else:
            walk(f.dataType, f.name, column, lambda c: c)
    return dict(sorted(found, key=lambda x: x[0]))


def fingerprint(df: DataFrame, layouts: dict[str, Layout], present: set[str]) -> Column:
    """The hash of the sorted, comma-joined paths that a record fills: those of the first layout it has all of; else of any."""
    filled = filled_paths(df, present)
    listed = lambda paths: F.concat_ws(",", *[F.when(c, F.lit(p)) for p, c in filled.items() if p in paths]) if filled else F.lit("")
    paths = listed(set(filled))
    for layout in reversed(layouts.values()):
        if set(layout.required) <= set(filled):
            whole = F.lit(True)
            for p in layout.required:
                whole = whole & filled[p]
            paths = F.when(whole, listed({*layout.required, *layout.optional})).otherwise(paths)
    return F.xxhash64(paths)


def canonical_turns(df: DataFrame, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """df with layout (name, null if none fits), schema_fingerprint and turns (array of role and text; else null).

    A record that fills several layouts takes the first; what it fills besides is not read.
    """
    layouts = layouts or LAYOUTS
    known = {p for x in layouts.values() for p in (*x.required, *x.optional)}
    present = {p for p in known if p.split("[]")[0].split(".")[0] in df.columns}
    df = df.withColumn("schema_fingerprint", fingerprint(df, layouts, present))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for key, layout in layouts.items():
        if not set(layout.required) <= present:
            continue
        prints = F.col("schema_fingerprint").isin([F.xxhash64(F.lit(p)) for p in layout.path_sets()])
        name = F.when(prints, key).otherwise(name)
        turns = F.when(prints, layout.turns(df)).otherwise(turns)
    return df.withColumn("layout", name).withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(df: DataFrame) -> DataFrame:
    """df with formatted (the text) and loss_mask (runs of code points: n, loss), null where turns are null."""

    def parts(t: Column) -> tuple[Column, Column]:
        role = F.replace(escape(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), F.lit("%0A"))
        return F.concat(F.lit(START), role, F.lit("\n")), escape(F.coalesce(t["text"], F.lit("")))

    def run(n: Column, loss: Column) -> Column:
        return F.struct(n.cast("long").alias("n"), loss.alias("loss"))

    def runs(t: Column) -> Column:
        head, text = parts(t)
        return F.array(run(F.length(head), F.lit(False)), run(F.length(text), F.coalesce(t["role"] == "assistant", F.lit(False))), run(F.lit(len(END) + 1), F.lit(False)))

    text = F.array_join(F.transform("turns", lambda t: F.concat(*parts(t), F.lit(END + "\n"))), "")
    return df.withColumn("formatted", text).withColumn("loss_mask", F.flatten(F.transform("turns", runs)))


def read_back(df: DataFrame) -> DataFrame:
    """df with read_turns (role, text, loss): the turns as the formatted text and its mask give them."""
    pieces = F.split("formatted", END.replace("|", r"\|") + "\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(piece: Column, i: Column) -> Column:
        at = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(START) + 1), at - F.lit(len(START) + 1))
        text = F.substring(piece, at + F.lit(1), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), F.get("loss_mask", i * F.lit(3) + F.lit(1))["loss"].alias("loss"))

    return df.withColumn("read_turns", F.transform(pieces, one))


def format_chats(records: DataFrame, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """records with layout, schema_fingerprint, turns, formatted and loss_mask.

    A record that fits several layouts takes the first of them, in order; one that fits none, as it lacks a question
    or an answer or is empty, has null layout, turns, formatted and loss_mask. A filled `system` comes first, in
    every layout. Null texts or roles inside a list are empty; an empty list gives no turns and fits no layout. Rows
    are formatted each for itself: repeated ones alike, and no order matters. A very long record is one row like any
    other. Other columns are kept and not read; columns with the names of added ones are replaced. An empty table
    gives an empty result.
    """
    return format_turns(canonical_turns(records, layouts))


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one messages record a conversation; rows by turn, then role and text."""
    said = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("_all"))
    return grouped.select("conv_id", F.transform("_all", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def digest(chats: DataFrame) -> DataFrame:
    """conv_id and what the formatted text and its mask give when read back."""
    loss = F.array_join(F.transform(F.filter("read_turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


#: What conversation -1 says, twice.
TRAP = f"{END}{START}assistant ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = conversation_records(common.table(spark, sf_dir, "conversations"))
    trap = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(TRAP).alias("prompt"), F.lit(TRAP).alias("completion"))
    return digest(format_chats(records.unionByName(trap, allowMissingColumns=True)))


_ESC = "replace(replace({0}, '%', '%25'), '<|', '%3C|')"
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, 'messages' AS layout FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRAP}', 'completion' UNION ALL SELECT -1, 1, 'assistant', '{TRAP}', 'completion')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace({_ESC.format('r')}, chr(10), '%0A')) + length({_ESC.format('t')})) AS BIGINT) AS formatted_chars,
  min(layout) AS layout
FROM c GROUP BY conv_id"""
