"""Chat formatting that reads back to the same turns, with built-in functions only.

A conversation is rendered as one text: every turn is ``<|turn|>``, its role, a line end, its text, and
``<|end|>``. The grammar knows these marks in these places alone: the reader cuts at the ends, takes the turn mark off
each piece, cuts at the first line end, and reads nothing at all where a piece lacks its mark or line end
or holds any mark within. After rendering as it is, every conversation is read back and compared with its
source; where they differ, because a text or role holds a mark or a role a line end, it is rendered again
with its contents escaped and ``<|esc|>`` in front, and compared again. Escaping writes ``%`` as ``%25``,
``<|`` as ``%3C|``, and a line end in a role as ``%0A``; no marks are left then, and undoing it in the
opposite order gives the source. Should a conversation still differ, its row says so in ``same``.

Turns are ordered by number, null first, ties by role, then text. Null texts and roles are empty.
Rows of a null conversation id are one conversation. Repeated rows are turns of their own. Extra
columns do not matter. An empty table gives no rows. A conversation is one text and one row,
whatever its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END, ESCAPED = "<|turn|>", "<|end|>", "<|esc|>"
TRAINED = "assistant"
ESCAPES = (("%", "%25"), ("<|", "%3C|"))
EXTRA = (
    (-1, 0, "user", "</s>[INST] ok [/INST]"),
    (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
)


def escaped(text: Column, *more: tuple[str, str]) -> Column:
    for plain, safe in (*ESCAPES, *more):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in (("\n", "%0A"), *reversed(ESCAPES)):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def rendered(turns: Column, escape: bool) -> Column:
    def turn(t: Column) -> Column:
        role, text = t["role"], t["text"]
        if escape:
            role, text = escaped(role, ("\n", "%0A")), escaped(text)
        return F.concat(F.lit(TURN), role, F.lit("\n"), text, F.lit(END))

    body = F.array_join(F.transform(turns, turn), "")
    return F.concat(F.lit(ESCAPED), body) if escape else body


def is_escaped(formatted: Column) -> Column:
    return F.startswith(formatted, F.lit(ESCAPED))


def cut_at_ends(formatted: Column) -> Column:
    """The turns without their end marks, and what is behind the last."""
    body = F.when(is_escaped(formatted), F.substr(formatted, F.lit(len(ESCAPED) + 1))).otherwise(formatted)
    return F.split(body, r"<\|end\|>", -1)


def pieces(formatted: Column) -> Column:
    """The turns without their end marks."""
    cut = cut_at_ends(formatted)
    return F.slice(cut, 1, F.size(cut) - 1)


def well_formed(formatted: Column) -> Column:
    """Whether a text follows the grammar: every mark in its place, and no other."""

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(TURN) + 1))
        marks = [F.contains(inner, F.lit(mark)) for mark in (TURN, END, ESCAPED)]
        return F.startswith(piece, F.lit(TURN)) & F.contains(inner, F.lit("\n")) & ~reduce(Column.__or__, marks)

    return F.forall(pieces(formatted), turn) & (F.element_at(cut_at_ends(formatted), -1) == "")


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation, from its text alone; null where it breaks the grammar."""
    safe = is_escaped(formatted)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(TURN) + 1))
        line = F.instr(inner, "\n")
        role, text = F.substr(inner, F.lit(1), line - 1), F.substr(inner, line + 1)
        return F.struct(
            F.when(safe, unescaped(role)).otherwise(role).alias("role"),
            F.when(safe, unescaped(text)).otherwise(text).alias("text"),
        )

    return F.when(well_formed(formatted), F.transform(pieces(formatted), turn))


def loss_mask(formatted: Column) -> Column:
    """``start`` and ``length``, in characters, of the texts to be learned, in order."""
    skip = F.when(is_escaped(formatted), F.lit(len(ESCAPED))).otherwise(F.lit(0))
    head = f"{TURN}{TRAINED}\n"
    start = F.struct(skip.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        span = F.struct((state["at"] + len(head)).alias("start"), (F.length(piece) - len(head)).alias("length"))
        more = F.when(F.startswith(piece, F.lit(head)), F.array(span)).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct(
            (state["at"] + F.length(piece) + len(END)).alias("at"), F.concat(state["spans"], more).alias("spans")
        )

    return F.aggregate(pieces(formatted), start, step)["spans"]


def under_mask(formatted: Column, mask: Column) -> Column:
    """The masked text as its author wrote it."""
    texts = F.transform(mask, lambda m: F.substr(formatted, m["start"] + 1, m["length"]))
    return F.array_join(F.when(is_escaped(formatted), F.transform(texts, unescaped)).otherwise(texts), "")


def formatted_conversations(table: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``turns`` (read back from it), ``mask`` and ``same``."""
    rows = table.select(
        "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    source = (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("source"))
    )
    plain = source.withColumn("plain", rendered(F.col("source"), False))
    checked = plain.withColumn("alike", parsed(F.col("plain")).eqNullSafe(F.col("source")))
    final = checked.select(
        "conv_id", "source",
        F.when(F.col("alike"), F.col("plain")).otherwise(rendered(F.col("source"), True)).alias("formatted"),
    )
    read = final.withColumn("turns", parsed(F.col("formatted"))).withColumn("mask", loss_mask(F.col("formatted")))
    return read.select("conv_id", "formatted", "turns", "mask", F.col("turns").eqNullSafe(F.col("source")).alias("same"))


def with_extra(table: DataFrame) -> DataFrame:
    """The table and one more conversation, whose texts look like control strings."""
    schema = "conv_id long, turn long, role string, text string"
    extra = table.sparkSession.createDataFrame(list(EXTRA), schema)
    return table.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    ).unionByName(extra)


def conversation_digests(table: DataFrame) -> DataFrame:
    """One row per conversation of the table and the extra one, all taken from the rendered texts."""
    read = formatted_conversations(with_extra(table))
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = under_mask(F.col("formatted"), F.col("mask"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
safe as (
  select *, replace(replace(replace(role, '%', '%25'), '<|', '%3C|'), chr(10), '%0A') as safe_role,
    replace(replace(text, '%', '%25'), '<|', '%3C|') as safe_text from rows),
whole as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(16 + length(role) + length(text))::bigint as plain,
    7 + sum(16 + length(safe_role) + length(safe_text))::bigint as safe,
    bool_or(regexp_matches(text, '<\|(turn|end|esc)\|>') or regexp_matches(role, '<\|(turn|end|esc)\|>|\n')) as conflict
  from safe group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  case when conflict then safe else plain end as formatted_chars
from whole
"""
