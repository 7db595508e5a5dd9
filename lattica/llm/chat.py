"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``[INST]role[/INST]text</s>``. Inside roles and texts a backslash becomes ``\\s`` and the first
character of a control string becomes ``\\l`` (for <) or ``\\b`` (for [), so that no text can hold a control string and
every text can be read back. Every assistant turn makes an example of its own: all turns before it as context, and
only its text trainable, given as the start (from 1) and length of a span in characters. Turns that follow the last
assistant turn, or a conversation without one, make a last example with nothing trainable (null span), so that no turn
is lost.

Null texts and roles count as empty. Turns are ordered by turn, nulls first, then role and text; repeated rows are
turns each. A null conversation id is a conversation. Other columns are ignored; empty tables give no examples. A
conversation is one training document and is held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings and what their first characters become.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROLS = {"<s>": "\\ls>", "</s>": "\\l/s>", "[INST]": "\\bINST]", "[/INST]": "\\b/INST]"}


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    for control, safe in CONTROLS.items():
        c = F.replace(c, F.lit(control), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for short, plain in (("\\l", "<"), ("\\b", "["), ("\\s", "\\")):
        c = F.replace(c, F.lit(short), F.lit(plain))
    return c


def examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, example, n_turns, text, loss_start, loss_length), one row per example."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = df.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("__turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t.role), F.lit(CLOSE))
    whole = whole.select(
        conv,
        F.transform("__turns", lambda t: t.role).alias("__roles"),
        F.transform("__turns", lambda t: F.length(head(t)) + 1).alias("__heads"),
        F.transform("__turns", lambda t: F.concat(head(t), escape(t.text), F.lit(END))).alias("__parts"),
    )
    n = F.size("__parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("__roles", i) == "assistant") | (i == n))
    each = whole.select(conv, F.posexplode(ends).alias("example", "n_turns"), "__roles", "__heads", "__parts")
    trained = F.element_at("__roles", F.col("n_turns")) == "assistant"
    before = F.array_join(F.slice("__parts", F.lit(1), F.col("n_turns") - 1), "")
    last, start = F.element_at("__parts", F.col("n_turns")), F.element_at("__heads", F.col("n_turns"))
    return each.select(
        conv,
        "example",
        "n_turns",
        F.concat(before, last).alias("text"),
        F.when(trained, F.length(before) + start).alias("loss_start"),
        F.when(trained, F.length(last) - start + 1 - len(END)).alias("loss_length"),
    )


def turns(text: Column) -> Column:
    """The turns written in an example's text: an array of (role, text)."""
    parts = F.filter(F.split(text, END), lambda p: p != "")
    cut = lambda p: F.instr(p, CLOSE)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - 1 - len(OPEN))).alias("role"),
            unescape(F.substring(p, cut(p) + len(CLOSE), F.length(p))).alias("text"),
        ),
    )


def loss_text(text: Column, start: Column, length: Column) -> Column:
    """What the loss mask of an example covers, unescaped; null if nothing."""
    return unescape(F.substring(text, start, length))


def digests(found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from examples, per conversation."""
    loss = F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"))
    per = found.groupBy(F.col(conv).alias(conv)).agg(
        F.max_by("text", "example").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), loss))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    line = lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
    per = per.select(conv, turns(F.col("whole")).alias("t"), F.array_join(F.transform("losses", lambda x: x.loss), "").alias("loss"), "formatted_chars")
    return per.select(
        conv,
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: DuckDB SQL over a relation "turns" of (conv_id, turn, role, text): the same digests, reached without examples.
DIGEST_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k,
    count(*) over (partition by conv_id) as n
  from ({turns})
), e as (
  select *, 17 + length(replace(replace(replace(replace(replace(role, '\\', '\\s'), '<s>', '\\ls>'), '</s>', '\\l/s>'), '[INST]', '\\bINST]'), '[/INST]', '\\b/INST]'))
    + length(replace(replace(replace(replace(replace(text, '\\', '\\s'), '<s>', '\\ls>'), '</s>', '\\l/s>'), '[INST]', '\\bINST]'), '[/INST]', '\\b/INST]')) as size
  from t
), s as (
  select *, sum(size) over (partition by conv_id order by k) as so_far from e
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(so_far) filter (role = 'assistant' or k = n)::bigint as formatted_chars
from s group by conv_id
"""
