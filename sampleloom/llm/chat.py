"""Preference formatting: the common turns of a chosen and a rejected conversation are the prompt, the rest is masked text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: A turn as text; "<|" inside roles and texts is broken up, so that nobody can write a marker.
TURN = "<|{role}|>\n{text}<|end|>\n"
TRAINED = "assistant"
EXAMPLE = (
    "pair_id long, n_common int, prompt string, chosen string, chosen_mask array<struct<start:int,end:int>>, "
    "rejected string, rejected_mask array<struct<start:int,end:int>>, usable boolean"
)


def clean(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def render(turns: list[dict], at: int = 0) -> tuple[str, list[dict]]:
    """Text of turns, and the spans in code points that count in training: text and end marker of assistant turns."""
    out, spans = [], []
    for t in turns:
        role = clean(t["role"]) or "unknown"
        whole = TURN.format(role=role, text=clean(t["text"]))
        if role == TRAINED:
            spans.append({"start": at + len(role) + 5, "end": at + len(whole) - 1})
        out.append(whole)
        at += len(whole)
    return "".join(out), spans


def format_pair(chosen: list[dict] | None, rejected: list[dict] | None) -> tuple:
    """(n_common, prompt, chosen, its mask, rejected, its mask, usable) of two conversations."""
    chosen, rejected = chosen or [], rejected or []
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    prompt, _ = render(chosen[:n])
    (a, a_mask), (b, b_mask) = render(chosen[n:]), render(rejected[n:])
    return n, prompt, a, a_mask, b, b_mask, bool(a_mask and b_mask)


def preference_examples(pairs: DataFrame) -> DataFrame:
    """Rows EXAMPLE of pairs (pair_id, chosen, rejected: arrays of (role, text)).

    The longest common prefix of turns, equal in role and text, is the prompt, rendered once. The completions are the turns
    after it; a mask has the spans in its completion, in code points, of assistant texts with their end markers. usable
    is false if a completion has no assistant turn: equal conversations, one that is a prefix of the other, nulls and empty arrays.
    A null role is `unknown`, a null text empty. Long texts are rendered whole; pairs that repeat give their examples
    each; a null pair_id stays null. Other columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int32(), pa.string(), pa.string(), spans, pa.string(), spans, pa.bool_()]
        names = [c.split()[0] for c in EXAMPLE.split(", ")]
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                rows = [format_pair(a.as_py(), b.as_py()) for a, b in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=names)

    turns = "array<struct<role:string,text:string>>"
    return bounded_batches(pairs).select(F.col("pair_id").cast("long").alias("pair_id"), F.col("chosen").cast(turns).alias("chosen"), F.col("rejected").cast(turns).alias("rejected")).mapInArrow(run, EXAMPLE)


def conversations(turns: DataFrame) -> DataFrame:
    """One row (conv_id, turns) for each conv_id of turns (conv_id, turn, role, text), by turn, then role and text.

    A turn without conv_id belongs to no other and is a conversation of its own, with a null conv_id. Rows that repeat
    are turns that repeat; turns with equal numbers stand by role and text, nulls first. A conversation, however long,
    is one row, as its examples are. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    row = F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    plain = lambda t: F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
    one = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t")).select("conv_id", plain(F.col("t")))
    return one.unionByName(turns.where("conv_id is null").select("conv_id", plain(F.array(row))))


def stale_reply_pairs(convs: DataFrame) -> DataFrame:
    """Preference pairs for conversations without labelled preferences: (pair_id, chosen, rejected) for each.

    chosen is the conversation up to its last assistant turn. In rejected that turn has the text of the assistant turn
    before it, a reply to another question, or no text if there is none. Without an assistant turn both are the whole conversation.
    """
    n = F.size("turns")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == TRAINED)
    base = convs.where(n > 0).select("conv_id", "turns", places.alias("at"))
    last = F.when(F.size("at") > 0, F.element_at("at", -1)).otherwise(F.size("turns"))
    base = base.select("conv_id", "turns", "at", last.alias("last"))
    stale = F.when(F.size("at") > 1, F.expr("turns[at[size(at) - 2] - 1].text")).otherwise(F.lit(""))
    reply = F.struct(F.lit(TRAINED).alias("role"), stale.alias("text"))
    rejected = F.when(F.size("at") > 0, F.concat(F.slice("turns", 1, F.col("last") - 1), F.array(reply))).otherwise(F.col("turns"))
    return base.select(F.col("conv_id").alias("pair_id"), F.slice("turns", 1, F.col("last")).alias("chosen"), rejected.alias("rejected"))


#: DuckDB: the stale-reply pairs, their common turns and their texts.
CHAT_SQL = r"""
WITH t AS (SELECT conv_id, list({'role': coalesce(nullif(replace(role, '<|', '< |'), ''), 'unknown'), 'text': replace(coalesce(text, ''), '<|', '< |')} ORDER BY turn, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT conv_id, [{'role': coalesce(nullif(replace(role, '<|', '< |'), ''), 'unknown'), 'text': replace(coalesce(text, ''), '<|', '< |')}] FROM conversations WHERE conv_id IS NULL),
p AS (SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS spots FROM t),
q AS (SELECT conv_id, CASE WHEN len(spots) > 0 THEN turns[1:spots[-1]] ELSE turns END AS c,
  CASE WHEN len(spots) > 0 THEN turns[1:spots[-1] - 1] || [{'role': 'assistant', 'text': CASE WHEN len(spots) > 1 THEN turns[spots[-2]].text ELSE '' END}] ELSE turns END AS r FROM p),
n AS (SELECT *, len(list_filter(range(1, len(c) + 1), lambda i: len(list_filter(range(1, i + 1), lambda j: c[j] IS DISTINCT FROM r[j])) = 0)) AS k FROM q),
x AS (SELECT conv_id, k, list_transform(c, lambda z: '<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) AS ct, list_transform(r, lambda z: '<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) AS rt, c, r FROM n)
SELECT CAST(conv_id AS BIGINT) AS pair_id, CAST(k AS INTEGER) AS n_common, array_to_string(ct[1:k], '') AS prompt, array_to_string(ct[k + 1:], '') AS chosen,
  array_to_string(list_transform(list_filter(range(k + 1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: (len(array_to_string(ct[k + 1:i - 1], '')) + 14) || ':' || (len(array_to_string(ct[k + 1:i], '')) - 1)), ',') AS chosen_mask,
  array_to_string(rt[k + 1:], '') AS rejected,
  array_to_string(list_transform(list_filter(range(k + 1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: (len(array_to_string(rt[k + 1:i - 1], '')) + 14) || ':' || (len(array_to_string(rt[k + 1:i], '')) - 1)), ',') AS rejected_mask,
  len(list_filter(range(k + 1, len(c) + 1), lambda i: c[i].role = 'assistant')) > 0 AND len(list_filter(range(k + 1, len(r) + 1), lambda i: r[i].role = 'assistant')) > 0 AS usable
FROM x
"""
