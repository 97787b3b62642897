"""Chat formatting from event logs.

A log has events (conversation, seq, message, role, kind, text). Events are partitioned by
conversation, within it by message, and sorted by seq; a fold of each message's deltas, edits and
regenerations gives its final text; messages are rendered one by one into turns of a template,
whose pieces stand in the order of the messages. An event changes its own message only, so the
messages of a conversation that holds a third of a log are folded in many tasks, and a
conversation is never held as a whole: a task holds one message, and a running state where turns
are read in order.

Template of a turn: <s>[ROLE]role[/ROLE]text</s>. Control strings inside roles and texts, and
the escape character itself, are written as the escape character and a letter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Strings that a tokenizer may take for control, in this template or in others, by letter of their escape.
CONTROL = {
    "a": "<s>", "b": "</s>", "c": "[INST]", "d": "[/INST]", "e": "<<SYS>>", "f": "<</SYS>>", "g": "[ROLE]", "h": "[/ROLE]",
    "i": "<|im_start|>", "j": "<|im_end|>", "k": "<|endoftext|>", "l": "<|startoftext|>", "m": "<unk>", "n": "<pad>",
}
ESCAPE = "\\"
_LETTER = {v: k for k, v in CONTROL.items()} | {ESCAPE: ESCAPE}
_TO_ESCAPE = re.compile("|".join(map(re.escape, sorted(_LETTER, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
LEARNT_ROLE = "assistant"

EVENTS = "conv_id long, seq long, msg long, role string, kind string, text string"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: ESCAPE + _LETTER[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: CONTROL.get(m[1], m[1]), text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where the escaped text begins and ends in it."""
    head, body = f"<s>[ROLE]{escape(role)}[/ROLE]", escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, unescaped."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, msg, role, text: the final state of each message of the log.

    message and edit set the text, delta adds to it, regenerate empties it for the deltas that
    follow, delete takes the message away until a later event writes to it; other and null kinds
    are deltas. The last role that isn't null holds; null texts are empty. Events of equal seq
    are folded in the order of kind (deltas last) and text. An empty log has no messages.
    """
    rank = F.when(F.col("kind") == "delete", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind").isin("message", "edit"), 2).otherwise(3)
    ordered = (
        events.select("conv_id", "seq", "msg", "role", rank.alias("rank"), "text")
        .repartition("conv_id", "msg")
        .sortWithinPartitions("conv_id", "msg", F.col("seq").asc_nulls_first(), "rank", "text", "role")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, role, parts, gone = None, None, [], True
        out: list[tuple] = []
        for batch in batches:
            for conv, msg, new_role, rank_of, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "msg", "role", "rank", "text")), strict=True):
                if (conv, msg) != here:
                    if here and not gone:
                        out.append((*here, role, "".join(parts)))
                    here, role, parts, gone = (conv, msg), None, [], True
                role = new_role if new_role is not None else role
                if rank_of <= 2:
                    parts = []
                gone = rank_of == 0
                if rank_of >= 2 and text:
                    parts.append(text)
            if out:
                yield _rows(out, ("conv_id", "msg", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string()))
                out = []
        if here and not gone:
            yield _rows([(*here, role, "".join(parts))], ("conv_id", "msg", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string()))

    return ordered.mapInArrow(run, "conv_id long, msg long, role string, text string")


def _rows(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def format_turns(messages: DataFrame) -> DataFrame:
    """conv_id, msg, piece, loss_from, loss_to: each message as a turn of the template.

    loss_from and loss_to bound, in code points of the piece, what is learnt: the whole escaped
    text of an assistant, nothing (0, 0) of others. A null role is the empty role.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, msg, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "msg", "role", "text")), strict=True):
                piece, begin, end = render(role or "", text or "")
                out.append((conv, msg, piece, *((begin, end) if role == LEARNT_ROLE else (0, 0))))
            if out:
                yield _rows(out, ("conv_id", "msg", "piece", "loss_from", "loss_to"), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))

    return messages.select("conv_id", "msg", "role", "text").mapInArrow(run, "conv_id long, msg long, piece string, loss_from long, loss_to long")


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the pieces in order.

    A task reads its conversations' pieces one after another and holds two running digests.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "msg")
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, begun = None, False
        turns = loss = None
        n = learnt = size = 0
        line = lambda: (here, n, turns.hexdigest(), learnt, loss.hexdigest(), size)
        for batch in batches:
            out = []
            for conv, piece, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to")), strict=True):
                if not begun or conv != here:
                    if begun:
                        out.append(line())
                    here, begun, turns, loss, n, learnt, size = conv, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text in read_turns(piece):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                part = unescape(piece[begin:end])
                loss.update(part.encode())
                learnt += len(part)
                size += len(piece)
            if out:
                yield _rows(out, names, kinds)
        if begun:
            yield _rows([line()], names, kinds)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations_as_events(conversations: DataFrame) -> DataFrame:
    """Each row as a whole-message event. Rows with equal turn are messages of their own, ordered by role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return conversations.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text").select(
        "conv_id", "seq", F.col("seq").alias("msg"), "role", F.lit("message").alias("kind"), "text"
    )


def streamed(events: DataFrame) -> DataFrame:
    """The same messages as a live log has them: as deltas, edits, regenerations and deletions.

    events are whole messages. By half its msg, modulo 4, an assistant's text comes as three deltas; as a
    draft of two deltas, a regeneration and two deltas; as a draft and an edit; or as a delta, an
    edit of it and a last delta. Others come whole, or as a draft and an edit. Beside every fourth
    message stands one that is deleted again. Folding gives back what was streamed.
    """
    text, size = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    third, half = (size / 3).cast("int"), (size / 2).cast("int")
    part = lambda start, end: F.substring(text, start + 1, end - start)
    one = lambda k, kind, said, msg=2 * F.col("msg"): F.struct((F.col("seq") * 8 + k).alias("seq"), msg.alias("msg"), F.lit(kind).alias("kind"), said.alias("text"))
    draft, zero = F.concat(F.lit("draft: "), F.reverse(text)), F.lit(0)
    ways = (
        [one(0, "delta", part(zero, third)), one(1, "delta", part(third, 2 * third)), one(2, "delta", part(2 * third, size))],
        [one(0, "delta", F.lit("draft")), one(1, "delta", part(half, size)), one(2, "regenerate", F.lit(None).cast("string")), one(3, "delta", part(zero, half)), one(4, "delta", part(half, size))],
        [one(0, "message", draft), one(1, "edit", text)],
        [one(0, "delta", draft), one(1, "edit", part(zero, half)), one(2, "delta", part(half, size))],
    )
    way = F.pmod(F.floor(F.col("msg") / 2), F.lit(4))
    learnt = F.when(way == 0, F.array(*ways[0])).when(way == 1, F.array(*ways[1])).when(way == 2, F.array(*ways[2])).otherwise(F.array(*ways[3]))
    other = F.when(way < 2, F.array(one(0, "message", text))).otherwise(F.array(*ways[2]))
    gone = F.when(way == 3, F.array(one(5, "message", draft, 2 * F.col("msg") + 1), one(6, "delete", F.lit(None).cast("string"), 2 * F.col("msg") + 1))).otherwise(F.array())
    said = F.concat(F.when(F.col("role") == LEARNT_ROLE, learnt).otherwise(other), gone)
    return events.select("conv_id", "role", F.explode(said).alias("e")).select("conv_id", "e.seq", "e.msg", "role", "e.kind", "e.text")


def format_conversations(events: DataFrame) -> DataFrame:
    """The formatted pieces of a log's conversations, with where each begins in its conversation's string."""
    pieces = format_turns(fold_messages(events))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))


def op3_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digests(format_turns(fold_messages(streamed(conversations_as_events(conversations)))))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         length(regexp_replace(coalesce(text, ''), 'PATTERN', '\\_', 'g')) + length(regexp_replace(coalesce(role, ''), 'PATTERN', '\\_', 'g')) + 20 AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("PATTERN", _TO_ESCAPE.pattern)
