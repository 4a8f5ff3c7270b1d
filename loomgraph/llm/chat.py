"""Chat formatting by prefix-target expansion.

A turn is written as ``### role: text </turn>`` and a line feed. Inside roles and texts a backslash,
``###`` and ``</turn>`` get a backslash before them (inside roles a colon too), and dropping the first
backslash of each pair reads them back. Each assistant turn becomes an example of its own: all turns
before it as context, its own turn as target, and a loss mask over that reply's text alone. Where other
turns follow the last reply, one more example without a target holds the whole conversation.

Conversations are sorted by turn within a partition and streamed, so no group is gathered; an example
is one row, so memory is bounded by the longest conversation.

Cases: a null text is empty, a null role reads back as empty; rows of one turn come in order of role
and text, and repeated rows stay turns of their own. Null conversation ids form one conversation. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EXAMPLES = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long, whole boolean"
END = " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: A turn: its role and its text, neither of which has the marks without a backslash before them.
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)
_FLUSH = 4 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns, read back from a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end", "whole"])


def _expand(batches):
    """Examples of conversations whose rows come together and in order."""
    rows, size, now, held = [], 0, object(), None

    def closed():
        """The last example is known to be the last only now."""
        conv, prefix, turns, made, example = held
        if example is not None and example[2] == turns:
            return [(*example, True)]
        return ([(*example, False)] if example else []) + [(conv, made, turns, prefix, 0, 0, True)]

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or conv != now:
                if held:
                    rows += closed()
                now, held = conv, [conv, "", 0, 0, None]
            head = "### " + _ROLE.sub(lambda m: "\\" + m[0], role or "") + ": "
            body = escape(text or "")
            start = len(held[1]) + len(head)
            held[1] += head + body + END
            held[2] += 1
            if role == "assistant":
                if held[4]:
                    rows.append((*held[4], False))
                    size += len(held[4][3])
                held[4] = (conv, held[3], held[2], held[1], start, start + len(body))
                held[3] += 1
            if size >= _FLUSH or len(rows) >= 5000:
                yield _batch(rows)
                rows, size = [], 0
    yield _batch(rows + (closed() if held else []))


def examples(conversations: DataFrame) -> DataFrame:
    """Training examples of each conversation: text, and the span of it (code points) under the loss
    mask, empty where an example only holds the turns after the last reply. Batches are bounded by bytes, for long texts."""
    common.small_batches(conversations.sparkSession)
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_expand, EXAMPLES)


def _digest(batches):
    """Digests read back from the examples of each conversation."""
    out: list[tuple] = []
    now, loss, chars, total = None, None, 0, 0
    for batch in batches:
        for conv, _, _, text, start, end, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if loss is None:
                now, loss, chars, total = conv, hashlib.sha256(), 0, 0
            reply = unescape(text[start:end])
            loss.update(reply.encode())
            chars += len(reply)
            total += len(text)
            if whole:
                turns = turns_of(text)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((now, len(turns), sha, chars, loss.hexdigest(), total))
                loss = None
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(made: DataFrame) -> DataFrame:
    """One row for each conversation, read back from ``examples``."""
    return made.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(examples(talks.unionByName(more)))
