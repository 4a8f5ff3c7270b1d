"""Fill-in-middle transformation by a table-driven byte automaton.

A text is cut into units: white space with the word that follows it, or the white space at the end. The
automaton reads UTF-8 bytes by class (white space, ``<``, one of ``PSM``, ``>``, continuation byte, any other)
and its moves say where a unit starts, where a code point starts and where a sentinel ends. One scan counts
moves, which gives the number of units, of code points and of sentinels; a second scan goes over the blocks of
the text until both cuts are found. Where the automaton is after two bytes doesn't depend on where it was before
them, so a block's moves are looked up for all of its bytes at once; blocks hand on the state.

Cuts and form are drawn from the SHA-256 of ``SEED:doc_id``: a prefix, a middle and a suffix are put in order with
sentinels before each (psm: prefix, suffix, middle; spm: suffix, prefix, middle), or the text stays as it is
(plain): so do empty texts and texts that hold a sentinel, which makes the form reversible.

Cases: a null text is empty, so plain and of no units; white space alone is one unit; a null doc_id is drawn for
as an empty one. A row is one row of the result, so rows that share a doc_id are cut at places of one draw and
repeated rows give repeated results. A long text is scanned by blocks of ``BLOCK`` bytes. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Per cent of texts that are transformed, and of those the ones that put the suffix first.
RATE = 50
SUFFIX_FIRST = 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 1 << 20
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

SPACE, OPEN, LETTER, CLOSE, CONTINUED, OTHER = range(6)
#: States: nothing read, in white space, in a word, in a word that ends in "<", and in one that ends in "<" and a letter.
BEGIN, BLANK, WORD, OPENED, NAMED = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[0x80:0xC0] = CONTINUED
    out[ord("<")], out[ord(">")], out[list(b"PSM")] = OPEN, CLOSE, LETTER
    return out


def _next(state: int, kind: int) -> int:
    if kind == SPACE:
        return BLANK
    if kind == OPEN:
        return OPENED
    return NAMED if kind == LETTER and state == OPENED else WORD


CLASS = _classes()
#: The state after a class, by state; a move is a state and the class that is read in it.
NEXT = np.array([[_next(s, k) for k in range(6)] for s in range(5)], np.uint8)
#: The state after two classes, whatever it was before them.
AFTER = NEXT[NEXT[BEGIN], :]
STARTS_UNIT = np.array([s == BEGIN or (s != BLANK and k == SPACE) for s in range(5) for k in range(6)])
STARTS_CODE = np.array([k != CONTINUED for s in range(5) for k in range(6)])
ENDS_SENTINEL = np.array([s == NAMED and k == CLOSE for s in range(5) for k in range(6)])


def moves(block: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The move at each byte of a block that is read from a state, and the state after it."""
    kind = CLASS[block]
    at = np.empty(len(kind), np.uint8)
    at[:1] = state
    at[1:2] = NEXT[state, kind[:1]][: len(kind) - 1]
    at[2:] = AFTER[kind[:-2], kind[1:-1]]
    return at * np.uint8(6) + kind, int(NEXT[at[-1], kind[-1]])


def _scanned(text: bytes):
    """(place of the block, its moves) of a text."""
    data, state = np.frombuffer(text, np.uint8), BEGIN
    for k in range(0, len(data), BLOCK):
        made, state = moves(data[k : k + BLOCK], state)
        yield k, made


def counted(text: bytes) -> np.ndarray:
    """How often each move is made."""
    return sum((np.bincount(made, minlength=30) for _, made in _scanned(text)), np.zeros(30, np.int64))


def located(text: bytes, units: list[int]) -> list[tuple[int, int]]:
    """(byte, code point) at which each of the units, counted from 0 and in order, starts; the end for the number of all."""
    out: list[tuple[int, int]] = []
    seen = chars = 0
    for k, made in _scanned(text):
        starts = np.flatnonzero(STARTS_UNIT[made])
        while len(out) < len(units) and units[len(out)] < seen + len(starts):
            at = int(starts[units[len(out)] - seen])
            out.append((k + at, chars + int(STARTS_CODE[made[:at]].sum())))
        if len(out) == len(units):
            return out
        seen, chars = seen + len(starts), chars + int(STARTS_CODE[made].sum())
    return out + [(len(text), chars)] * (len(units) - len(out))


def draws(doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digits = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(doc_id: int | None, text: bytes | None, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    text = text or b""
    made, (h1, h2, h3, h4) = counted(text), draws(doc_id)
    n = int(made[STARTS_UNIT].sum())
    if not text or made[ENDS_SENTINEL].any() or h3 % 100 >= rate:
        return n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = located(text, sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transform(spark: SparkSession, docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null for plain) and output of each document."""
    common.small_batches(spark)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [transformed(i, t.as_py(), rate, suffix_first) for i, t in zip(ids, batch.column(1), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [[]] * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(common.trimmed(run), OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part of it holds a sentinel, so each mark is the only one."""
    width = len(PREFIX)
    second = F.when(form == "psm", F.lit(SUFFIX.decode())).otherwise(F.lit(PREFIX.decode()))
    before, upto = F.call_function("locate", second, output), F.call_function("locate", F.lit(MIDDLE.decode()), output)
    one = F.substring(output, F.lit(width + 1), before - width - 1)
    two = F.substring(output, before + width, upto - before - width)
    middle = F.substring(output, upto + width, F.length(output))
    whole = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(whole)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(spark, common.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
