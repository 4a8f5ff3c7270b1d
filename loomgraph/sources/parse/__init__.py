"""Parsers as a table function: a file's text to rows of nodes, edges, calls and references.

Ids are prefixed by the file's path, so a file is parsed on its own and no state is shared; one Arrow pass
over the files emits all kinds of rows. A parser that fails yields a ``failure`` row beside what it had
found; it never stops the job."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import c, java, javascript, python_
from .sink import Sink

PARSERS = {"python": python_.parse, "javascript": javascript.parse, "java": java.parse, "c": c.parse}

NODE = pa.struct(
    [(n, pa.string()) for n in ("id", "name", "type", "language", "file")] + [("line_start", pa.int32()), ("line_end", pa.int32()), ("parent", pa.string()), ("hash", pa.string()), ("arity", pa.int32()), ("signature", pa.string()), ("doc", pa.string()), ("is_async", pa.bool_()), ("value_type", pa.string()), ("has_value_type", pa.bool_()), ("parse_error", pa.string())]
)
EDGE = pa.struct([("frm", pa.string()), ("to", pa.string()), ("type", pa.string()), ("external", pa.bool_()), ("resolution", pa.string())])
CALL = pa.struct([("frm", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("resolved", pa.string()), ("local", pa.bool_()), ("receiver", pa.bool_()), ("argc", pa.int32())])
REF = pa.struct([("frm", pa.string()), ("name", pa.string()), ("type", pa.string()), ("prefer_file", pa.bool_())])
FAILURE = pa.struct([("file", pa.string()), ("error", pa.string())])
KINDS = {"node": NODE, "edge": EDGE, "call": CALL, "ref": REF, "failure": FAILURE}
ROWS = pa.schema([("target", pa.string()), ("file", pa.string()), ("kind", pa.string()), ("n", pa.int32()), *KINDS.items()])


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"`{f.name}`:{_ddl(f.type)}" for f in t) + ">"
    return {"string": "string", "int32": "int", "bool": "boolean"}[str(t)]


def count_lines(text: str) -> int:
    return text.count("\n") + (1 if text and not text.endswith("\n") else 0)


def parse_text(path: str, language: str, text: str) -> Sink:
    """All rows of one file."""
    sink = Sink(path, language)
    digest = hashlib.sha256(text.encode()).hexdigest()[:16]
    sink.nodes.append({"id": path, "name": path.rpartition("/")[2], "type": "file", "language": language, "file": path, "line_start": 1, "line_end": count_lines(text), "parent": None, "hash": digest})
    try:
        PARSERS[language](text, sink)
    except Exception as e:  # a file's fault is a row of its own
        sink.failures.append({"file": path, "error": f"{type(e).__name__}: {e}"})
    return sink


def parse_files(files: DataFrame) -> DataFrame:
    """Rows (target, file, kind, n, node | edge | call | ref | failure) of files (target, path, text)."""
    from ...functions.constants import LANGUAGES
    from ...functions.text import posix, suffix

    languages = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    own = files.select("target", posix(F.col("path")).alias("path"), F.try_element_at(languages, suffix(F.col("path"))).alias("language"), F.col("text")).filter("language IS NOT NULL")

    def run(batches):
        for batch in batches:
            rows = []
            for target, path, language, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                sink = parse_text(path, language, text or "")
                for kind, values in (("node", sink.nodes), ("edge", sink.edges), ("call", sink.calls), ("ref", sink.refs), ("failure", sink.failures)):
                    rows += [{"target": target, "file": path, "kind": kind, "n": n, kind: v} for n, v in enumerate(values)]
            yield pa.RecordBatch.from_pylist(rows, schema=ROWS)

    return own.mapInArrow(run, ", ".join(f"`{f.name}` {_ddl(f.type)}" for f in ROWS))
