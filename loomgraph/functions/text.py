"""Scalar functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import NO_FILE, NO_LINES, PREAMBLES, STOPWORDS

WORD = r"[A-Za-z_][A-Za-z0-9_]*|\d+"
CAMEL = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
#: Pieces of words in a whole text, where digits that a word doesn't begin before are a word of their own.
PIECE = r"(?<![A-Za-z0-9_])\d+|" + CAMEL
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
IDENT = r"(?U)[A-Za-z_]\w*"
QUALIFIED = r"(?U)\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\b"


def split_identifier(word: Column) -> Column:
    """The lower-cased word, then its camel-case and underscore pieces; a plain word comes twice."""
    pieces = F.regexp_extract_all(word, F.lit(CAMEL), F.lit(0))
    return F.concat(F.array(F.lower(word)), F.transform(pieces, F.lower))


def tokenize(text: Column, keep_stopwords: bool = False) -> Column:
    """Search tokens of a text: pieces of its words, at least two characters long; null has none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    tokens = F.filter(F.flatten(F.transform(words, split_identifier)), lambda t: F.length(t) >= 2)
    return tokens if keep_stopwords else F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def terms(text: Column, keep_stopwords: bool = False) -> Column:
    """The tokens of a text in an order of their own: words, then pieces. For what counts them; words and pieces are read in a pass
    over the whole text each, not word by word: a number of its own begins no piece, and no piece reaches over a word's end."""
    whole = F.coalesce(text, F.lit(""))
    both = F.concat(*(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)) for pattern in (WORD, PIECE)))
    tokens = F.filter(F.split(F.lower(F.array_join(both, " ")), " "), lambda t: F.length(t) >= 2)
    return tokens if keep_stopwords else F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def read_text(content: Column) -> Column:
    """Text of a file's bytes: malformed UTF-8 replaced, all line ends as line feeds."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def count_lines(text: Column) -> Column:
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def without_leading_dots(path: Column) -> Column:
    """A path as citations compare it: forward slashes, no leading dots and slashes."""
    return F.regexp_replace(posix(path), r"^[./]+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def first_line_signature(text: Column, limit: int = 160) -> Column:
    line = F.get(F.split(F.get(F.split(text, r"\{"), 0), "\n"), 0)
    return F.substring(F.trim(F.regexp_replace(line, r"\s+", " ")), 1, limit)


def lines_of(text: Column) -> Column:
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def snippet(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, both included); a note where the file or the lines are missing."""
    lines = lines_of(text)
    start = F.greatest(first, F.lit(1))
    inside = (start <= F.size(lines)) & (last >= start)
    cut = F.array_join(F.slice(lines, start, F.greatest(last - start + 1, F.lit(0))), "\n")
    return F.when(text.isNull(), F.lit(NO_FILE)).when(inside, cut).otherwise(F.lit(NO_LINES))


def document_for(qualified: Column, name: Column, type_: Column, signature: Column, doc: Column, file: Column) -> Column:
    parts = F.array(*(F.coalesce(c, F.lit("")) for c in (qualified, name, F.replace(type_, F.lit("_"), F.lit(" ")), signature, doc, file)))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles over their common length; 0 where either norm is 0."""
    n = F.least(F.size(a), F.size(b))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)) / norms)


def normalize_answer(raw: Column) -> Column:
    """An answer without leaked reasoning: from the last ``ANSWER:`` on, else without a known preamble."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", ""), F.lit(" \n\t\r"))
    out = F.when(F.contains(text, F.lit("ANSWER:")), F.trim(F.concat(F.lit("ANSWER:"), F.substring_index(text, "ANSWER:", -1)), F.lit(" \n\t\r")))
    for preamble in PREAMBLES:
        rest = F.trim(F.regexp_replace(F.substring(text, len(preamble) + 1, 1 << 30), r"^[ \n:]+", ""), F.lit(" \n\t\r"))
        out = out.when(F.startswith(text, F.lit(preamble)), F.when(rest == "", text).otherwise(rest))
    return out.otherwise(text)


def escape_dot(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def endpoints_text(endpoints: Column) -> Column:
    """``name [resolution]``, with `` xN`` where N > 1, of an array of structs in order."""
    return F.array_join(
        F.transform(endpoints, lambda e: F.concat(e["name"], F.lit(" ["), e["resolution"], F.lit("]"), F.when(e["count"] > 1, F.concat(F.lit(" x"), e["count"].cast("string"))).otherwise(F.lit("")))), ", "
    )
