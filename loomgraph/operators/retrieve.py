"""Layered retrieval over a set of questions.

Each layer decides some questions and the next sees only the others (``left_anti``): qualified names, names
that no symbol has, exact names, BM25, vectors, and last a refusal with suggestions. Questions and what the
layers decide are small beside the graph; symbols are only ever met in equi-joins on names or terms.
"""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DATA_TYPES, FILE_EXTENSIONS, MAX_CONTEXT_NODES, MIN_EXACT_NAME, RETRIEVAL_B, ROLE_EXPAND, ROLE_WORDS
from ..functions.text import IDENT, QUALIFIED, document_for
from . import bm25
from .combinators import first_wins, top_k
from .graph import by_qualified_name, prefer_definitions, qualified_names, symbols

Q = ["target", "question_id"]
#: Characters of the prefixes on which words meet names.
HEAD = 16


def identifiers(question: Column) -> Column:
    return F.regexp_extract_all(question, F.lit(IDENT), F.lit(0))


def type_hints(questions: DataFrame) -> DataFrame:
    """(question_id, type) of the kinds of symbols that role words of a question stand for."""
    table = F.create_map(*(F.lit(x) for word, role in ROLE_WORDS.items() for x in (word, ",".join(ROLE_EXPAND.get(role, (role,))))))
    words = questions.select("question_id", F.explode(F.regexp_extract_all(F.lower("question"), F.lit("[a-z_]+"), F.lit(0))).alias("word"))
    return words.select("question_id", F.explode(F.split(F.try_element_at(table, F.col("word")), ",")).alias("type")).distinct()


def symbol_like(word: Column) -> Column:
    """How an identifier looks in a sentence: a camel hump, or an underscore in more than three characters."""
    return F.rlike(word, F.lit("[a-z][A-Z]")) | (F.contains(word, F.lit("_")) & (F.length(word) > 3))


def qualified_layer(questions: DataFrame, nodes: DataFrame, by_qualified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (question_id, target, rank, id) and refusals (question_id, target, reason) of ``Owner.member`` in questions."""
    dots = F.regexp_extract_all("question", F.lit(QUALIFIED), F.lit(0))
    pairs = questions.select(*Q, F.posexplode(dots).alias("place", "pair"))
    pairs = pairs.withColumn("owner", F.get(F.split("pair", r"\."), 0)).withColumn("member", F.get(F.split("pair", r"\."), 1))
    names = symbols(nodes).select("target", "name").distinct()
    # A pair whose owner no symbol is named after says nothing; one that ends as a file name does is a path.
    pairs = pairs.join(names.withColumnRenamed("name", "owner"), ["target", "owner"], "left_semi").filter(~F.lower("member").isin(*FILE_EXTENSIONS))
    direct = by_qualified.select("target", F.col("qualified").alias("pair"), F.col("id").alias("direct"))
    known = names.select("target", F.col("name").alias("member"), F.lit(True).alias("known"))
    pairs = pairs.join(direct, ["target", "pair"], "left").join(known, ["target", "member"], "left")
    open_ = pairs.filter("direct IS NULL AND known")
    owners = nodes.select("target", F.col("name").alias("owner"), F.col("id").alias("parent"))
    members = nodes.select("target", F.col("name").alias("member"), "parent", "id", "seq")
    owned = open_.join(owners, ["target", "owner"]).join(members, ["target", "member", "parent"]).select(*Q, "place", "id", "seq")
    counts = owned.groupBy(*Q, "place").agg(F.count(F.lit(1)).alias("n_owned"))
    pairs = pairs.join(counts, [*Q, "place"], "left")
    no_member = F.concat(F.lit("`"), "owner", F.lit("` exists in this codebase but it has no member named `"), "member", F.lit("`."))
    not_owned = F.concat(F.lit("`"), "member", F.lit("` exists in this codebase but not as a member of `"), "owner", F.lit("`."))
    reason = F.when(F.col("direct").isNotNull(), F.lit(None)).when(F.col("known").isNull(), no_member).when(F.col("n_owned").isNull(), not_owned)
    refused = pairs.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy(*Q).agg(F.min_by("reason", "place").alias("reason"))
    first = pairs.filter("direct IS NOT NULL").join(nodes.select("target", F.col("id").alias("direct"), "seq"), ["target", "direct"]).select(*Q, "place", F.col("direct").alias("id"), "seq")
    hits = first.unionByName(owned).join(refused, Q, "left_anti").select(*Q, F.struct("place", "seq").alias("rank"), "id")
    return hits, refused


def named_misses(questions: DataFrame, nodes: DataFrame, qualified: DataFrame) -> DataFrame:
    """(question_id, target, reason) of questions that spell out identifiers which no symbol has or begins with.

    Prefixes of known names of up to ``HEAD`` characters are rows of their own, each once, so a word meets one row
    however many names begin with it; longer words meet the names that share their first ``HEAD`` characters."""
    words = questions.select(*Q, F.posexplode(identifiers(F.col("question"))).alias("place", "word")).withColumn("low", F.lower("word"))
    words = words.filter(symbol_like(F.col("word")) & ~F.col("low").isin(*ROLE_WORDS))
    own = symbols(nodes).join(qualified, ["target", "id"])
    known = own.select("target", F.lower("name").alias("low")).union(own.select("target", F.lower("qualified"))).distinct()
    words = words.join(known, ["target", "low"], "left_anti")
    short = words.filter(F.length("low").between(4, HEAD))
    heads = known.select("target", F.explode(F.transform(F.filter(F.sequence(F.lit(4), F.lit(HEAD)), lambda k: k <= F.length("low")), lambda k: F.substring(F.col("low"), F.lit(1), k))).alias("low")).distinct()
    longer = known.filter(F.length("low") > HEAD).select(F.col("target").alias("k_target"), F.col("low").alias("k_low"))
    begins = (F.col("target") == F.col("k_target")) & (F.substring("low", 1, HEAD) == F.substring("k_low", 1, HEAD)) & F.startswith("k_low", F.col("low"))
    long_ = words.filter(F.length("low") > HEAD).join(longer, begins, "left_anti")
    words = words.filter(F.length("low") < 4).unionByName(short.join(heads, ["target", "low"], "left_anti")).unionByName(long_)
    once = words.groupBy(*Q, "word").agg(F.min("place").alias("place"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: F.concat(F.lit("`"), x["word"], F.lit("`"))), ", ")
    reason = F.concat(F.lit("The question names "), listed, F.lit(", and no symbol with that name exists in this codebase."))
    return once.groupBy(*Q).agg(reason.alias("reason"))


def exact_layer(questions: DataFrame, nodes: DataFrame, hints: DataFrame) -> DataFrame:
    """(question_id, target, rank, id) of symbols that a question names, case and all; data only where the
    question spells them as identifiers or names their kind. Hints narrow the hits, to nothing if need be."""
    words = questions.select(*Q, F.explode(F.array_distinct(identifiers(F.col("question")))).alias("name")).filter(F.length("name") >= MIN_EXACT_NAME)
    shaped = F.contains("name", F.lit("_")) | F.rlike("name", F.lit("[a-z][A-Z]")) | F.rlike("name", F.lit(r"(?U)^\p{Lu}"))
    own = words.join(symbols(nodes).select("target", "name", "id", "type", "seq"), ["target", "name"])
    hinted = hints.select("question_id").distinct().withColumn("has_hints", F.lit(True))
    own = own.join(hints.withColumn("hinted", F.lit(True)), ["question_id", "type"], "left").join(hinted, "question_id", "left")
    own = own.filter(~F.col("type").isin(*DATA_TYPES) | shaped | F.col("hinted").isNotNull())
    return own.filter("has_hints IS NULL OR hinted").select(*Q, F.col("seq").alias("rank"), "id")


def lexical_documents(nodes: DataFrame, qualified: DataFrame, snippets: DataFrame | None = None, cut: int = 2000) -> DataFrame:
    """(target, id, text) of symbols: names, kind, signature, comment and file, and the start of the code."""
    own = symbols(nodes).join(qualified, ["target", "id"])
    text = document_for(F.col("qualified"), F.col("name"), F.col("type"), F.col("signature"), F.col("doc"), F.col("file"))
    if snippets is None:
        return own.select("target", "id", text.alias("text"))
    joined = own.join(snippets, ["target", "id"], "left")
    code = F.when(F.length("snippet") > 0, F.substring("snippet", 1, cut))
    return joined.select("target", "id", F.concat_ws("\n", text, code).alias("text"))


class LexicalIndex(NamedTuple):
    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame
    stats: DataFrame


def lexical_index(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> LexicalIndex:
    posted = keep(bm25.postings(docs), "postings")
    sized = keep(bm25.lengths(posted, docs), "lengths")
    totals = bm25.corpus(sized)
    return LexicalIndex(posted, sized, totals, keep(bm25.term_stats(posted, totals), "terms"))


def lexical_layer(questions: DataFrame, nodes: DataFrame, index: LexicalIndex, hints: DataFrame, limit: int) -> DataFrame:
    """(question_id, target, rank, id, score, best, confidence)."""
    terms = bm25.expand(bm25.query_terms(questions), index.stats)
    found = bm25.scores(terms, *index, b=RETRIEVAL_B)
    return bm25.weighted(found, nodes.select("target", "id", "type", "seq"), hints, limit)


#: The ratio that a suggestion needs, and classes of characters by which names are grouped: a letter in either case, digits,
#: signs that part names; all others are a class too.
CLOSE = 0.6
#: Most subsequences of a name's digits that are sent to meet words.
WAYS = 64
CLASSES = (*(chr(a) + chr(a).upper() for a in range(ord("a"), ord("z") + 1)), "0123456789", "_.")


def character_counts(name: Column) -> Column:
    """How many characters of each class a name has."""
    counts = [F.length(name) - F.length(F.translate(name, c, "")) for c in CLASSES]
    return F.array(*counts, F.length(F.translate(name, "".join(CLASSES), "")))


def ratios(words: pd.Series, names: pd.Series) -> pd.Series:
    """The ratio of matching blocks of each word and name, where it is at least ``CLOSE``, else null."""
    out, match, now = [], difflib.SequenceMatcher(), None
    for word, known in zip(words, names, strict=True):
        if word != now:
            match.set_seq2(word)
            now = word
        match.set_seq1(known)
        close = match.real_quick_ratio() >= CLOSE and match.quick_ratio() >= CLOSE
        out.append(r if close and (r := match.ratio()) >= CLOSE else None)
    return pd.Series(out, dtype="float64")


def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length of the longest common subsequence of each two texts."""
    out = []
    for x, y in zip(a, b, strict=True):
        places: dict[str, int] = {}
        for k, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << k
        row = whole = (1 << len(x)) - 1
        for c in y:
            met = row & places.get(c, 0)
            row = (row + met | row - met) & whole
        out.append(len(x) - row.bit_count())
    return pd.Series(out, dtype="int32")


def subsequences(digits: pd.Series, size: pd.Series) -> pd.Series:
    """The different subsequences of a size of each text."""
    return pd.Series([sorted({"".join(c) for c in itertools.combinations(d, n)}) for d, n in zip(digits, size, strict=True)], dtype="object")


def close_names(words: DataFrame, pools: DataFrame, k: int = 3) -> DataFrame:
    """(target, word, pool, known, ratio, rank): of each pool (target, pool, known) the k names that are closest to a
    word (target, word), ties to the greater name.

    A ratio is at most twice the characters that both share over the sum of lengths, and characters in common are no more
    than characters of one class in common. Words and names are told apart by what is left without their digits and the number
    of those, a mould, and moulds of the same numbers of each class are one group: a word's mould meets groups of the lengths
    that allow the ratio, then moulds of the groups that allow it. Matching blocks are a common subsequence, so what two moulds
    have in common leaves a number of digits that a word and a name must have in common in the same order: they meet on
    subsequences of that size, not all of a mould. Names that differ in digits alone are equally close to a word without any, so
    the k greatest stand for them. Only pairs that are left are compared."""
    digits, key = "0123456789", ["target", "stem", "n"]

    def moulded(frame: DataFrame, name: str) -> DataFrame:
        stem = F.translate(name, digits, "")
        return frame.withColumn("stem", stem).withColumn("n", F.length(name) - F.length(stem)).withColumn("digits", F.regexp_replace(name, "[^0-9]+", ""))

    def counts() -> Column:
        return character_counts(F.concat("stem", F.repeat(F.lit("0"), F.col("n"))))

    once, named = moulded(words.select("target", "word").distinct(), "word"), moulded(pools, "known")
    asked = once.select(*key).distinct().withColumn("has", counts()).withColumn("size", F.length("stem") + F.col("n"))
    moulds = named.select(*key).distinct().withColumn("bag", F.array_join(counts(), ",")).withColumn("length", F.length("stem") + F.col("n"))
    groups = moulds.select("target", "bag", "length").distinct()
    least, most = F.ceil(F.col("size") * CLOSE / (2 - CLOSE) - 1e-9), F.floor(F.col("size") * (2 - CLOSE) / CLOSE + 1e-9)
    met = asked.withColumn("length", F.explode(F.sequence(least.cast("int"), most.cast("int")))).join(groups, ["target", "length"])
    shared = F.aggregate(F.zip_with("has", F.split("bag", ",").cast("array<int>"), lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    met = met.filter(2 * shared >= CLOSE * (F.col("size") + F.col("length")) - 1e-9).select("target", F.col("stem").alias("w_stem"), F.col("n").alias("w_n"), "size", "bag")
    met = met.join(moulds, ["target", "bag"])
    both = F.least("w_n", "n")
    plain, numbered = met.filter(both == 0), met.filter(both > 0)
    least = F.ceil(CLOSE / 2 * (F.col("size") + F.col("length")) - 1e-9).cast("int")
    numbered = numbered.withColumn("need", least - F.pandas_udf(common, "int")("w_stem", "stem")).filter(F.col("need") <= both)
    # Long runs of digits have very many subsequences; they meet as pairs.
    ways = F.factorial("n") / F.factorial("need") / F.factorial(F.col("n") - F.col("need"))
    w_ways = F.factorial("w_n") / F.factorial("need") / F.factorial(F.col("w_n") - F.col("need"))
    few = F.coalesce((F.col("need") > 0) & (F.greatest(ways, w_ways) <= WAYS), F.lit(False))
    mould = ["target", "w_stem", "w_n"]
    own = once.select("target", F.col("stem").alias("w_stem"), F.col("n").alias("w_n"), "word", F.col("digits").alias("w_digits"))
    greatest = top_k(named.withColumn("shape", F.translate("known", digits, "0" * 10)), ["target", "pool", "shape"], [F.desc("known")], k)
    pair = ["target", "word", "pool", "known"]
    pairs = plain.select(*mould, "stem", "n").join(own, mould).join(greatest, key).select(*pair)
    pairs = pairs.unionByName(numbered.filter(~few).select(*mould, "stem", "n").join(own, mould).join(named, key).select(*pair))
    cut = F.pandas_udf(subsequences, "array<string>")
    left = numbered.filter(few).select(*mould, "stem", "n", "need").join(own, mould).withColumn("part", F.explode(cut("w_digits", "need")))
    right = numbered.filter(few).select(*key, "need").distinct().join(named, key).withColumn("part", F.explode(cut("digits", "need")))
    pairs = pairs.unionByName(left.join(right, [*key, "need", "part"]).select(*pair))
    # Matching blocks are a common subsequence, and an edit distance is at most what such a one leaves over of both.
    pairs = pairs.filter(F.levenshtein("word", "known") <= (1 - CLOSE) * (F.length("word") + F.length("known")) + 1e-9)
    # A ratio costs far more than a row, so pairs are dealt out whatever their number of bytes; one word's come together.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, *pair).dropDuplicates(pair).sortWithinPartitions("target", "word")
    close = pairs.withColumn("ratio", F.pandas_udf(ratios, "double")("word", "known")).filter("ratio IS NOT NULL")
    return top_k(close, ["target", "word", "pool"], [F.desc("ratio"), F.desc("known")], k)


def suggestions(questions: DataFrame, nodes: DataFrame, qualified: DataFrame, limit: int = 5) -> DataFrame:
    """(target, question_id, suggestions): names close to the question's words, by the ratio of matching blocks,
    qualified ones before bare ones; else the first names. Each word is looked up once, however many questions have it."""
    own = symbols(nodes).join(qualified, ["target", "id"])
    pools = own.select("target", F.lit(0).alias("pool"), F.col("qualified").alias("known")).union(own.select("target", F.lit(1), F.col("name"))).distinct()
    words = questions.select(*Q, F.posexplode(identifiers(F.col("question"))).alias("place", "word")).filter(F.length("word") > 2)
    best = words.join(close_names(words, pools).drop("ratio"), ["target", "word"])
    once = first_wins(best, [*Q, "known"], ["place", "pool", "rank"])
    listed = once.groupBy(*Q).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pool", "rank", "known"))), lambda x: x["known"]).alias("found"))
    first = top_k(pools.filter("pool = 0"), ["target"], ["known"], limit).groupBy("target").agg(F.array_sort(F.collect_list("known")).alias("first"))
    joined = questions.select(*Q).join(listed, Q, "left").join(first, "target", "left")
    return joined.select(*Q, F.slice(F.coalesce("found", "first", F.array().cast("array<string>")), 1, limit).alias("suggestions"))


def retrieve(questions: DataFrame, nodes: DataFrame, *, snippets: DataFrame | None = None, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, choose: Callable[[list[str]], list[str]] | None = None, semantic: str = "auto", limit: int | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches (question_id, target, rank, id, score, strategy) and one row for each question (question_id, target,
    strategy, confidence, reason, suggestions). ``keep`` stores what several layers read (names, postings, what
    each layer decided); by default it is a table in the shared folder.

    ``semantic`` says how questions are met that no name and no word matches: by vectors (``embeddings``), by the names that
    ``choose``, a model, picks from the inventory (``llm``), by the one and for what it leaves by the other (``auto``), or
    not at all (``off``). A way for which nothing is given is left out."""
    from ..plans.build import stored
    from ..settings import SEMANTIC
    from .combinators import prefer
    from .semantic import cosine_top_k, selected

    if semantic not in SEMANTIC:
        raise ValueError(f"semantic is one of {', '.join(SEMANTIC)}")

    keep = keep or (lambda frame, name: stored(frame.sparkSession, frame, name))
    limit = limit or MAX_CONTEXT_NODES
    qualified = keep(qualified_names(nodes), "qualified")
    by_name = keep(by_qualified_name(nodes, qualified), "by-name")
    hints = keep(type_hints(questions), "hints")
    index = lexical_index(lexical_documents(nodes, qualified, snippets), keep)
    one = F.lit(1.0)

    def settled(hits: DataFrame, strategy: str, score: Column) -> DataFrame:
        ranked = top_k(prefer_definitions(hits, nodes), ["question_id"], ["rank"], limit, "place")
        return ranked.select(*Q, F.col("place").alias("rank"), "id", score.alias("score"), F.lit(strategy).alias("strategy"))

    hits, refused = qualified_layer(questions, nodes, by_name)
    refused = keep(refused, "refused")
    matches = keep(settled(hits, "qualified", one), "matches")
    decided = refused.select(*Q).union(matches.select(*Q)).distinct()
    left = questions.join(decided, Q, "left_anti")
    missing = keep(named_misses(left, nodes, qualified), "missing")
    left = left.join(missing, Q, "left_anti")
    exact = keep(settled(exact_layer(left, nodes, hints), "exact", one), "exact")
    left = keep(left.join(exact.select(*Q).distinct(), Q, "left_anti"), "left")
    scored = keep(lexical_layer(left, nodes, index, hints, limit), "scored")
    lexical = settled(scored.select(*Q, "rank", "id"), "lexical", F.lit(None).cast("double")).drop("score")
    own = scored.select("question_id", "id", F.col("score").alias("own"))
    best = scored.groupBy("question_id").agg(F.max("best").alias("best"), F.max("confidence").alias("confidence"))
    lexical = lexical.join(own, ["question_id", "id"], "left").join(best, "question_id").withColumn("score", F.coalesce("own", "best"))
    lexical = keep(lexical, "lexical")
    left = left.join(lexical.select(*Q).distinct(), Q, "left_anti")
    confident = F.when(F.col("strategy").isin("qualified", "exact"), "HIGH").otherwise("LOW")
    all_matches = matches.unionByName(exact).withColumn("confidence", confident).unionByName(lexical.select(*matches.columns, "confidence"))
    ways = []
    if semantic in ("auto", "embeddings") and vectors is not None and question_vectors is not None:
        asked = question_vectors.join(left.select("question_id"), "question_id", "left_semi")
        ways.append(lambda left: cosine_top_k(asked, vectors, limit).join(left.select(*Q), "question_id").select(*Q, "rank", "id"))
    if semantic in ("auto", "llm") and choose is not None:
        ways.append(lambda left: selected(left, nodes, qualified, by_name, choose, limit).select(*Q, "rank", "id"))
    for way in ways:
        near = keep(way(left), "near")
        typed = near.join(nodes.select("target", "id", "type"), ["target", "id"]).join(hints.withColumn("hinted", F.lit(True)), ["question_id", "type"], "left")
        near = prefer(typed, ["question_id"], F.col("hinted")).select(*Q, "rank", "id")
        found = keep(settled(near, "semantic", F.lit(0.5)).withColumn("confidence", F.lit("LOW")), "semantic")
        all_matches = all_matches.unionByName(found)
        left = left.join(found.select(*Q).distinct(), Q, "left_anti")
    nothing = left.select(*Q, F.lit("No symbol in the knowledge graph matched this question.").alias("reason"), F.lit("none").alias("strategy"))
    refusals = refused.withColumn("strategy", F.lit("qualified-miss")).unionByName(missing.withColumn("strategy", F.lit("named-symbol-miss"))).unionByName(nothing)
    refusals = keep(refusals, "refusals")
    asked = questions.join(refusals.select(*Q), Q, "left_semi")
    near = lexical_layer(asked, nodes, index, hints, 3).join(qualified, ["target", "id"])
    more = near.groupBy(*Q).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "qualified"))), lambda x: x["qualified"]).alias("more"))
    offered = suggestions(asked, nodes, qualified).join(more, Q, "left")
    none = F.array().cast("array<string>")
    offered = offered.select(*Q, F.slice(F.array_distinct(F.concat("suggestions", F.coalesce("more", none))), 1, 6).alias("suggestions"))
    # One row a question by the plan itself, so Spark leaves this join out where no suggestions are read.
    offered = offered.groupBy(*Q).agg(F.first("suggestions").alias("suggestions"))
    answered = all_matches.groupBy(*Q).agg(F.first("strategy").alias("strategy"), F.first("confidence").alias("confidence"))
    rows = answered.withColumn("reason", F.lit(None).cast("string")).withColumn("suggestions", none)
    rows = rows.unionByName(refusals.join(offered, Q, "left").withColumn("confidence", F.lit("NONE")))
    return all_matches.drop("confidence"), rows
