"""Graph access: edges, adjacency, names, histograms, hashes, staleness. All keyed by ``target``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAX_HOPS
from .combinators import first_wins, last_wins


def symbols(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type != 'file'")


def contains_edges(nodes: DataFrame) -> DataFrame:
    """An edge from each symbol's parent to it."""
    return symbols(nodes).filter("parent IS NOT NULL").select("target", F.col("parent").alias("frm"), F.col("id").alias("to"))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, type): how often it came, and its other columns from the first by seq."""
    rest = [c for c in edges.columns if c not in ("target", "frm", "to", "type", "seq")]
    first = F.min_by(F.struct(*rest, "seq"), "seq").alias("first")
    return edges.groupBy("target", "frm", "to", "type").agg(F.count(F.lit(1)).alias("count"), first).select("target", "frm", "to", "type", "count", "first.*")


def with_external(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """external and resolution by whether the far end is a known node."""
    known = nodes.select("target", F.col("id").alias("to")).distinct().withColumn("_known", F.lit(True))
    joined = edges.join(known, ["target", "to"], "left").withColumn("external", F.col("_known").isNull())
    return joined.withColumn("resolution", F.when(F.col("external"), "external").otherwise("internal")).drop("_known")


def outgoing(edges: DataFrame, ids: DataFrame, type_: str | None = None) -> DataFrame:
    """Edges from the given (target, id), of one type if named."""
    own = edges if type_ is None else edges.filter(F.col("type") == type_)
    return own.join(ids.select("target", F.col("id").alias("frm")), ["target", "frm"], "left_semi")


def incoming(edges: DataFrame, ids: DataFrame, type_: str | None = None) -> DataFrame:
    own = edges if type_ is None else edges.filter(F.col("type") == type_)
    return own.join(ids.select("target", F.col("id").alias("to")), ["target", "to"], "left_semi")


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a ``contains`` edge reaches, with their container."""
    own = edges.filter("type = 'contains'").select("target", F.col("frm").alias("container"), F.col("to").alias("id"))
    return own.join(nodes, ["target", "id"])


def qualified_names(nodes: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(target, id, qualified) of each node: names from the outermost symbol down to it, climbing parents
    until a file, a missing node or ``hops``. Each step is one join; every second step looks whether a chain still
    climbs, so the work follows the depth that the data has."""
    up = nodes.select("target", F.col("id").alias("at"), F.col("name").alias("up_name"), F.col("type").alias("up_type"), F.col("parent").alias("up_parent"))
    done = nodes.filter("type = 'file'").select("target", "id", F.col("name").alias("qualified"))
    live = symbols(nodes).select("target", "id", F.col("name").alias("qualified"), F.col("parent").alias("at"))
    for hop in range(hops - 1):
        step = live.join(up, ["target", "at"], "left")
        ended = F.col("up_name").isNull() | (F.col("up_type") == "file")
        longer = F.when(ended, F.col("qualified")).otherwise(F.concat_ws(".", "up_name", "qualified"))
        live = step.select("target", "id", longer.alias("qualified"), F.when(~ended, F.col("up_parent")).alias("at"))
        if hop % 2 and live.filter("at IS NOT NULL").isEmpty():
            break
    return done.unionByName(live.drop("at"))


def by_qualified_name(nodes: DataFrame, qualified: DataFrame) -> DataFrame:
    """(target, qualified) -> id over symbols; of several the last by seq wins, so overloads collapse."""
    own = symbols(nodes).join(qualified, ["target", "id"]).select("target", "qualified", "id", "seq")
    return last_wins(own, ["target", "qualified"], "seq").select("target", "qualified", "id")


def labels(ids: DataFrame, qualified: DataFrame) -> DataFrame:
    """Adds ``label``: the qualified name of ``id``, or the id itself."""
    return ids.join(qualified, ["target", "id"], "left").withColumn("label", F.coalesce("qualified", "id")).drop("qualified")


def endpoints(edges: DataFrame, side: str, nodes: DataFrame, qualified: DataFrame) -> DataFrame:
    """Adds name, node_id and node_type of one end of each edge, with defaults for its resolution and count."""
    ends = nodes.select("target", F.col("id").alias(side), F.col("type").alias("node_type"), F.lit(True).alias("_known"))
    names = qualified.select("target", F.col("id").alias(side), "qualified")
    joined = edges.join(ends, ["target", side], "left").join(names, ["target", side], "left")
    known = F.col("_known").isNotNull()
    return (
        joined.withColumn("name", F.coalesce("qualified", side)).withColumn("node_id", F.when(known, F.col(side)))
        .withColumn("resolution", F.coalesce("resolution", F.when(known, "internal").otherwise("external")))
        .withColumn("count", F.coalesce("count", F.lit(1))).drop("_known", "qualified")
    )


def language_counts(files: DataFrame) -> DataFrame:
    """Files of each (target, language), and its place by (-files, language); place 1 is dominant."""
    from pyspark.sql import Window

    counts = files.groupBy("target", "language").agg(F.count(F.lit(1)).alias("files"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("files"), "language")))


def languages(meta: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, languages) of graphs: what meta (target, language, languages) says, else its one language with the
    number of file nodes, else nothing."""
    files = nodes.filter("type = 'file'").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    one = F.when(F.length("language") > 0, F.create_map("language", F.coalesce("n", F.lit(0).cast("long")))).otherwise(F.create_map().cast("map<string,bigint>"))
    said = F.when(F.size("languages") > 0, F.col("languages"))
    return meta.join(files, "target", "left").select("target", F.coalesce(said, one).alias("languages"))


def status(meta: DataFrame, stale: DataFrame) -> DataFrame:
    """(target, missing, unverifiable, changed, failed, is_stale) of graphs: how many files aren't as they were, by
    ``staleness``, and how many couldn't be parsed."""
    counts = stale.groupBy("target").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("missing", "unverifiable", "changed")))
    own = meta.select("target", F.greatest(F.size("parse_failures"), F.lit(0)).alias("failed")).join(counts, "target", "left")
    numbers = [F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in ("missing", "unverifiable", "changed")]
    return own.select("target", *numbers, "failed").withColumn("is_stale", F.col("missing") + F.col("unverifiable") + F.col("changed") > 0)


def graph_hash(files: DataFrame) -> DataFrame:
    """The first 16 hex digits of the hash of all ``path:hash`` in order of path. One short string a file is
    gathered for each target: the definition hashes them in sequence."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "hash"))), lambda e: F.concat_ws(":", e["file"], e["hash"])), "")
    return files.groupBy("target").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("hash"))


def staleness(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(target, file, status) of files that aren't as they were: missing on disk, without a stored hash, or changed."""
    joined = stored.select("target", "file", F.col("hash").alias("was")).join(disk.select("target", "file", F.col("hash").alias("now"), F.lit(True).alias("there")), ["target", "file"], "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("was").isNull(), "unverifiable").when(F.col("was") != F.col("now"), "changed")
    return joined.withColumn("status", status).filter("status IS NOT NULL").select("target", "file", "status")


def targets(built: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(target, built, on_disk) of all targets in either."""
    both = built.select("target").distinct().withColumn("built", F.lit(True)).join(on_disk.select("target").distinct().withColumn("on_disk", F.lit(True)), "target", "full")
    return both.select("target", F.coalesce("built", F.lit(False)).alias("built"), F.coalesce("on_disk", F.lit(False)).alias("on_disk"))


def prefer_definitions(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matches (question_id, target, rank, id) with prototypes replaced by the first function of the same name,
    first match of each id kept."""
    functions = first_wins(nodes.filter("type = 'function'").select("target", "name", F.col("id").alias("definition"), "seq"), ["target", "name"], ["seq"]).drop("seq")
    own = matches.join(nodes.select("target", "id", "name", "type"), ["target", "id"]).join(functions, ["target", "name"], "left")
    chosen = F.when((F.col("type") == "function_declaration") & F.col("definition").isNotNull(), F.col("definition")).otherwise(F.col("id"))
    own = own.withColumn("id", chosen).drop("name", "type", "definition")
    return first_wins(own, ["question_id", "id"], ["rank"])
