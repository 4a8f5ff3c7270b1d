"""License scans by diagonal voting, in DataFrame and SQL functions only.

Every text becomes words (A-Z lower-cased, other letters as they are), and every rolling gram of two words a hash.
The hashes join the positions of the templates' grams, and the words of both are compared; a hit votes for the diagonal (place in the text minus place in the template). Votes
are gathered by document, template and diagonal; diagonals at most ``NEAR`` apart (words put in or left
out) merge into a span; a span is verified if it isn't much longer than its template and holds at least
``COVER`` of the template's grams. The base phrases are templates too: a phrase stands wherever one
diagonal has all of its grams. A gram that no template has marks each text's end, so that a text without
hits keeps a row and its number of words.

Only the templates are broadcast: a fixed list. Hits are dealt by document, so a license that a third of
all documents hold makes no large group.

Cases: a null or empty text has no words, labels "" and score 0. Rows that repeat a document come out as
often as they came in. A null doc_id stays null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .urls import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NEAR = 2
COVER = 0.75
#: The base phrases and their labels: fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Texts of common licenses or of the notices by which works are put under them, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages"
        " or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without"
        " even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy"
        " of the gnu general public license along with this program if not see http www gnu org licenses",
        "gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source"
        " code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by"
        " the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness"
        " for a particular purpose are disclaimed",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied"
        " warranties of merchantability and fitness",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this"
        " software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "zlib",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in"
        " source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"
        " http mozilla org mpl 2 0",
        "mpl",
    ),
)
#: Template number of the gram at the end of each text.
END = -1


def _gram(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _end() -> Column:
    return F.xxhash64(F.lit("end"), F.lit("of"), F.lit("text"))


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """h, a and b (the words), template, label, base (is a phrase), grams (how many it has) and at (place) of each gram."""
    parts = []
    for number, (text, label) in enumerate([*phrases, *templates]):
        words = text.split()
        for at, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            parts.append(f"('{a}', '{b}', {number}, '{label}', {str(number < len(phrases)).lower()}, {len(words) - 1}, {at})")
    known = spark.sql(f"SELECT * FROM VALUES {', '.join(parts)} AS t(a, b, template, label, base, grams, at)")
    end = spark.range(1).select(_end().alias("h"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit(END).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("grams"), F.lit(0).alias("at"))
    return known.select(_gram(F.col("a"), F.col("b")).alias("h"), "a", "b", "template", "label", "base", "grams", "at").unionByName(end)


def hits(spark: SparkSession, docs: DataFrame, **templates) -> DataFrame:
    """The join of all rolling gram hashes with the template positions."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    words = F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), words.alias("words"))
    grams = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.struct(_gram(a, b).alias("h"), a.alias("x"), b.alias("y")))
    end = F.struct(_end().alias("h"), F.lit("").alias("x"), F.lit("").alias("y"))
    places = own.select("doc_id", "key", F.posexplode(F.concat(grams, F.array(end))).alias("place", "gram"))  # the last word's gram has no second word
    places = places.select("doc_id", "key", "place", "gram.*")
    joined = places.join(F.broadcast(template_grams(spark, **templates)), "h")
    return joined.filter((F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))).drop("h", "x", "y", "a", "b")


def scan(spark: SparkSession, docs: DataFrame, *, cover: float = COVER, near: int = NEAR, **templates) -> DataFrame:
    """The contract's columns of each document; see the module."""
    own = ["doc_id", "key"]
    found = hits(spark, docs, **templates).repartition(*own).withColumn("diagonal", F.col("place") - F.col("at"))
    votes = found.groupBy(*own, "template", "label", "base", "grams", "diagonal").agg(
        F.collect_set("at").alias("got"), F.min("place").alias("low"), F.max("place").alias("high"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy(*own, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    votes = votes.withColumn("apart", F.coalesce((gap > near).cast("int"), F.lit(0))).withColumn("span", F.sum("apart").over(order))
    whole = F.col("base") & (F.size("got") == F.col("grams"))
    spans = votes.groupBy(*own, "template", "label", "base", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("got")))).alias("covered"),
        (F.max("high") - F.min("low") + 1).alias("long"),
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
        F.max("n").alias("n"),
        F.max("diagonal").alias("diagonal"),
    )
    real = F.col("template") != END
    verified = real & ~F.col("base") & (F.col("covered") >= cover * F.col("grams")) & (F.col("long") <= 1.5 * F.col("grams") + near)
    share = F.col("covered") / F.col("grams")
    based = real & (F.col("n_base") > 0)

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    result = spans.groupBy(*own).agg(
        F.max(F.when(~real, F.col("diagonal"))).cast("long").alias("n_words"),
        F.sum(F.when(real, F.col("n_base")).otherwise(0)).cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(based).alias("base_labels"),
        joined(based | verified).alias("labels"),
        F.coalesce(F.max(F.when(based, 1.0).when(verified, F.least(share, F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.max(F.when(~real, F.col("n"))).cast("int").alias("times"),
    )
    again = result.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return again.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, common.table(spark, sf_dir, "documents").select("doc_id", "text"))
