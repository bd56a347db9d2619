"""License scans by diagonal voting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ANY_WORD, KEY, bind, indices, row_key, scan_words, set_apart, small_or_not, tabled, word_hash


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: An exact template must be found word for word; others with a share of their words, across neighbouring diagonals.
    exact: bool = False


#: Fixed phrases whose places are the base result.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
#: Whole short licences, and opening or notice passages of long ones.
MIT_TEXT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to
permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in
all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or
other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
BSD_TEXT = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of
source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright
notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright
holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"""
AS_IS_TEXT = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
special exemplary or consequential damages"""
ISC_TEXT = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness"""
APACHE_TEXT = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""
GPL_TEXT = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the
implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""
TEMPLATES = PHRASES + (
    Template("mit", MIT_TEXT),
    Template("bsd", BSD_TEXT),
    Template("bsd", AS_IS_TEXT),
    Template("isc", ISC_TEXT),
    Template("apache", APACHE_TEXT),
    Template("gpl", GPL_TEXT),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc", "this work is licensed under a creative commons attribution"),
)
PHRASE_GRAM, PASSAGE_GRAM = 2, 3
WORD_BITS = 64


def mask_words(templates: tuple[Template, ...]) -> int:
    """How many 64-bit masks hold a bit for every word of the longest template."""
    return max(1, -(-max((len(t.text.split()) for t in templates), default=1) // WORD_BITS))


def template_positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """_gram, _t (number of the template), _at, _k, and the masks _m0, _m1, ..: the k-gram hashes of the templates, with the bits of the words that a gram covers."""
    rows = [(i, t.text, PHRASE_GRAM if t.exact else PASSAGE_GRAM) for i, t in enumerate(templates)]
    table = spark.createDataFrame(rows, "_t int, _text string, _k int").withColumn("_w", F.transform(scan_words(F.col("_text")), lambda w: F.xxhash64(w)))
    grams = F.when(F.col("_k") == PHRASE_GRAM, gram_hashes(F.col("_w"), PHRASE_GRAM)).otherwise(gram_hashes(F.col("_w"), PASSAGE_GRAM))
    placed = table.select("_t", "_k", F.posexplode(grams).alias("_at", "_gram"))
    bit = lambda m, j: F.when(F.floor((F.col("_at") + j) / WORD_BITS) == m, F.expr(f"shiftleft(1L, (_at + {j}) % {WORD_BITS})")).otherwise(F.lit(0).cast("long"))
    masks = [bit(m, 0).bitwiseOR(bit(m, 1)).bitwiseOR(F.when(F.col("_k") > 2, bit(m, 2)).otherwise(F.lit(0).cast("long"))).alias(f"_m{m}") for m in range(mask_words(templates))]
    return placed.select("_gram", "_t", "_at", "_k", *masks)


def gram_hashes(hashes: Column, k: int) -> Column:
    """Rolling hashes of k words; k is part of the hash."""
    return F.transform(indices(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.lit(k), *[hashes[i + j] for j in range(k)]))


def diagonal_spans(docs: DataFrame, text: Column, templates: tuple[Template, ...] = TEMPLATES, slack: int = 3, least: float = 0.8) -> DataFrame:
    """Row key, _t, _first, _stop of every span of docs that enough of a template's words vote for.

    All rolling k-gram hashes of all documents are joined to the templates' positions. Votes are added up by document, template and diagonal
    (place in the document minus place in the template); diagonals of one passage within `slack` of each other and overlapping are merged,
    so inserted or missing words don't break it. Templates may have any number of words.
    """
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_WORD), 0), word_hash)
    both = bind(hashes, lambda h: F.array(gram_hashes(h, PHRASE_GRAM), gram_hashes(h, PASSAGE_GRAM)))
    grams = docs.select(*KEY, F.explode(both).alias("_grams")).select(*KEY, F.posexplode("_grams").alias("_pos", "_gram"))
    places = template_positions(docs.sparkSession, templates)  # a fixed table of a thousand rows
    masks = [f"_m{m}" for m in range(mask_words(templates))]
    votes = (
        grams.join(F.broadcast(places), "_gram")
        .groupBy(*KEY, "_t", (F.col("_pos") - F.col("_at")).alias("_diagonal"))
        .agg(*[F.bit_or(m).alias(m) for m in masks], F.min("_pos").alias("_first"), F.max(F.col("_pos") + F.col("_k")).alias("_stop"))
    )
    exact = F.array(*[F.lit(t.exact) for t in templates])[F.col("_t")]
    size = F.array(*[F.lit(len(t.text.split())) for t in templates])[F.col("_t")]
    order = Window.partitionBy(*KEY, "_t").orderBy("_diagonal")
    apart = (
        F.lag("_diagonal").over(order).isNull()
        | exact
        | (F.col("_diagonal") - F.lag("_diagonal").over(order) > slack)
        | (F.col("_first") > F.lag("_stop").over(order) + size)
        | (F.lag("_first").over(order) > F.col("_stop") + size)
    )
    merged = (
        votes.withColumn("_span", F.sum(apart.cast("int")).over(order))
        .groupBy(*KEY, "_t", "_span")
        .agg(*[F.bit_or(m).alias(m) for m in masks], F.min("_first").alias("_first"), F.max("_stop").alias("_stop"))
    )
    voted = sum((F.bit_count(m) for m in masks[1:]), F.bit_count(masks[0]))
    return merged.filter(voted >= F.when(exact, size).otherwise(F.ceil(size * least))).select(*KEY, "_t", "_first", "_stop")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, slack: int = 3, least: float = 0.8, into: str = "_licenses") -> DataFrame:
    """All columns of docs (doc_id, text) with a struct `into`: n_words and spans (first, stop, label, exact, coverage; sorted by place).

    Spans come from diagonal_spans(), exact ones too; each is then verified on the words: an exact template must stand there word for word, of others the
    coverage (words of the template that a run of three of its words in the span covers) must be `least` or more.

    A null or empty text has no words and no spans; equal rows get equal results; an empty table gives no rows; an input column of the name `into` is replaced, and no
    other name matters. Texts without votes are read once more for their number of words only; row keys and spans are all that is shuffled.
    """
    rows, doc_id, text, back = set_apart(docs, into)
    keyed = rows.select("*", *row_key(doc_id, text))
    voted = tabled(diagonal_spans(keyed, text, templates, slack, least).groupBy(*KEY).agg(F.collect_set(F.struct("_first", "_stop", "_t")).alias("_spans")))
    words = [t.text.split() for t in templates]
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, t.label, t.exact, w) for i, (t, w) in enumerate(zip(templates, words))], "_t int, _label string, _exact boolean, _words array<string>"))
    asked = keyed.select(*KEY, text.alias("_text")).join(small_or_not(voted), KEY).select(*KEY, scan_words(F.col("_text")).alias("_all"), F.explode("_spans").alias("_s")).dropDuplicates([*KEY, "_s"])
    there = asked.select(*KEY, F.col("_s._t").alias("_t"), F.col("_s._first").alias("_first"), F.col("_s._stop").alias("_stop"), F.slice("_all", F.col("_s._first") + 1, F.col("_s._stop") - F.col("_s._first")).alias("_there"))
    runs = lambda w: F.transform(indices(F.size(w) - (PASSAGE_GRAM - 1)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(PASSAGE_GRAM)), " "))
    shared = lambda own, theirs: F.filter(indices(F.size(own)), lambda i: F.array_contains(theirs, own[i]))
    covered = bind(F.struct(runs(F.col("_words")).alias("own"), F.array_distinct(runs(F.col("_there"))).alias("there")), lambda g: F.size(F.array_distinct(F.flatten(F.transform(shared(g["own"], g["there"]), lambda i: F.array(i, i + 1, i + 2))))))
    coverage = F.when(F.col("_exact"), (F.col("_there") == F.col("_words")).cast("double")).otherwise(covered / F.size("_words"))
    sure = there.join(known, "_t").withColumn("_coverage", coverage).filter(F.when(F.col("_exact"), F.col("_coverage") == 1).otherwise(F.col("_coverage") >= least))
    fields = F.struct(F.col("_first").alias("first"), F.col("_stop").alias("stop"), F.col("_label").alias("label"), F.col("_exact").alias("exact"), F.col("_coverage").alias("coverage"))
    per_doc = tabled(sure.groupBy(*KEY).agg(F.array_sort(F.collect_list(fields)).alias("_found")))
    none = F.array().cast("array<struct<first:int,stop:int,label:string,exact:boolean,coverage:double>>")
    n_words = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_WORD), 0)).cast("long")
    joined = keyed.withColumn("_n", n_words).join(small_or_not(per_doc), KEY, "left")
    return back(joined, F.struct(F.col("_n").alias("n_words"), F.coalesce("_found", none).alias("spans")))
