"""License scan by diagonal voting.

Every rolling k-gram of a text's words is hashed and joined with the k-grams of
the license templates. A hit votes for a diagonal (word position in the text
minus position in the template): a copied passage puts its votes on one
diagonal, and an inserted or dropped word moves them to a neighbouring one.
Votes are counted per diagonal and neighbouring diagonals merge. A chain of
neighbours that drifts further than the template is long is cut into windows of
that width, each half a window after the one before, so a repeated opening can't
hide the notice that follows. Every span is verified by the share of the
template's words that the hits cover. Each hit compares the words themselves, so
a hash collision casts no vote. A phrase whose every k-gram votes on one diagonal
stands there word for word.

The template table is fixed by the parameters, not by the data; it is broadcast.
The text itself is never shuffled: only votes are, and they are written once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, materialize, text_or_empty

K = 3
#: Phrases that must stand word for word, with their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that may be altered or cut, with their labels: openings by which a license is named, then the texts themselves.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
    "the software or the use or other dealings in the software": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
    "implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
    "for a particular purpose are disclaimed": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
    "copies": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
    "or at your option any later version": "gpl",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
    "public license for more details": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
}
#: Share of a notice's words that the verified span must cover.
COVER = 0.7
#: Diagonals at most this far apart belong to one span.
SLACK = 3
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """A text's words: A-Z lower-cased, runs of letters, digits and non-ASCII."""
    table = {ord(c): c.lower() for c in UPPER}
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(table))


def _words(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(c), _SPLIT), "")


def _templates(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    rows = []
    for number, (text, label, exact) in enumerate([(t, v, True) for t, v in phrases.items()] + [(t, v, False) for t, v in notices.items()]):
        words = words_of(text)
        if len(words) < K:
            raise ValueError(f"a template has at least {K} words: {text!r}")
        rows += [(number, label, exact, len(words), at, *words[at : at + K]) for at in range(len(words) - K + 1)]
    names = [f"t{i}" for i in range(K)]
    table = spark.createDataFrame(rows, "template int, label string, exact boolean, length int, at int, " + ", ".join(f"{n} string" for n in names))
    return table.withColumn("h", F.xxhash64(*names))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, cover: float = COVER, slack: int = SLACK) -> DataFrame:
    """Spans: ``(key, doc, label, exact, start, end, score)``, words from 0, end
    exclusive. ``key`` tells apart texts that share an id or have none; repeated
    rows give one set of spans. Null and empty texts have none."""
    rows = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("body"))
    grams = rows.select("doc", F.xxhash64("body").alias("key"), _words(F.col("body")).alias("w")).where(F.size("w") >= K)
    parts = [F.slice("w", i + 1, F.greatest(F.size("w") - (K - 1), F.lit(0))) for i in range(K)]
    zipped = F.arrays_zip(*(p.alias(f"w{i}") for i, p in enumerate(parts)))
    grams = grams.select("doc", "key", F.posexplode(zipped).alias("pos", "g")).select("doc", "key", "pos", *(F.col("g")[f"w{i}"].alias(f"w{i}") for i in range(K)))
    grams = grams.withColumn("g", F.xxhash64(*(f"w{i}" for i in range(K))))
    same = F.col("g") == F.col("h")
    for i in range(K):
        same &= F.col(f"w{i}") == F.col(f"t{i}")
    hits = grams.join(F.broadcast(_templates(docs.sparkSession, phrases, notices)), same)
    # a diagonal has as many places as its template at most
    votes = materialize(hits.groupBy("doc", "key", "template", "label", "exact", "length", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at")))
    whole = votes.where(F.col("exact") & (F.size("at") == F.col("length") - K + 1)).select(
        "key", "doc", "label", "exact", F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("length")).cast("long").alias("end"), F.lit(1.0).alias("score")
    )
    one = ["doc", "key", "template"]
    per = Window.partitionBy(*one).orderBy("diagonal")
    chains = (
        votes.where(~F.col("exact")).withColumn("fresh", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(per) > slack).cast("int"))
        .withColumn("chain", F.sum("fresh").over(per)).withColumn("drift", F.col("diagonal") - F.min("diagonal").over(Window.partitionBy(*one, "chain")))
    )
    # a window is two half lengths; a diagonal lies in two of them, the first half of a chain in one
    half = F.greatest(F.lit(1), F.ceil(F.col("length") / 2))
    last = F.floor(F.col("drift") / half)
    spans = (
        chains.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), last - 1), last)))
        .withColumn("a", F.explode("at"))
        .groupBy(*one, "label", "exact", "length", "chain", "window")
        .agg(
            F.array_distinct(F.flatten(F.collect_set(F.sequence("a", F.col("a") + K - 1)))).alias("covered"),
            F.min(F.col("diagonal") + F.col("a")).alias("start"), F.max(F.col("diagonal") + F.col("a") + K).alias("end"),
        )
        .withColumn("score", F.size("covered") / F.col("length")).where(F.col("score") >= cover)
    )
    # of windows that overlap, the one that covers most
    better = Window.partitionBy(*one, "chain").orderBy("window")
    beside = lambda shift, step: F.when(shift("window").over(better) == F.col("window") + step, shift("score").over(better)).otherwise(0.0)
    spans = spans.withColumns({"prior": beside(F.lag, -1), "next": beside(F.lead, 1)}).where("score > prior and score >= next")
    spans = spans.select("key", "doc", "label", "exact", F.col("start").cast("long"), F.col("end").cast("long"), "score")
    return whole.unionByName(spans)


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` and the two positions count the places where a phrase stands word
    for word; ``score`` is the best verified coverage of any template (0 without
    a span). Null text counts as empty: no words, empty labels, score 0. Whole
    texts are scanned, whatever their length. Notices that tie each give their
    label. Null ids stay null, repeated rows give repeated results, an empty table
    an empty one; other columns are ignored.
    """
    base = F.col("exact")
    found = scan_licenses(docs, id_col, text_col, **options).groupBy("doc", "key").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    rows = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("body")).select(
        "doc", F.xxhash64("body").alias("key"), F.regexp_count("body", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words")
    )
    found = found.select(F.col("doc").alias("d"), F.col("key").alias("k"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return rows.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select(
        F.col("doc").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
