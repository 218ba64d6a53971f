"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word 3-gram of a text is hashed and joined with the positions of the same hash in the license templates.
A pair of positions votes for its diagonal (text position minus template position); diagonals that lie next to each
other (words were put in or left out) merge to a span. A span is verified word by word: of its votes only those count whose three
words equal the template's, the template's words that they cover must be enough of it, and the span must not be much
longer than the template. Three base phrases are looked for word by word as well.

Defined results: null and empty texts have no words, no places, empty label strings and score 0; repeated rows are
judged each for itself; of several spans of one label, all count and the best cover gives the score; an empty table gives no
rows; extra columns are not read. Texts are lower-cased by ``lower``, which besides A-Z changes
letters outside ASCII; of these only U+212A becomes an ASCII letter (k), which stands in no base phrase.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

GRAM, SLACK, COVER, STRETCH = 3, 2, 0.6, 1.5

WORDS = [f"w{i}" for i in range(GRAM)]

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices, opening clauses and whole texts of common licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def runs(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each word (at least one a text): its position and the words from it on."""
    n = F.size("words")
    zipped = F.arrays_zip(F.col("words").alias("w0"), *(F.slice("words", i + 1, n).alias(f"w{i}") for i in range(1, GRAM)))
    out = df.select(*keep, "words").select(*keep, n.cast("long").alias("n_words"), F.posexplode_outer(zipped).alias("pos", "w"))
    return out.select(*keep, "n_words", F.col("pos").cast("long").alias("pos"), *(F.col("w")[f"w{i}"].alias(f"w{i}") for i in range(GRAM)))


def gram() -> Column:
    """The hash of a whole gram, null at the last words of a text."""
    ws = [F.col(f"w{i}") for i in range(GRAM)]
    return F.when(ws[-1].isNotNull(), F.xxhash64(*ws))


def base_label() -> Column:
    out = None
    for phrase, label in PHRASES.items():
        met = reduce(lambda a, b: a & b, (F.col(f"w{i}") == w for i, w in enumerate(phrase.split())))
        out = F.when(met, label) if out is None else out.when(met, label)
    return out


def positions(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(gram, template, label, at, length, its) of every template position; as large as the given templates."""
    df = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    df = df.withColumn("words", words_of(F.col("text")))
    return runs(df, "template", "label").select(gram().alias("gram"), "template", "label", F.col("pos").alias("at"), F.col("n_words").alias("length"), F.array(*WORDS).alias("its")).where("gram is not null")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Words of note (uid, doc_id, n_words, pos, base, gram, own) with a first row for each text, and verified spans.

    Spans: (uid, template, label, first_word, last_word, matched, cover); ``matched`` words of the template stand in the span, and
    ``cover`` is the share of its 3-grams that do.
    """
    known = F.broadcast(positions(docs.sparkSession, templates))  # fixed templates
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words")).withColumn("uid", F.monotonically_increasing_id())
    all_runs = runs(texts, "uid", "doc_id").withColumn("gram", gram()).withColumn("base", base_label())
    marked = all_runs.join(F.broadcast(known.select("gram", F.lit(True).alias("voted")).distinct()), "gram", "left")
    noted = cut(marked.where("base is not null or voted or coalesce(pos, 0) = 0").select("uid", "doc_id", "n_words", "pos", "base", "gram", F.when(F.col("voted"), F.array(*WORDS)).alias("own")))

    # equal hashes vote, equal words count
    votes = noted.where("own is not null").join(known, "gram").where("own = its").groupBy("uid", "template", "label", "length", (F.col("pos") - F.col("at")).alias("diagonal"))
    votes = votes.agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))  # places of one template
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > SLACK
    merged = votes.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("span", F.sum("far").over(order))
    spans = merged.groupBy("uid", "template", "label", "length", "span").agg(F.flatten(F.collect_list("ats")).alias("ats"), F.min("first").alias("first_word"), (F.max("last") + GRAM - 1).alias("last_word"))
    matched = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + GRAM - 1)))))
    spans = spans.withColumn("matched", matched).withColumn("cover", F.size(F.array_distinct("ats")) / (F.col("length") - GRAM + 1))
    near = F.col("last_word") - F.col("first_word") + 1 <= STRETCH * F.col("length") + SLACK
    return noted, spans.where((F.col("cover") >= COVER) & near).select("uid", "template", "label", "first_word", "last_word", "matched", "cover")


def report(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document."""
    noted, spans = scan(docs, templates)
    here = F.col("base").isNotNull()
    base = noted.groupBy("uid", "doc_id", "n_words").agg(
        F.count("base").alias("n_base"), F.min(F.when(here, F.col("pos"))).alias("first_word"), F.max(F.when(here, F.col("pos"))).alias("last_word"), F.collect_set("base").alias("found")
    )
    more = spans.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    labels = F.array_union("found", F.coalesce("more", F.array().cast("array<string>")))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("cover", F.lit(0.0)))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return base.join(more, "uid", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("found").alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))
