"""License scans by diagonal voting.

Every rolling hash of three words of every document is joined to the positions of the same three words in license templates. A
match votes for its diagonal, the document position less the template position; neighbouring diagonals are merged, so that a
word put in or left out does not break a match, and a merged span counts if it covers enough of the template. Of spans of
different licenses at one place, which share most of their words, the one with the most grams counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm.common import LOWER_TABLE, byte_set, gram_hashes, slices, utf8, word_hashes, word_spans

#: Words a gram has; share of a template's grams that a span must cover; words put in or left out between two merged diagonals.
GRAM, COVER, SLACK = 3, 0.8, 3
#: A template of so many grams may lack those of one changed word, even where that is more than ``COVER`` allows.
LONG = 3 * GRAM
_WORD = byte_set(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: The hash that stands for "a document" in the list of its grams.
_ROW = 0

# Phrases that name a license, and opening sentences of public license texts.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)
_CC = {"cc-by": "", "cc-by-sa": "sharealike ", "cc-by-nc": "noncommercial ", "cc-by-nd": "noderivatives ", "cc-by-nc-sa": "noncommercial sharealike ", "cc-by-nc-nd": "noncommercial noderivatives "}
_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Notices that name a license, and further paragraphs of license texts.
NOTICES = (
    ("gpl", "gnu general public license"),
    ("gpl", "gnu gpl version 2"),
    ("gpl", "gnu gpl version 3"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("agpl", "gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("mpl", "mozilla public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("mpl-2", "mozilla public license v 2 0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", "creative commons zero"),
    ("cc0", "cc0 1 0"),
    *((label, f"this work is licensed under a creative commons attribution {kind}{end}") for label, kind in _CC.items() for end in ("4 0 international license", "3 0 unported license")),
    *((label, f"creative commons attribution {kind}{v}") for label, kind in _CC.items() for v in _VERSIONS),
    *((label, f"{label.replace('-', ' ')} {v}") for label in _CC for v in _VERSIONS),
)
ALL = TEMPLATES + NOTICES


def _hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER_TABLE[np.frombuffer(text, np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _WORD)
    return gram_hashes(word_hashes(data, starts, ends), GRAM), starts, ends


def template_grams(spark: SparkSession, phrases=PHRASES, templates=ALL) -> DataFrame:
    """(h, tid, tpos, n_grams, label, base, gram) of every gram of every template: as many rows as the templates have words, and one for ``_ROW``."""
    rows = [(_ROW, -1, 0, 0, "", False, "")]
    for tid, (label, text, base) in enumerate([(*p, True) for p in phrases] + [(*t, False) for t in templates]):
        words = text.split()
        if len(words) < GRAM:
            raise ValueError(f"{text!r} has fewer than {GRAM} words, so no gram of it could be found")
        h, _, _ = _hashes(text.encode())
        rows += [(int(x), tid, i, len(h), label, base, " ".join(words[i : i + GRAM])) for i, x in enumerate(h.view(np.int64))]
    return spark.createDataFrame(rows, "h long, tid int, tpos int, n_grams int, label string, base boolean, gram string")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        data, offsets = utf8(b.column("_text"))
        data = LOWER_TABLE[data]
        starts, ends, first = word_spans(data, offsets, _WORD)
        n = np.diff(first)
        grams = gram_hashes(word_hashes(data, starts, ends), GRAM).view(np.int64)
        grams[grams == _ROW] = 1
        count = np.maximum(n - GRAM + 1, 0)
        at = np.cumsum(count + 1) - count - 1  # where each document's list begins, with _ROW
        hashes = np.full(int((count + 1).sum()), _ROW, np.int64)
        doc = np.repeat(np.arange(len(n)), count)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        hashes[at[doc] + 1 + inner] = grams[first[doc] + inner]
        places = np.concatenate((starts, [0])).astype(np.int64)
        begins = np.full(len(starts) + len(n), 0, np.int64)
        of = np.repeat(np.arange(len(n)), n)
        begins[np.arange(len(starts)) + of] = places[:-1] - offsets[of]
        begins[np.cumsum(n + 1) - 1] = np.diff(offsets)
        lists = [
            pa.ListArray.from_arrays(pa.array(np.append(at, len(hashes)), pa.int32()), pa.array(hashes)),
            pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(n + 1) - n - 1, len(begins)), pa.int32()), pa.array(begins, pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), b.column("_text"), pa.array(n, pa.int64()), *lists], ["_row", "doc_id", "_text", "n_words", "hashes", "begins"])


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def spans(docs: DataFrame, phrases=PHRASES, templates=ALL) -> DataFrame:
    """(_row, doc_id, n_words, tid, label, base, n_grams, n, start, until, coverage) of merged spans, and one row with tid -1 for every row of the table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").alias("_text"))
    grams = rows.mapInArrow(_grams, f"_row long, doc_id {kind}, _text string, n_words long, hashes array<long>, begins array<int>")
    each = grams.select("_row", "doc_id", "_text", "n_words", "begins", F.posexplode("hashes").alias("at", "h"))
    # The templates are constants of this module or arguments: a few hundred rows.
    met = each.join(F.broadcast(template_grams(docs.sparkSession, phrases, templates)), "h")
    exact = _plain(F.expr("substring(cast(_text as binary), get(begins, at - 1) + 1, get(begins, at + 2) - get(begins, at - 1))").cast("string")) == F.col("gram")
    met = met.where(F.when(F.col("tid") < 0, True).otherwise(exact))
    pos = F.col("at") - 1
    votes = met.groupBy("_row", "doc_id", "n_words", "tid", "label", "base", "n_grams", (pos - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("met"), F.min(pos).alias("start"), (F.max(pos) + GRAM).alias("until"))
    key = Window.partitionBy("_row", "tid").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(key) > F.when(F.col("base"), 0).otherwise(SLACK), F.lit(True))
    votes = votes.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(key))
    merged = votes.groupBy("_row", "doc_id", "n_words", "tid", "label", "base", "n_grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("n"), F.min("start").alias("start"), F.max("until").alias("until"))
    coverage = F.when(F.col("tid") < 0, 0.0).otherwise(F.col("n") / F.col("n_grams"))
    return merged.select("_row", "doc_id", "n_words", "tid", "label", "base", "n_grams", "n", "start", "until", coverage.alias("coverage"))


def scan(docs: DataFrame, phrases=PHRASES, templates=ALL, cover: float = COVER) -> DataFrame:
    """License labels of every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A base phrase counts at every place where all its words stand in a row; a template where a merged span covers ``cover`` of
    its grams, or lacks those of one changed word, unless a span of another license at the same place has more. A phrase or
    template of fewer than three words raises ``ValueError``. Null text counts as empty: no words, no labels, score 0. Repeated rows stay, each with its own result.
    """
    found = spans(docs, phrases, templates)
    place = (F.col("tid") >= 0) & F.col("base") & (F.col("coverage") == 1)
    changed = (F.col("n_grams") >= LONG) & (F.col("n_grams") - F.col("n") <= GRAM)
    other = (F.col("tid") >= 0) & ~F.col("base") & ((F.col("coverage") >= cover) | changed)
    more = lambda a, b: (b["n"] > a["n"]) | ((b["n"] == a["n"]) & (b["coverage"] > a["coverage"]))
    beats = lambda a, b: (a["label"] != b["label"]) & (a["start"] < b["until"]) & (b["start"] < a["until"]) & more(a, b)
    start = F.when(place, F.col("start").cast("long"))
    return (
        found.groupBy("_row", "doc_id", "n_words")
        .agg(
            F.count_if(place).alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            F.collect_set(F.when(place, F.col("label"))).alias("_base"),
            F.collect_set(F.when(other, F.struct("start", "until", "n", "coverage", "label"))).alias("_spans"),
        )
        .withColumn("_best", F.filter("_spans", lambda a: ~F.exists("_spans", lambda b: beats(a, b))))
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("_base", F.col("_best")["label"])), ",").alias("labels"),
            F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.col("_best")["coverage"]), F.lit(0.0))).alias("score"),
        )
    )
