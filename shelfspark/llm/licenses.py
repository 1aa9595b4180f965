"""Licence scans by a trained paragraph classifier, with DataFrame and SQL functions only.

A logistic regression over sparse counts of words, word pairs and word triples says which
licence family a paragraph belongs to, or none. It is trained on ``EXAMPLES`` invented
paragraphs: notices of the families, cut, framed and mixed with other words, against prose
and near misses. A temperature calibrates its probabilities, and a paragraph below the
probability at which the wanted precision is reached is unknown; both are fitted on held-out
examples and on ``PROSE_LINES`` lines of the corpus at most that have no word of licences. A
prediction stands if the paragraph also covers a template of the family.

Every line with a word is a paragraph, and so are the lines of a wrapped notice together:
consecutive lines of ``WRAPPED`` characters at most, without comment marks, joined. Of more
than ``BLOCK`` such lines, each window of ``BLOCK`` lines that starts every half of that is one,
so that a notice of so many lines as half a block, and one more, is whole in one of them. Every
paragraph goes through the classifier. Of a notice found in a line and in a block, or in two
blocks, the smaller and earlier one counts.

Defined results: a null text counts as empty and has no paragraphs; very long paragraphs are
read whole; of families of equal probability the first by name is taken; repeated rows, null or
equal ids are scanned each; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import json
import random

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import ROW_ID, RowName, known_rows, write_table

#: Training examples (a third as many are held out), distinct n-grams kept, and the precision asked for on the held-out ones.
EXAMPLES, VOCABULARY, PRECISION = 2_400, 6_000, 0.995
#: Lines of the corpus, one of a document, that calibration takes at most, and the longest; they have no word of licences.
PROSE_LINES, LONGEST_PROSE = 512, 1_000
LICENCE_WORD = r"(?i)licen[sc]|copyright|copyleft|public domain|unencumbered|warrant|redistribut|spdx|permission|permitted"
#: Characters of a line that may be a part of a wrapped notice, and lines of a block.
WRAPPED, BLOCK = 100, 12
#: What stands before a line's words in comments.
COMMENT = r"(?i)^\s*(?:(?:dnl|rem)\b)?[^\p{L}\p{N}]*"
#: Share of a template's words, word pairs and triples that a paragraph has to cover.
COVERED = 0.6
UNKNOWN = "unknown"
#: Usual notices of licence families.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the terms of the Apache License.",
        "Apache License Version 2.0, January 2004",
    ),
    "mit": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the MIT License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL version 2.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 3.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
        "BSD 3-Clause License",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License.",
    ),
    "public_domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
NEAR_MISSES = (
    "He lost his driver license and the police gave him a new one.", "The fishing license costs ten dollars a year.", "You need permission to use the source of the river.",
    "The general public was free to modify the terms of the work.", "She studied at MIT and released a book.", "An Apache helicopter of version two was sold.", "The commons is a creative place for the public.",
    "They drove under the bridge and released the software version later.", "Mozilla is a browser.", "The domain of the function is public.", "The gnu is an animal of the savannah.", "This work is under way.", "All the conditions are met, with or without rain.",
    "The library is free of charge to any person.", "Poetic license allows a writer to bend the rules.", "The doctor is licensed to practise in this state.",
)
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch en ge ung sch lich eau tre".split()
PROSE = "the of and to a in is that for was on are as with they be at one have this from or had by work use free under public version terms code file copy person source form software general".split()


def _examples(n: int, seed: int) -> list[tuple[str, str]]:
    """(text, family): notices whole or cut to a part that still has most of their words, framed by prose; and prose."""
    rng, families = random.Random(seed), sorted(TEMPLATES)

    def prose(k: int) -> str:
        return " ".join(rng.choice(PROSE) if rng.random() < 0.4 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(k))

    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            family = families[i % len(families)]
            words = rng.choice(TEMPLATES[family]).split()
            if len(words) > 8 and rng.random() < 0.3:
                cut = rng.randrange(1 + len(words) // 6)
                words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
            text = " ".join(words)
            for place in (0, 1):
                if rng.random() < 0.4:
                    extra = prose(rng.randrange(1, rng.choice((6, 60))))
                    text = f"{extra} {text}" if place else f"{text} {extra}"
            out.append((text, family))
        elif kind < 0.75:
            out.append((f"{prose(rng.randrange(5))} {rng.choice(NEAR_MISSES)} {prose(rng.randrange(20))}", UNKNOWN))
        else:
            out.append((prose(rng.randrange(1, 80)), UNKNOWN))
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that the JVM makes of a literal."""
    names = [x.strip().split(" ", 1)[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), "array<struct<" + ", ".join(x.replace(" ", ":", 1) for x in schema.split(", ")) + ">>")))


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; digits of versions stay apart."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(words: Column) -> Column:
    """Words, pairs and triples."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    triples = F.zip_with(pairs, F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(triples, 1, F.greatest(F.size(words) - 2, F.lit(0))))


def corpus_prose(docs: DataFrame) -> DataFrame:
    """(paragraph): of ``PROSE_LINES`` documents at most (the least hash of each share of hashes) one line that has no word of licences."""
    hashed = docs.select("text", F.xxhash64("text").alias("hash")).where("text is not null")
    # A table of a row a share: its size is known when the join is planned, and lines are cut for the chosen documents only.
    chosen = write_table(hashed.groupBy(F.pmod("hash", F.lit(PROSE_LINES)).alias("share")).agg(F.min("hash").alias("hash")).select("hash"), "licence-prose")
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) <= LONGEST_PROSE) & x.rlike(r"\p{L}") & ~x.rlike(LICENCE_WORD))
    least = F.array_min(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("hash"), x.alias("line"))))["line"]
    return hashed.join(chosen, "hash", "left_semi").select(least.alias("paragraph")).where("paragraph is not null").distinct()


class Classifier:
    """A fitted model with its temperature and the least probability of a known family; ``docs`` is the corpus it will read."""

    def __init__(self, spark: SparkSession, docs: DataFrame | None = None, examples: int = EXAMPLES, seed: int = 11) -> None:
        self.labels = [UNKNOWN, *sorted(TEMPLATES)]
        rows = _table(spark, _examples(examples, seed), "paragraph string, family string")
        held = _table(spark, _examples(examples // 3, seed + 1), "paragraph string, family string")
        if docs is not None:
            held = held.union(corpus_prose(docs).withColumn("family", F.lit(UNKNOWN)))
        features = self._grams(rows)
        counts = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=2, binary=True).fit(features)
        index = StringIndexerModel.from_labels(self.labels, inputCol="family", outputCol="label")
        fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=80).fit(index.transform(counts.transform(features)))
        # Only the scores are used.
        self.model = PipelineModel([counts, fitted.setProbabilityCol("").setPredictionCol("")])
        raw = index.transform(self.model.transform(self._grams(held))).select("label", vector_to_array("rawPrediction").alias("raw"))
        raw = write_table(raw, "licence-calibration")
        self.temperature = self._temperature(raw)
        self.least = self._least(raw)

    @staticmethod
    def _grams(rows: DataFrame) -> DataFrame:
        words = rows.withColumn("words", words_of(F.col("paragraph")))
        return words.withColumn("grams", ngrams(F.col("words"))).drop("words")

    @staticmethod
    def _softmax(raw: Column, temperature: Column) -> Column:
        top = F.array_max(raw)
        powers = F.transform(raw, lambda x: F.exp((x - top) / temperature))
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        return F.transform(powers, lambda x: x / total)

    def _temperature(self, raw: DataFrame) -> float:
        """The temperature of least log loss on the held-out examples."""
        grid = raw.withColumn("t", F.explode(F.array(*(F.lit(0.25 * 1.25**k) for k in range(14)))))
        loss = -F.log(F.greatest(F.get(self._softmax(F.col("raw"), F.col("t")), F.col("label").cast("int")), F.lit(1e-12)))
        return float(grid.groupBy("t").agg(F.avg(loss).alias("loss")).orderBy("loss", "t").first()["t"])

    def _least(self, raw: DataFrame) -> float:
        """The least probability of a family from which on the held-out precision is reached."""
        p = self._softmax(F.col("raw"), F.lit(self.temperature))
        scored = raw.select("label", p.alias("p")).select("label", F.array_max("p").alias("top"), (F.array_position("p", F.array_max("p")) - 1).alias("found")).where("found > 0")
        grid = scored.withColumn("least", F.explode(F.array(*(F.lit(k / 20) for k in range(8, 20))))).where("top >= least")
        good = grid.groupBy("least").agg(F.avg((F.col("label") == F.col("found")).cast("double")).alias("precision")).where(F.col("precision") >= PRECISION).orderBy("least").first()
        return float(good["least"]) if good else 0.95

    def predict(self, paragraphs: DataFrame) -> DataFrame:
        """The ``paragraphs`` (paragraph) of known family, with its calibrated probability and whether a template confirms it."""
        raw = self.model.transform(self._grams(paragraphs)).select(*paragraphs.columns, vector_to_array("rawPrediction").alias("raw"))
        p = self._softmax(F.col("raw"), F.lit(self.temperature))
        top = raw.select(*paragraphs.columns, p.alias("p")).withColumn("probability", F.array_max("p"))
        name = F.get(F.array(*map(F.lit, self.labels)), (F.array_position("p", F.col("probability")) - 1).cast("int"))
        named = top.select(*paragraphs.columns, "probability", F.when(F.col("probability") >= self.least, name).otherwise(F.lit(UNKNOWN)).alias("family"))
        # Unknown ones are dropped by a generator, through which no filter is pushed: scores are computed once.
        one = F.when(F.col("family") != UNKNOWN, F.array(F.struct(*named.columns)))
        known = named.select(F.inline(F.coalesce(one, F.array().cast(f"array<{named.schema.simpleString()}>"))))
        covered = self._grams(known).withColumn("coverage", self._coverage())
        return covered.withColumn("confirmed", F.col("coverage") >= COVERED).drop("grams")

    @staticmethod
    def _coverage() -> Column:
        """The greatest share of a template's n-grams that the paragraph has."""
        shares = []
        for family, templates in TEMPLATES.items():
            lists = [_plain_ngrams(t) for t in templates]
            best = F.greatest(*(F.size(F.array_intersect("grams", F.array(*map(F.lit, g)))) / len(g) for g in lists), F.lit(0.0))
            shares.append(F.when(F.col("family") == family, best))
        return F.coalesce(*shares, F.lit(0.0))


def _plain_ngrams(text: str) -> list[str]:
    w = _plain_words(text)
    return sorted({" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)})


def _plain_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def paragraphs(docs: DataFrame) -> DataFrame:
    """(__row_id, position, n_lines, paragraph): the lines of ``docs`` (__row_id, text) that have a word, and the blocks of wrapped lines."""
    lines = docs.select(ROW_ID, F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = lines.withColumn("filled", F.transform("lines", lambda x: x.rlike(r"[\p{L}\p{N}]")))
    short = F.zip_with("lines", "filled", lambda x, f: f & (F.length(x) <= WRAPPED))
    lines = lines.withColumn("short", short)
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    is_short = lambda i: F.coalesce(F.get("short", i), F.lit(False))
    starts = F.filter(at, lambda i: is_short(i) & ~is_short(i - 1))
    ends = F.filter(at, lambda i: is_short(i) & ~is_short(i + 1))
    spans = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("begin"), (b + 1).alias("end"))), lambda r: r["end"] - r["begin"] > 1)
    half = BLOCK // 2
    steps = lambda r: F.sequence(F.lit(0), F.greatest(F.ceil((r["end"] - r["begin"] - BLOCK) / half), F.lit(0)).cast("int"))
    blocks = F.flatten(F.transform(spans, lambda r: F.transform(steps(r), lambda k: F.struct((r["begin"] + k * half).alias("position"), F.least(r["end"] - r["begin"] - k * half, F.lit(BLOCK)).alias("n_lines")))))
    joined = lambda x: F.array_join(F.transform(F.slice("lines", x["position"] + 1, x["n_lines"]), lambda line: F.regexp_replace(line, COMMENT, "")), " ")
    both = F.concat(
        F.transform(F.filter(at, lambda i: F.get("filled", i)), lambda i: F.struct(i.alias("position"), F.lit(1).alias("n_lines"), F.get("lines", i).alias("paragraph"))),
        F.transform(blocks, lambda x: F.struct(x["position"], x["n_lines"], joined(x).alias("paragraph"))),
    )
    return lines.select(ROW_ID, F.inline(both))


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """(__row_id, position, n_lines, paragraph, family, probability, coverage, confirmed) of the paragraphs of ``docs`` (__row_id, text) of known family."""
    model = classifier or Classifier(docs.sparkSession, docs)
    return model.predict(paragraphs(docs))


def documents(docs: DataFrame, classifier: Classifier | None = None, row: RowName | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): paragraphs, confirmed licence paragraphs, their families and places; ``row`` as in ``known_rows``."""
    stored = known_rows(docs.select("doc_id", "text"), row).select(ROW_ID, F.col("input.doc_id").cast("bigint").alias("doc_id"), F.col("input.text").alias("text"))
    found = write_table(scan(stored, classifier).where("confirmed").drop("paragraph"), "licence-paragraphs")
    one = F.struct("position", "family", "n_lines")
    lists = found.groupBy(ROW_ID).agg(F.array_sort(F.collect_list(one)).alias("found"), F.min("probability").alias("least_probability"))
    # The same notice in a smaller paragraph, or in an earlier one of its size.
    inside = lambda x, y: (x["family"] == y["family"]) & (y["position"] < x["position"] + x["n_lines"]) & (x["position"] < y["position"] + y["n_lines"])
    before = lambda x, y: (y["n_lines"] < x["n_lines"]) | ((y["n_lines"] == x["n_lines"]) & (y["position"] < x["position"]))
    lists = lists.withColumn("found", F.filter("found", lambda x: (x["n_lines"] == 1) | ~F.exists("found", lambda y: inside(x, y) & before(x, y))))
    filled = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    rows = stored.select(ROW_ID, "doc_id", F.size(filled).cast("bigint").alias("n_paragraphs"))
    joined = rows.join(lists, ROW_ID, "left")
    return joined.select(
        "doc_id",
        "n_paragraphs",
        F.coalesce(F.size(F.col("found")), F.lit(0)).cast("bigint").alias("n_licences"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ","), F.lit("")).alias("families"),
        F.coalesce(F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["family"], x["position"].cast("string"))), ","), F.lit("")).alias("places"),
        F.round("least_probability", 4).alias("least_probability"),
    )
