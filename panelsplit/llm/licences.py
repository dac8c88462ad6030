"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

A paragraph is a line. Its features are its distinct words and pairs of neighbouring words (lower case, ASCII
letters and digits). One sparse logistic regression a licence family is fitted on the families' templates, whole
and with words left out or with foreign words around, against a bounded sample of the corpus' own paragraphs
(``background`` rows drawn by hash; those close to a template are left out). A Platt curve fitted on held-out
paragraphs calibrates the best family's margin; below ``least_score`` the paragraph is unknown. A prediction is
confirmed if the paragraph holds ``least_cover`` of the words of one of the family's templates.

Scoring uses DataFrame functions only. A paragraph can only reach the score if it holds one of the *cue* words:
they are chosen so that all other positive weights together stay below the threshold, so looking for them first
loses nothing. Only paragraphs with a cue are cut into features and weighed, in the task that reads them: the
weights of the templates' n-grams are constants of the plan, and only findings are shuffled.

Edge cases: null and empty texts and empty tables give no rows; rows that share a doc_id are scanned each, equal
findings count once; a null doc_id is a value; extra columns are ignored; whole texts are scanned.
"""

from __future__ import annotations

import math
import random
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import table

#: Usual notices of licence families.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
            "Licensed under the GNU GPL version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
}


def words_of(line: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", line.lower()).split()


def features_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _words(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _features(words: Column, vocabulary: list[str]) -> Column:
    """The distinct words and pairs of neighbouring words that the vocabulary holds."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_intersect(F.concat(words, pairs), _texts(vocabulary))


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


class LicenceModel(NamedTuple):
    weights: dict[str, dict[str, float]]  # family -> feature -> weight
    bias: dict[str, float]
    curve: tuple[float, float]  # score = 1 / (1 + exp(-(a + b * margin)))
    cues: tuple[str, ...]
    least_score: float


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_family(samples: list[tuple[set[str], bool]], vocabulary: set[str], rounds: int, ridge: float) -> tuple[dict[str, float], float]:
    """Sparse logistic regression by stochastic gradient steps; positives and negatives weigh the same."""
    rng = random.Random(11)
    weights, bias = dict.fromkeys(vocabulary, 0.0), 0.0
    share = max(1, sum(y for _, y in samples)) / max(1, sum(not y for _, y in samples))
    for r in range(rounds):
        rate = 0.3 / (1 + r)
        rng.shuffle(samples)
        for features, y in samples:
            step = rate * (1.0 if y else share) * (y - _sigmoid(bias + sum(weights[f] for f in features)))
            bias += step
            for f in features:
                weights[f] += step - rate * ridge * weights[f]
    return weights, bias


def _variants(template: str, foreign: list[str], rng: random.Random) -> list[list[str]]:
    words = words_of(template)
    out = [words] + [words[:i] + words[i + 1:] for i in range(len(words))] if len(words) > 3 else [words]
    return out + [rng.sample(foreign, min(3, len(foreign))) + words, words + rng.sample(foreign, min(3, len(foreign)))] * 2


def cue_words(weights: dict[str, dict[str, float]], bias: dict[str, float], least_margin: float) -> tuple[str, ...]:
    """Words such that no paragraph without any of them reaches the margin in any family."""
    cues: set[str] = set()
    for family, w in weights.items():
        rest = {f: v for f, v in w.items() if v > 0 and not cues.intersection(f.split())}
        while bias[family] + sum(rest.values()) >= least_margin and rest:
            best = max(rest, key=lambda f: (rest[f], f))
            cues.add(max(best.split(), key=lambda x: (w.get(x, 0) > 0, len(x), x)))
            rest = {f: v for f, v in rest.items() if not cues.intersection(f.split())}
    return tuple(sorted(cues))


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))


def fit_licences(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, background: int = 3000,
                 rounds: int = 12, ridge: float = 1e-4, least_score: float = 0.5) -> LicenceModel:
    """Fit on the templates and on at most ``background`` paragraphs of ``docs``, one of each drawn document."""
    drawn = docs.where(F.col("text").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(background)
    lines = F.split("text", "\n")
    nth = F.pmod(F.xxhash64("doc_id", F.lit("line")), F.size(lines)).cast("int")
    sampled = [r[0] for r in docs.where(F.col("text").isNotNull()).join(F.broadcast(drawn.distinct()), "doc_id", "left_semi")
               .select(F.element_at(lines, nth + 1).alias("line")).orderBy("line").limit(background).collect()]
    known = {family: [set(words_of(t)) for t in texts] for family, texts in templates.items()}
    others = [w for line in sampled if (w := words_of(line)) and max(len(t & set(w)) / len(t) for ts in known.values() for t in ts) < 0.5]
    rng = random.Random(5)
    foreign = [w for words in others[:500] for w in words[:3]] or ["x"]
    vocabulary = set().union(*(features_of(words_of(t)) for ts in templates.values() for t in ts))
    samples = [(features_of(v) & vocabulary, family) for family, ts in templates.items() for t in ts for v in _variants(t, foreign, rng)]
    samples += [(features_of(w) & vocabulary, None) for w in others]
    # Words that all families share ("licensed under the") do not make a licence by themselves.
    samples += [(features_of(words_of(t)) & vocabulary, None) for t in ("under the", "the license", "a copy of the", "version", "licensed under", "this work is")] * 5
    rng.shuffle(samples)
    held, train = samples[::4], [s for i, s in enumerate(samples) if i % 4]
    weights, bias = {}, {}
    for family in templates:
        weights[family], bias[family] = _fit_family([(f, label == family) for f, label in train], vocabulary, rounds, ridge)

    def margin(features):
        return max((bias[f] + sum(weights[f][x] for x in features), f) for f in templates)

    # Platt's curve on the held-out paragraphs, ascending: a larger margin is never less sure.
    points = [(z, float(f == label)) for features, label in held for z, f in [margin(features)]]
    a, b = 0.0, 1.0
    for _ in range(200):
        ga = sum(y - _sigmoid(a + b * z) for z, y in points) / max(1, len(points))
        gb = sum((y - _sigmoid(a + b * z)) * z for z, y in points) / max(1, len(points))
        a, b = a + ga, max(0.05, b + 0.1 * gb)
    least_margin = (math.log(least_score / (1 - least_score)) - a) / b
    return LicenceModel(weights, bias, (a, b), cue_words(weights, bias, least_margin - 1e-6), least_score)


def scan_licences(docs: DataFrame, model: LicenceModel, templates: dict[str, tuple[str, ...]] = TEMPLATES, least_cover: float = 0.7) -> DataFrame:
    """doc_id, paragraph (line number from 0), family, score, cover, confirmed of every paragraph that isn't unknown."""
    spark = docs.sparkSession
    if not model.cues:
        return spark.createDataFrame([], "doc_id bigint, paragraph int, family string, score double, cover double, confirmed boolean")
    cue = "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, model.cues)) + ")(?![a-z0-9])"
    lines = paragraphs(docs.where(F.col("text").rlike(cue))).where(F.col("line").rlike(cue))
    families = sorted(model.weights)
    vocabulary = sorted(set().union(*model.weights.values()))
    # Weights, biases and templates are constants of the plan, bounded by the templates; a paragraph is judged where it is read.
    weights = F.create_map(*[x for f in vocabulary for x in (F.lit(f), F.array(*[F.lit(model.weights[g].get(f, 0.0)) for g in families]))])
    a, b = model.curve

    def best(found: Column) -> Column:
        """Largest margin and its family, from the weights of the features found."""
        def total(i: int) -> Column:
            return F.aggregate(found, F.lit(0.0), lambda so_far, w: so_far + w[i])

        margins = [F.struct((total(i) + F.lit(model.bias[g])).alias("margin"), F.lit(g).alias("family")) for i, g in enumerate(families)]
        return F.array_max(F.array(*margins))

    def cover(words: Column, family: Column) -> Column:
        covers = [F.when(family == f, F.size(F.array_intersect(_texts(t), words)) / len(t))
                  for f, ts in templates.items() for t in [sorted(set(words_of(t))) for t in ts]]
        return F.array_max(F.array(*covers))

    def judged(words: Column) -> Column:
        scored = F.transform(F.filter(F.array(_features(words, vocabulary)), lambda f: F.size(f) > 0),
                             lambda f: _let(F.transform(f, lambda x: weights[x]), best))
        scored = F.transform(scored, lambda m: F.struct(m["family"].alias("family"), (1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * m["margin"])))).alias("score")))
        return F.transform(F.filter(scored, lambda m: m["score"] >= model.least_score),
                           lambda m: F.struct(m["family"].alias("family"), F.round(m["score"], 6).alias("score"), cover(words, m["family"]).alias("cover")))

    found = lines.select("doc_id", "paragraph", F.inline(_let(_words(F.col("line")), judged)))
    return found.select("doc_id", "paragraph", "family", "score", F.round("cover", 6).alias("cover"), (F.col("cover") >= least_cover).alias("confirmed")).distinct()


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licences(docs, fit_licences(docs))
