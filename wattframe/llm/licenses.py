"""Licence notices by a trained paragraph classifier, confirmed by templates.

A paragraph is a block of lines between blank ones. Within it, passages are looked at: neighbouring words that notices
hold too, over as many lines as they take. A passage is a sparse vector of word 1- to 3-grams. A multinomial logistic
regression tells the licence families and an unknown class apart. It is trained here: on the names and texts below in
varied wordings and cuts, and for the unknown class on paragraphs of the corpus and on sentences that only sound like
a notice. Its probabilities are calibrated by a temperature on wordings that the training does not hold. A family
counts only if the unknown class is improbable enough and the passage holds enough of the neighbouring words of one of
the family's templates. What a confirmed template covers is taken out and the rest is classified again, so that one
paragraph can give several families.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Paragraphs of the corpus for the unknown class: from so many documents, chosen by a hash of their ids.
MAX_BACKGROUND_DOCUMENTS = 500
MAX_BACKGROUND_PARAGRAPHS = 4_000
#: Lines of the sample are cut into pieces of so many characters; texts that are scanned are not.
BACKGROUND_PIECE = 2_000
#: The least probability that a passage is of any family.
MIN_PROBABILITY = 0.8
#: A family less probable than this is not compared with its templates.
MIN_FAMILY = 0.02
MIN_SIMILARITY = 0.6
#: Words that may lie between two neighbouring words of a notice, such as names of holders.
MAX_GAP = 12
STEPS = 200
RATE = 0.2
L2 = 1e-4
SEED = 7

# Names of public licences, as notices write them.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "MIT": ("MIT License", "MIT licence", "terms of the MIT License"),
    "GPL": ("GNU General Public License", "GNU GPL", "terms of the GNU General Public License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GNU General Public License version 3 or later"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GNU General Public License version 2"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "GNU Lesser General Public License, version 3"),
    "AGPL": ("GNU Affero General Public License", "GNU AGPL v3", "GNU Affero General Public License, version 3"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"),
    "CC0": ("CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero"),
    "ISC": ("ISC License", "ISC licence", "terms of the ISC License"),
    "Unlicense": ("The Unlicense", "Unlicense public domain dedication", "the Unlicense license"),
    "Zlib": ("zlib License", "zlib/libpng License", "terms of the zlib License"),
}
# Passages of public licences and their standard headers.
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
BODIES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",),
    "MIT": ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software.""",),
    "BSD": ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",),
    "GPL-3.0": (GNU_HEADER.format(name="GNU General Public License", version=3),),
    "GPL-2.0": (GNU_HEADER.format(name="GNU General Public License", version=2),),
    "LGPL": (GNU_HEADER.format(name="GNU Lesser General Public License", version=3),),
    "AGPL": (GNU_HEADER.format(name="GNU Affero General Public License", version=3),),
    "MPL-2.0": ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",),
    "CC0": ("""To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work. This work is published under the CC0 Public Domain Dedication.""",),
    "ISC": ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",),
    "Unlicense": ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",),
    "Zlib": ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions""",),
}
FRAMES = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
    "This work is licensed under {}.", "This file is distributed under the terms of the {}.", "{}",
    "You may use this software under the {}.", "Available under {}, see the LICENSE file.", "SPDX: {}",
)
CALIBRATION_FRAMES = ("Code in this folder is covered by the {}.", "The package as a whole follows {}.", "Published on the terms of {} only.")
SOUNDALIKES = (
    "He renewed his driving license last week.", "The general public was invited to the opening.", "Version 2.0 of the report is out.",
    "Creative people share common ideas.", "The attribution of the painting is disputed.", "This work is not finished.",
    "MIT announced a new course.", "The Apache tribe lived in the south west.", "All rights reserved.", "The license expired in 2019.",
    "A public license hearing was held.", "Released under pressure, the minister spoke.", "The file is under the table.",
    "Terms of the agreement were not disclosed.", "Mozilla released a new browser.", "See the file for version 3 of the text.",
)
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_LINE = re.compile(r"[^\n]+")
FOUND = "array<struct<family: string, start: int, end: int, probability: double, similarity: double>>"


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def runs_of(words: list[str], known: frozenset[str]) -> list[list[str]]:
    """The words, cut at those that no notice holds: grams and pairs of notices lie within a run."""
    runs, run = [], []
    for word in words:
        if word in known:
            run.append(word)
        elif run:
            runs.append(run)
            run = []
    return [*runs, run] if run else runs


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


class Template:
    """The neighbouring words of a notice, in order."""

    def __init__(self, text: str):
        words = words_of(text)
        self.place: dict[tuple[str, str], int] = {}
        repeated = set()
        for n, pair in enumerate(pairwise(words)):
            repeated |= {pair} & self.place.keys()
            self.place.setdefault(pair, n)
        # a pair that a notice holds twice says nothing about the place in it
        self.ordered = {pair: n for pair, n in self.place.items() if pair not in repeated}

    def instances(self, words: list[str], gap: int = MAX_GAP) -> list[tuple[float, int, int]]:
        """(similarity, first word, end) of every place that holds enough of the template.

        A place ends where `gap` other words follow or the order of the template starts anew.
        """
        found, seen, first, last, at = [], set(), 0, None, 0

        def close() -> None:
            if len(seen) >= MIN_SIMILARITY * len(self.place):
                found.append((len(seen) / len(self.place), first, last + 2))

        for i, pair in enumerate(pairwise(words)):
            if pair not in self.place:
                continue
            here = self.ordered.get(pair, at)
            if last is not None and (i - last > gap or at - here > len(self.place) / 2 or len(seen) == len(self.place)):
                close()
                seen, first = set(), i
            first = first if seen else i
            seen.add(pair)
            last, at = i, here
        close()
        return found


@dataclass(frozen=True)
class LicenseModel:
    """Weights per gram and class (unknown first), intercepts, temperature; the templates of names and of texts.

    `starts` holds the words that may follow a word within a notice; `known` all words of notices.
    """

    classes: list[str]
    weights: dict[str, np.ndarray]
    intercept: np.ndarray
    temperature: float
    names: dict[str, list[Template]]
    bodies: dict[str, list[Template]]
    starts: dict[str, set[str]]
    name_starts: dict[str, set[str]]
    known: frozenset[str]

    def probabilities(self, words: list[str]) -> np.ndarray | None:
        """Of each class, unknown first; None if no gram is known."""
        known = [self.weights[g] for g in set().union(*map(grams_of, runs_of(words, self.known))) if g in self.weights]
        if not known:
            return None
        # as in training, a vector of length 1 whatever the length of the passage
        logit = (self.intercept + sum(known) / np.sqrt(len(known))) / self.temperature
        p = np.exp(logit - logit.max())
        return p / p.sum()

    def confirmed(self, words: list[str], templates: dict[str, list[Template]], gap: int) -> tuple[str, float, list]:
        """(family, its probability, instances of its templates) of the most probable family that a template confirms."""
        p = self.probabilities(words)
        if p is None:
            return UNKNOWN, 1.0, []
        if 1 - p[0] >= MIN_PROBABILITY:
            for best in np.argsort(-p[1:], kind="stable") + 1:
                if p[best] < MIN_FAMILY:
                    break
                places = [x for t in templates.get(self.classes[best], []) for x in t.instances(words, gap)]
                if places:
                    return self.classes[best], float(p[best]), places
        return UNKNOWN, float(p[0]), []

    def peel(self, words: list[str], templates: dict[str, list[Template]], gap: int) -> Iterator[tuple[str, float, list]]:
        """Confirmed families one after the other; covered words are emptied in `words`. At most one round a class."""
        for _ in self.classes:
            family, probability, places = self.confirmed(words, templates, gap)
            if family == UNKNOWN:
                return
            # of places that overlap the most similar one, then the longest, stays
            apart = []
            for place in sorted(places, key=lambda x: (-x[0], x[1] - x[2], x[1])):
                if "" not in words[place[1] : place[2]]:
                    apart.append(place)
                    words[place[1] : place[2]] = [""] * (place[2] - place[1])
            if not apart:
                return
            yield family, probability, sorted(apart, key=lambda x: x[1])

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(most probable confirmed family or unknown, probability, similarity to its nearest template)."""
        words = words_of(paragraph)
        for templates in (self.bodies, self.names):
            family, probability, places = self.confirmed(words, templates, MAX_GAP)
            if family != UNKNOWN:
                return family, probability, max(x[0] for x in places)
        return UNKNOWN, probability, 0.0

    def scan(self, text: str | None) -> list[dict]:
        """Notices in order of place and family; a notice's place is that of the lines it lies on."""
        found: dict[tuple, tuple[float, float]] = {}
        block: list[tuple[int, int, list[str]]] = []
        for line in _LINE.finditer(text or ""):
            # two line ends, or a line of blanks, separate blocks
            if block and line.start() > block[-1][1] + 1 or line.group().isspace():
                self._scan_block(block, found)
                block = []
            if not line.group().isspace():
                block.append((line.start(), line.end(), words_of(line.group())))
        self._scan_block(block, found)
        return [{"family": f, "start": a, "end": b, "probability": p, "similarity": s} for (a, b, f), (p, s) in sorted(found.items())]

    def _scan_block(self, block: list[tuple[int, int, list[str]]], found: dict) -> None:
        words = [w for _, _, line in block for w in line]
        hits = [i for i, (a, b) in enumerate(pairwise(words)) if a in self.starts and b in self.starts[a]]
        if not hits:
            return
        line_of = [n for n, (_, _, line) in enumerate(block) for _ in line]

        def add(family: str, probability: float, places: list, at: int) -> None:
            for similarity, first, end in places:
                key = (block[line_of[at + first]][0], block[line_of[at + end - 1]][1], family)
                found[key] = max(found.get(key, (0, 0)), (probability, similarity))

        # texts of licences, over as many lines as they take
        least = MIN_SIMILARITY * min(len(t.place) for group in self.bodies.values() for t in group)
        first = 0
        for n in range(1, len(hits) + 1):
            if n < len(hits) and hits[n] - hits[n - 1] <= MAX_GAP:
                continue
            if n - first >= least:
                at, end = hits[first], hits[n - 1] + 2
                passage = words[at:end]
                for family, probability, places in self.peel(passage, self.bodies, MAX_GAP):
                    add(family, probability, places, at)
                words[at:end] = passage
            first = n
        # names, line by line; a name that a line begins may end on the next one
        at = 0
        for _, _, line in block:
            end = at + len(line)
            reach = end
            while at < end and reach < len(words) and words[reach] in self.name_starts.get(words[reach - 1], ()):
                reach += 1
            passage = words[at:reach]
            if any(b in self.name_starts.get(a, ()) for a, b in pairwise(passage)):
                for family, probability, places in self.peel(passage, self.names, 2):
                    add(family, probability, [x for x in places if x[1] < end - at], at)
                words[at:end] = passage[: end - at]
                # what lies on the next line is used up only by a name that began on this one
                for i in range(end, reach):
                    if passage[i - at] == "" and words[i - 1] == "":
                        words[i] = ""
            at = end


def train(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> LicenseModel:
    """The model; the corpus gives background for the unknown class only, from a bounded sample of documents.

    Background that holds a licence's name or text is left out, as it is no background. An empty corpus leaves the
    sentences that only sound like a notice.
    """
    n = docs.select(row_id).where(F.col(row_id).isNotNull()).count()
    share = F.pmod(F.xxhash64(F.col(row_id)), F.lit(1_000_000)) < 1_000_000 * MAX_BACKGROUND_DOCUMENTS / max(n, 1)
    pieces = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[^\\n]{{1,{BACKGROUND_PIECE}}}"), F.lit(0))
    lines = docs.where(F.col(row_id).isNotNull() & share).select(F.explode(pieces).alias("line"))
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(MAX_BACKGROUND_PARAGRAPHS)
    background = [r["line"] for r in lines.collect()]

    names = {family: [Template(n) for n in group] for family, group in NAMES.items()}
    bodies = {family: [Template(n) for n in group] for family, group in BODIES.items()}
    notices = [t for group in (*names.values(), *bodies.values()) for t in group]
    classes = [UNKNOWN, *NAMES]
    examples = [(frame.format(name), classes.index(family), frame in CALIBRATION_FRAMES) for family, group in NAMES.items()
                for name in group for frame in (*FRAMES, *CALIBRATION_FRAMES)]
    examples += [(cut, classes.index(family), held) for family, group in BODIES.items() for body in group for cut, held in _cuts(body)]
    examples += [(s, 0, False) for s in SOUNDALIKES]
    plain = [line for line in background if not any(t.instances(words_of(line)) for t in notices)]
    examples += [(line, 0, n % 5 == 0) for n, line in enumerate(plain)]
    return _fit(classes, examples, names, bodies)


def _cuts(body: str) -> Iterator[tuple[str, bool]]:
    """(words, for calibration): the whole body and runs of two thirds and more of it; for calibration, with gaps."""
    words = body.split()
    for n in range(12):
        first, end = len(words) * (n % 4) // 12, len(words) * (12 - n // 4) // 12
        yield " ".join(words[first:end]), False
        if n % 3 == 0:
            yield " ".join(w for i, w in enumerate(words[first:end]) if i % 9 != n % 9), True


def _starts(templates: dict[str, list[Template]]) -> dict[str, set[str]]:
    starts: dict[str, set[str]] = {}
    for a, b in {pair for group in templates.values() for t in group for pair in t.place}:
        starts.setdefault(a, set()).add(b)
    return starts


def _fit(classes: list[str], examples: list[tuple[str, int, bool]], names: dict[str, list[Template]],
         bodies: dict[str, list[Template]]) -> LicenseModel:
    label = np.array([y for _, y, _ in examples])
    holdout = np.array([held for _, _, held in examples])
    grams = [grams_of(words_of(x)) for x, _, _ in examples]
    # features are the grams of notices; what else a passage holds says nothing
    vocabulary = {g: i for i, g in enumerate(sorted({g for x, y, held in zip(grams, label, holdout, strict=True) if y and not held for g in x}))}
    rows = [np.array([vocabulary[g] for g in sorted(x) if g in vocabulary], np.int64) for x in grams]
    value = np.concatenate([np.full(len(r), 1 / np.sqrt(max(len(r), 1))) for r in rows])
    row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    # every class weighs the same, however many examples it has
    weight = 1.0 / np.bincount(label[~holdout], minlength=len(classes))[label]
    weight = np.where(holdout, 0, weight) / weight[~holdout].sum()
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    target = np.eye(len(classes))[label]
    mean, square = np.zeros((len(vocabulary) + 1, len(classes))), np.zeros((len(vocabulary) + 1, len(classes)))

    def summed(into: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(into, v, n) for v in values.T], axis=1)

    def logits() -> np.ndarray:
        return b + summed(row, w[column] * value[:, None], len(rows))

    def softmax(x: np.ndarray) -> np.ndarray:
        p = np.exp(x - x.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for step in range(1, STEPS + 1):
        error = (softmax(logits()) - target) * weight[:, None]
        grad = np.zeros_like(mean)
        grad[:-1] = summed(column, error[row] * value[:, None], len(vocabulary)) + L2 * w
        grad[-1] = error.sum(axis=0)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        change = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    final, best = logits()[holdout], (np.inf, 1.0)
    for temperature in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        p = softmax(final / temperature)[np.arange(holdout.sum()), label[holdout]]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), temperature))
    words = frozenset(g for g in vocabulary if " " not in g)
    starts = _starts({f: [*names.get(f, []), *bodies.get(f, [])] for f in classes})
    return LicenseModel(classes, {g: w[i] for g, i in vocabulary.items()}, b, best[1], names, bodies, starts, _starts(names), words)


def scan_licenses(docs: DataFrame, model: LicenseModel, text: str = "text") -> DataFrame:
    """The rows with `licenses`: the confirmed notices in order of place (code points of their lines, end exclusive).

    A column of this name is replaced. Null and empty texts have none; each line that names a family counts, repeated
    ones too. Whole texts are scanned, paragraph by paragraph; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for batch in texts:
            yield pd.Series([known.scan(t) for t in batch], dtype=object)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "licenses"]
    return docs.select(*kept, scanned(F.col(text).cast("string")).alias("licenses"))
