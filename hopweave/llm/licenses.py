"""Licence scans: lines of headers and licence files against templates, then inheritance down a tree of directories.

Each template is a set of weighted terms: words and word pairs by term frequency and inverse document frequency, which
is counted over all documents. Lines, their sentences, blocks of lines and whole texts are compared by sparse cosine
with every template that shares a term; the best above a threshold is the document's own licence. A file that is a licence by
name, or by its text, gives its licence to its directory; a document without a licence of its own inherits from the nearest
ancestor directory that has one, by a join of each directory's ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import if_small, map_batches, materialize

#: Short notices of common licences, by SPDX name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx license identifier mit"),
    "Apache-2.0": ("licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "spdx license identifier apache 2.0"),
    "GPL-3.0": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "free software you can redistribute it and or modify it under the terms of the gnu general public license version 3", "spdx license identifier gpl 3.0"),
    "GPL-2.0": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2.0"),
    "LGPL-3.0": ("licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0"),
    "AGPL-3.0": ("licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0"),
    "BSD-3-Clause": ("licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted", "spdx license identifier bsd 3 clause"),
    "MPL-2.0": ("subject to the terms of the mozilla public license version 2.0", "spdx license identifier mpl 2.0"),
    "CC-BY-4.0": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "licensed under the creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by sa 4.0", "licensed under the creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by nc 4.0", "licensed under the creative commons attribution noncommercial 4.0 international license"),
    "CC0-1.0": ("dedicated to the public domain under cc0 1.0", "no rights reserved public domain dedication"),
    "Unlicense": ("free and unencumbered software released into the public domain",),
    "Proprietary": ("all rights reserved proprietary and confidential", "unauthorized copying of this file is strictly prohibited"),
}
#: Headers as projects print them, over several lines; whole licence files.
_GNU = "free software you can redistribute it and or modify it under the terms of the gnu {k}general public license as published by the free software foundation either version {v} of the license or at your option any later version"
HEADERS = {
    "GPL-3.0": _GNU.format(k="", v="3"), "GPL-2.0": _GNU.format(k="", v="2"), "LGPL-3.0": _GNU.format(k="lesser ", v="3"), "AGPL-3.0": _GNU.format(k="affero ", v="3"),
    "Apache-2.0": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
}
FULL_TEXTS = {
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BSD-3-Clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
}
#: The heads of licence files whose texts are too long to be templates: a text that begins with one is that licence's file.
_GNU_HEAD = "gnu {k}general public license version {v} copyright c {y} free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
HEADS = {
    "GPL-3.0": _GNU_HEAD.format(k="", v="3 29 june 2007", y="2007"), "GPL-2.0": _GNU_HEAD.format(k="", v="2 june 1991", y="1989 1991"),
    "LGPL-3.0": _GNU_HEAD.format(k="lesser ", v="3 29 june 2007", y="2007"), "AGPL-3.0": _GNU_HEAD.format(k="affero ", v="3 19 november 2007", y="2007"),
    "Apache-2.0": "apache license version 2.0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution",
    "MPL-2.0": "mozilla public license version 2.0 1 definitions 1.1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
}
#: A part's least cosine; words that a licence file may hold beside matched parts, as a share, and words that must match at least.
LEAST, OTHER_WORDS, LEAST_WORDS = 0.72, 0.2, 30
#: Cosine of a whole text from which it is a licence file: other terms have at most a fifth of its squared weight.
LEAST_FILE = 0.9
_SENTENCES = re.compile(r"(?<=[a-z)\d])\.\s+|;\s+")
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$"
#: What stands before and behind the words of a comment's line.
_MARKS = re.compile(r"^\s*(?:/\*+|\*+/|<!--|//+[/!]?|\*+|#+|--+|;+|%+|\.\.|dnl\b|rem\b)?\s*|\s*(?:\*+/|-->)?\s*$", re.IGNORECASE)
_TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)?")


def words_of(text: str) -> list[str]:
    return _TERM.findall(text.lower())


NOTICES = [(name, words_of(note)) for name, notes in TEMPLATES.items() for note in notes] + [(name, words_of(text)) for texts in (HEADERS, FULL_TEXTS, HEADS) for name, text in texts.items()]
_FIRST_HEAD = len(NOTICES) - len(HEADS)
#: Words and word pairs of the templates.
_WORDS = frozenset(w for _, note in NOTICES for w in note)
_PAIRS = frozenset(pair for _, note in NOTICES for pair in zip(note, note[1:], strict=False))


def known(words: list[str]) -> list:
    """The templates' words and pairs in a list of words, with repeats: what a cosine with a template can come from."""
    return [*filter(_WORDS.__contains__, words), *filter(_PAIRS.__contains__, zip(words, words[1:], strict=False))]


def name_of(term: str | tuple[str, str]) -> str:
    return term if isinstance(term, str) else " ".join(term)


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Over all texts: in how many each term of the templates occurs, on any line or over two, and how many texts there are. At most len(_WORDS) + len(_PAIRS) rows."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter()
        for text in batch.column(0).to_pylist():
            found.update({*known(words_of(text))})
        return pa.RecordBatch.from_arrays([pa.array(map(name_of, found), pa.string()), pa.array([*found.values()], pa.int64())], ["term", "n"])

    counted = map_batches(docs.select(F.coalesce("text", F.lit("")).alias("text")), lambda: step, "term string, n long")
    return {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}, docs.count()


class Matcher:
    """Sparse cosines of a part of a text to the templates, through an inverted index of their terms. Terms of no template
    weigh as if no text had them.

    Parts are left out by two bounds alone, neither of which loses a cosine of LEAST or more: by Cauchy's inequality the terms
    that a part shares with a template hold at least LEAST squared of the template's squared weight, and of the part's.
    """

    def __init__(self, frequencies: dict[str, int], n: int):
        idf = lambda t: 1.0 + math.log((n + 1) / (frequencies.get(name_of(t), 0) + 1))
        self.unknown = 1.0 + math.log(n + 1)
        self.idf: dict = {t: idf(t) for t in (*_WORDS, *_PAIRS)}
        self.index: dict = {}
        self.most: dict = {}
        for i, (_, note) in enumerate(NOTICES):
            counts = Counter(known(note))
            norm = math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in counts.items()))
            for t, c in counts.items():
                w = c * self.idf[t] / norm
                self.index.setdefault(t, []).append((i, w))
                self.most[t] = max(self.most.get(t, 0.0), w * w)

    def hopeless(self, terms: Iterable) -> bool:
        """Whether no text made of these terms and others can come near a template, nor can a part of it."""
        return sum(map(self.most.__getitem__, terms)) < LEAST * LEAST - 1e-9

    def best(self, words: list[str]) -> tuple[float, int | None]:
        """The greatest cosine and the number of its template, the first of equals; (0, None) if it is below LEAST."""
        terms = known(words)
        counts = Counter(terms)
        if self.hopeless(counts):
            return 0.0, None
        shared = sum((c * self.idf[t]) ** 2 for t, c in counts.items())
        others = 2 * len(words) - 1 - len(terms)  # at least this many unknown terms, each of them counted once or more
        if shared < LEAST * LEAST * (shared + others * self.unknown**2) - 1e-9:
            return 0.0, None
        foreign = Counter(w for w in words if w not in _WORDS), Counter(p for p in zip(words, words[1:], strict=False) if p not in _PAIRS)
        norm = math.sqrt(shared + sum(c * c for f in foreign for c in f.values()) * self.unknown**2)
        scores: Counter = Counter()
        for t, c in counts.items():
            w = c * self.idf[t] / norm
            for i, other in self.index[t]:
                scores[i] += w * other
        i, top = max(scores.items(), key=lambda x: (round(x[1], 12), -x[0]))
        return (top, i) if top >= LEAST else (0.0, None)

    def text(self, text: str) -> tuple[str | None, float, bool]:
        """The licence of the best line, sentence, block of lines or whole text, its cosine, and whether the text is a licence
        file: little else than a template or than matched lines and blocks, of LEAST_WORDS words or more, or one that begins with a licence file's
        head. Blocks are joined without comment marks; a line without words ends them."""
        if self.hopeless({*known(words_of(text))}):
            return None, 0.0, False
        best, at = 0.0, None

        def score(words: list[str]) -> tuple[float, int | None]:
            nonlocal best, at
            found = self.best(words)
            if found[0] > best:
                best, at = found
            return found

        blocks: list[list[tuple[list[str], int, bool]]] = [[]]
        total = 0
        for line in text.split("\n"):
            total += len(line.split())
            bare = _MARKS.sub("", line)
            if not bare:
                blocks.append([])
                continue
            words = words_of(bare)
            hit = False
            if not self.hopeless({*known(words)}):
                hit = score(words)[0] >= LEAST
                # a notice may stand within a longer line: its sentences are tried too
                sentences = _SENTENCES.split(bare)
                if len(sentences) > 1:
                    for sentence in sentences:
                        score(words_of(sentence))
            blocks[-1].append((words, len(line.split()), hit))
        matched, head, opened = 0, False, False
        for block in filter(None, blocks):
            whole = score([w for words, _, _ in block for w in words]) if len(block) > 1 else (0.0, None)
            matched += sum(n for _, n, hit in block if hit or whole[1] is not None)
            head = head or (not opened and whole[1] is not None and whole[1] >= _FIRST_HEAD)
            opened = True
        # heads are often set in blocks of their own: the first words of the text are tried as well
        first = [w for block in blocks for words, _, _ in block for w in words]
        for i in range(_FIRST_HEAD, len(NOTICES)):
            found = score(first[: len(NOTICES[i][1])])
            head = head or (found[1] is not None and found[1] >= _FIRST_HEAD)
        file = score(first)[0]
        name = None if at is None else NOTICES[at][0]
        return name, best, name is not None and (head or (file >= LEAST_FILE and total >= LEAST_WORDS) or (matched >= LEAST_WORDS and total - matched <= OTHER_WORDS * total))


def own_licenses(docs: DataFrame) -> DataFrame:
    """From id, path, text: id, path, license, cosine, is_text (the text is little else than a licence)."""
    frequencies, n = document_frequencies(docs)

    def make():
        matcher = Matcher(frequencies, n)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [matcher.text(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([round(g[1], 9) for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["id", "path", "license", "cosine", "is_text"])

        return step

    given = docs.select(F.col("id").cast("long").alias("id"), F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(given, make, "id long, path string, license string, cosine double, is_text boolean")


def with_inheritance(docs: DataFrame) -> DataFrame:
    """id, path, license, cosine, inherited (from), final: own licence, else that of the nearest ancestor directory with a licence file.

    A null or empty text has no licence of its own but inherits; a null path inherits nothing. Whole texts are read, however
    long. Of templates with equal cosines the first counts; where one directory has licence files of several licences, the most
    frequent counts, then the first by name. Repeated rows and null ids keep their rows; an empty table gives an empty table.
    Other columns are ignored.
    """
    own = materialize(own_licenses(docs), "licenses").withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES) | F.col("is_text")
    by_name = own.where(named & F.col("license").isNotNull() & F.col("dir").isNotNull()).groupBy("dir", "license").count()
    given = by_name.groupBy("dir").agg(F.min(F.struct(-F.col("count"), F.col("license"))).getField("license").alias("given"))
    dirs = own.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))).alias("a"))
    nearest = above.select("dir", "a.depth", "a.above").join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("n"))
    nearest = materialize(nearest, "nearest")
    found = own.join(if_small(nearest, nearest.count()), "dir", "left")
    inherits = F.col("license").isNull() & F.col("n").isNotNull()
    return found.select("id", "path", "license", "cosine", F.when(inherits, F.col("n.above")).alias("inherited"), F.coalesce("license", F.col("n.given")).alias("final"))
