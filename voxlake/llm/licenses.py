"""License scans: an exact set-similarity join of templates with text blocks.

A block is any BLOCK words in a row, from every start. Template words are put in
order of their frequency in the corpus, rarest first. A block that holds at
least the needed words of a template holds one of the template's first
size - needed + 1 words (prefix filter), so only blocks around such a word are
looked at; it needs room for the needed words (length filter); and at least two
of the first size - needed + 2 words, or all, must lie near (positional filter).
What is left is slid over word by word, counting the template's words inside.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.shared import ascii_lower, columns, doc_texts, map_rows, slices

#: Words: after lower-casing A-Z everything but ASCII that is no digit and no a-z. On UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a block; a passage of up to so many words, with whatever stands between, lies in one.
BLOCK = 64
THRESHOLD = 0.9

#: Phrases that are counted at every place.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of public licenses, by label; each is looked for by itself.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(ascii_lower(text))


@dataclass
class Template:
    label: str
    words: list[bytes]  # distinct, rarest first
    needed: int
    members: frozenset = field(default_factory=frozenset)


def ordered_templates(templates: tuple, counts: dict[bytes, int], threshold: float) -> list[Template]:
    out = []
    for label, text in templates:
        distinct = sorted(set(words_of(text)), key=lambda w: (counts.get(w, 0), w))
        if distinct:
            out.append(Template(label, distinct, max(1, math.ceil(threshold * len(distinct) - 1e-9)), frozenset(distinct)))
    return out


def starts_near(places: list[int], last: int) -> list[tuple[int, int]]:
    """Runs of block starts, 0 to last, whose block holds one of the places (in order)."""
    runs: list[list[int]] = []
    for at in places:
        low, high = max(0, at - BLOCK + 1), min(at, last)
        if low > high:
            continue
        if runs and low <= runs[-1][1] + 1:
            runs[-1][1] = max(high, runs[-1][1])
        else:
            runs.append([low, high])
    return [(a, b) for a, b in runs]


def slide(words: list[bytes], members: frozenset, needed: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """Runs (first start, last start, most members in a block) of the starts low to high whose block holds needed members."""
    held = [(i, w) for i, w in enumerate(words[low : high + BLOCK], low) if w in members]
    inside: Counter = Counter()
    runs: list[list[int]] = []
    start, entered, left = low, 0, 0
    while start <= high:
        while entered < len(held) and held[entered][0] < start + BLOCK:
            inside[held[entered][1]] += 1
            entered += 1
        while left < entered and held[left][0] < start:
            word = held[left][1]
            inside[word] -= 1
            if not inside[word]:
                del inside[word]
            left += 1
        # nothing changes until a member leaves or the next one comes in
        stop = min(high, held[left][0] if left < entered else high, held[entered][0] - BLOCK if entered < len(held) else high)
        if len(inside) >= needed:
            if runs and runs[-1][1] == start - 1:
                runs[-1][1:] = [stop, max(runs[-1][2], len(inside))]
            else:
                runs.append([start, stop, len(inside)])
        start = stop + 1
    return [(a, b, n) for a, b, n in runs]


class TemplateIndex:
    """Templates by the words of their prefixes."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.by_word: dict[bytes, list[int]] = {}
        for t, template in enumerate(templates):
            for word in template.words[: len(template.words) - template.needed + 1]:
                self.by_word.setdefault(word, []).append(t)

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """label, first and last block start, largest containment of each run of blocks that meet the threshold."""
        last = max(0, len(words) - BLOCK)
        places: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            for t in self.by_word.get(word, ()):
                places.setdefault(t, []).append(at)
        found = []
        for t, hits in places.items():
            template = self.templates[t]
            if min(len(words), BLOCK) < template.needed:
                continue
            second = frozenset(template.words[: len(template.words) - template.needed + 2])
            for low, high in starts_near(hits, last):
                if template.needed > 1 and len(second.intersection(words[low : high + BLOCK])) < 2:
                    continue
                found += [(template.label, a, b, n / len(template.words)) for a, b, n in slide(words, template.members, template.needed, low, high)]
        return sorted(found)


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand in a row."""
    by_last: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in phrases.items():
        parts = words_of(phrase)
        by_last.setdefault(parts[-1], []).append((parts, label))
    out = []
    for at, word in enumerate(words):
        if word in by_last:
            for parts, label in by_last[word]:
                start = at - len(parts) + 1
                if start >= 0 and words[start : at + 1] == parts:
                    out.append((start, label))
    return out


def word_counts(docs: DataFrame, templates: tuple = TEMPLATES) -> dict[bytes, int]:
    """Frequency over all documents of the templates' words; at most one row for each of them returns."""
    wanted = {w for _, text in templates for w in words_of(text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches):
            for text in part["text"].to_pylist():
                seen.update(w for w in words_of(text) if w in wanted)
        yield columns(word=pa.array(list(seen), pa.binary()), n=pa.array(list(seen.values()), pa.int64()))

    rows = doc_texts(docs).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (start, label), blocks (label, first, last, containment).

    A row of blocks is a run of neighbouring block starts, first to last, that
    meet the threshold, with the largest containment among them.

    Null and empty texts have no words; repeated rows and rows without doc_id
    give one row each; other columns are ignored; an empty table gives no rows.
    Templates of equal words, and texts with a template many times, give every
    run of blocks.
    """
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(ordered_templates(templates, word_counts(docs, templates), threshold)))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, places, blocks = [], [], []
        for text in batch["text"].to_pylist():
            words = words_of(text)
            n.append(len(words))
            places.append([{"start": s, "label": x} for s, x in phrase_places(words)])
            blocks.append([{"label": a, "first": b, "last": c, "containment": d} for a, b, c, d in index.value.matches(words)])
        place = pa.struct([("start", pa.int64()), ("label", pa.string())])
        block = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())])
        return columns(doc_id=batch["doc_id"], n_words=pa.array(n, pa.int64()), places=pa.array(places, pa.list_(place)), blocks=pa.array(blocks, pa.list_(block)))

    schema = "doc_id long, n_words long, places array<struct<start: bigint, label: string>>, blocks array<struct<label: string, first: bigint, last: bigint, containment: double>>"
    return map_rows(doc_texts(docs), part, schema)


def license_labels(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 with a phrase, else the largest containment found, else 0. Cases as
    in scan_licenses.
    """
    found = scan_licenses(docs, templates, threshold)
    joined = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*lists) if len(lists) > 1 else lists[0])), ",")
    base, method = F.col("places.label"), F.col("blocks.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        joined(base).alias("base_labels"), joined(base, method).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )
