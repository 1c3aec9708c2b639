"""Licence scan: passages compared to licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import table, with_id
from tallyforge.llm.shingles import batch_words, mix, slices

#: Fixed: notices by which texts state their licence, and two short licences' whole texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
MIN_DICE = 0.8

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[65:91] += 32
_LETTERS[[b for b in range(128) if not chr(b).isalnum() and b != 10]] = 32
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[10, 32]] = True

RESULT = "license string, line int, first_word int, n_bigrams int, dice double, passage string"


def _bigrams(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def template_bigrams(templates: dict[str, str]) -> dict[str, Counter]:
    """Each template's bigrams with their counts; templates under two words can't be compared and are left out."""
    found = {name: Counter(_bigrams(batch_words(pa.array([text.replace("\n", " ")]), _LETTERS, _GAPS)[0]).tolist()) for name, text in templates.items()}
    return {name: c for name, c in found.items() if c}


def _spans(at: np.ndarray, unit: np.ndarray, size: int, min_dice: float) -> list[tuple[int, int]]:
    """Where a template of ``size`` bigrams, some of which stand at the places ``at`` of the units ``unit``, can reach
    the threshold: windows of every length that begin and end with such a bigram, which the best ones do.

    A window reaches the threshold only if its length and the template's are within a factor (2 - t) / t, and if it
    holds enough of the template's bigrams.
    """
    longest = math.floor(size * (2 - min_dice) / min_dice + 1e-9)
    found = set()
    for k in range(min(longest, len(at))):  # windows that hold k + 1 of the template's bigrams
        length = at[k:] - at[: len(at) - k] + 1
        fit = (length <= longest) & (2 * (k + 1) >= min_dice * (length + size) - 1e-9) & (unit[k:] == unit[: len(at) - k])
        if fit.any():
            begin = at[: len(at) - k][fit]
            found |= set(zip(begin.tolist(), (begin + length[fit]).tolist()))
    return sorted(found)


def _scan_texts(ids: pa.Array, texts: pa.Array, templates: dict[str, Counter], min_dice: float, across_lines: bool) -> list[tuple]:
    words, doc, starts, ends, data = batch_words(texts, _LETTERS, _GAPS)
    if len(words) < 2:
        return []
    line = np.cumsum(data == 10)[starts]
    grams = _bigrams(words)
    same_doc = doc[1:] == doc[:-1]
    same_line = same_doc & (line[1:] == line[:-1])

    joined = same_doc if across_lines else same_line
    units = np.concatenate(([0], np.cumsum(~joined)))  # of each word: the text, or the line, that passages stay in
    wanted = np.array(sorted({g for c in templates.values() for g in c}), dtype=np.uint64)
    places = np.flatnonzero(joined & np.isin(grams, wanted))
    known = grams[places]
    rows = []
    for name, want in templates.items():
        size = want.total()
        at = places[np.isin(known, np.array(list(want), dtype=np.uint64))]
        scored = []
        for begin, end in _spans(at, units[at], size, min_dice):
            dice = 2 * (Counter(grams[begin:end].tolist()) & want).total() / (end - begin + size)
            if dice >= min_dice:
                scored.append((-dice, begin, end))
        taken = np.zeros(len(words) if scored else 0, dtype=bool)
        for loss, begin, end in sorted(scored):
            if taken[begin : end + 1].any():
                continue
            taken[begin : end + 1] = True
            d = int(doc[begin])
            base = int(np.searchsorted(doc, d))
            passage = data[starts[begin] : ends[end]].tobytes().decode(errors="replace")
            rows.append((ids[d].as_py(), name, int(line[begin] - line[base]), begin - base, end - begin, -loss, passage))
    return rows


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_dice: float = MIN_DICE, across_lines: bool = False) -> DataFrame:
    """One row for each passage near a licence template: ``id, license, line, first_word, n_bigrams, dice, passage``.

    Texts are normalised: A-Z lower-cased, other ASCII characters than letters and digits are gaps.  A passage
    is a window, of any length, of a line; its Dice coefficient over bigrams, counted with repeats, is at least
    ``min_dice``.  With ``across_lines`` newlines are gaps too: passages are windows of the whole text.  Of a
    template's passages that share words the best is given, of equal ones the earliest; those that share none are
    all given.  ``line`` counts non-empty lines' newlines from the
    text's first word, ``first_word`` counts words.
    Null, empty and one-word texts give no row, nor does an empty table; repeated rows give theirs again; ids keep
    their type; other columns are not read.
    """
    wanted = template_bigrams(TEMPLATES if templates is None else templates)

    def scan_batches(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = [r for a, b in slices(texts) for r in _scan_texts(ids.slice(a, b - a), texts.slice(a, b - a), wanted, min_dice, across_lines)] if wanted else []
            if rows:
                kinds = (ids.type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())
                names = ("id", "license", "line", "first_word", "n_bigrams", "dice", "passage")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan_batches, with_id(docs, id_col, RESULT))


def op10_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), across_lines=True).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
