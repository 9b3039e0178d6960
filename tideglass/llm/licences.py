"""License scans by Dice coefficient over word bigrams.

A text's words are its lower-cased runs of letters and digits.  A passage
matches a template if the Dice coefficient of their bigram multisets is at
least ``least``.  That bounds sizes: a passage as small or large as the
coefficient allows, no other, is compared, so a passage's size prunes the
candidate templates; and a match must hold one of the template's rarer
bigrams (all but as many as it may lack), so only passages around such a
bigram are read at all.  There, for every bigram of the template as a first
one, the end that fits best is sought; prefix counts give the common bigrams
of all ends at once, so the work grows with the text, not with its square.

Notices of one family differ in a word or two, which Dice cannot weigh.  So a
passage must also hold each of the template's bigrams that end in a deciding
word (a qualifier such as Lesser or NonCommercial, or a number), and neither
it nor the bigrams next to it may hold a qualifier or a negation where the
template has none.  What then matches is decided by Dice, and the best other
licence for the passage is reported with it.

The templates are fixed notices, bounded in number and size, and are sent to
every task; no other text meets another.

Defined results: null, empty and one-word texts have no match; templates with
equal scores on one passage are decided by name; overlapping matches keep the
better, then the earlier; each repeated row is scanned; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, hash_words, sliced, tidy

LEAST = 0.8

#: What the BSD licences share; each goes on to where the two part.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

# Public licence notices, and the identifiers they stand for.
TEMPLATES = {
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "AGPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "LGPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "LGPL-2.1-or-later": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "Apache-1.1": ["Licensed under the Apache Software License, Version 1.1."],
    "BSD-2-Clause": [_BSD + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"],
    "BSD-3-Clause": [
        _BSD
        + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}

# The Creative Commons attribution licences, whose notices follow one rule.
_CC_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_KINDS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
for _short, _long in _CC_TERMS.items():
    for _version, _kind in _CC_KINDS.items():
        TEMPLATES[f"CC-{_short}-{_version}"] = [f"Licensed under CC {_short} {_version}.", f"This work is licensed under a Creative Commons {_long} {_version} {_kind} License."]

#: Words that tell licences of one family apart wherever they stand; numbers do so where the template has them.
QUALIFIERS = frozenset("affero lesser library noncommercial non sharealike share noderivatives noderivs derivs nc sa nd endorse".split())
NEGATIONS = frozenset("not never neither nor except".split())
#: Common English words, for telling a template's rarer bigrams.
COMMON = frozenset("a all and any are as at be by for from in is it not of on or that the this to was with you".split())

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[bytes]:
    return [w.encode() for w in _WORD.findall(text.lower())]


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit value for every two neighbouring words."""
    return (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)


def dice(a: Counter, b: Counter) -> float:
    both = sum(a.values()) + sum(b.values())
    return 2 * (a & b).total() / both if both else 0.0


class Template:
    def __init__(self, name: str, text: str, least: float):
        words = words_of(text)
        keys = bigrams(hash_words([words])[0]).tolist()
        self.name, self.bag, self.size = name, Counter(keys), len(keys)
        # 2 common / (a + m) >= t and common <= min(a, m) bound a passage's bigrams, and the common ones
        self.low, self.high = int(np.ceil(least / (2 - least) * self.size - 1e-9)), int((2 - least) / least * self.size + 1e-9)
        lack = self.size - self.low
        rarity = sorted(range(self.size), key=lambda k: ((words[k].decode() in COMMON) + (words[k + 1].decode() in COMMON), -len(words[k]) - len(words[k + 1]), k))
        self.anchors = {keys[k] for k in rarity[: lack + 1]}
        self.keys = np.array(sorted(self.bag), np.uint64)
        self.times = np.array([self.bag[k] for k in self.keys.tolist()])
        self.deciding = {keys[k] for k in range(self.size) if (w := words[k + 1].decode()) in QUALIFIERS or w.isdigit()}


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, least: float = LEAST):
        self.least = least
        self.templates = [Template(name, text, least) for name, texts in (templates or TEMPLATES).items() for text in texts]
        self.by_anchor: dict[int, list[int]] = {}
        for k, t in enumerate(self.templates):
            for a in t.anchors:
                self.by_anchor.setdefault(a, []).append(k)
        anchors = np.array(list(self.by_anchor), np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[anchors >> np.uint64(48)] = True
        self.odd = np.sort(np.concatenate([np.zeros(0, np.uint64), *(hash_words([[w.encode()]])[0] for w in sorted(QUALIFIERS | NEGATIONS))]))

    def passages(self, keys: np.ndarray, t: Template, anchors: np.ndarray, block: int = 1 << 20) -> Iterator[tuple[float, int, int]]:
        """(Dice, first, end) of the best passage from each first bigram that allows ``least``.  anchors: where t's rarer bigrams are."""
        at = np.minimum(np.searchsorted(t.keys, keys), len(t.keys) - 1)
        near = np.zeros(len(keys) + 1, np.int64)
        np.add.at(near, np.maximum(anchors - t.high + 1, 0), 1)
        np.add.at(near, np.minimum(anchors + t.high, len(keys)), -1)
        inside = np.flatnonzero((t.keys[at] == keys) & (np.cumsum(near[:-1]) > 0))
        if len(inside) < t.low:
            return
        # a bigram counts from a first one on that comes after its own k-th last place, k being its times in the template
        limit = np.full(len(inside), -1, np.int64)
        of = at[inside]
        order = np.argsort(of, kind="stable")
        heads = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(t.keys)))[:-1]])
        rank = np.arange(len(order)) - heads[of[order]]
        some = rank >= t.times[of[order]]
        limit[order[some]] = inside[order[np.flatnonzero(some) - t.times[of[order[some]]]]]
        until = np.searchsorted(inside, inside + t.high)
        firsts = np.flatnonzero(until - np.arange(len(inside)) >= t.low)
        step = max(1, block // t.high)
        for low in range(0, len(firsts), step):
            f = firsts[low : low + step]
            k = f[:, None] + np.arange(int((until[f] - f).max()))
            ok = k < until[f][:, None]
            k = np.minimum(k, len(inside) - 1)
            common = np.cumsum(ok & (limit[k] < inside[f][:, None]), axis=1)
            value = np.where(ok, 2 * common / (inside[k] + 1 - inside[f][:, None] + t.size), 0.0)
            best = value.argmax(axis=1)
            top = value[np.arange(len(f)), best]
            for i in np.flatnonzero(top >= self.least - 1e-12).tolist():
                yield float(top[i]), int(inside[f[i]]), int(inside[k[i, best[i]]]) + 1

    def allowed(self, keys: np.ndarray, odd: np.ndarray, t: Template, first: int, end: int) -> bool:
        """Whether the passage has the template's deciding bigrams, and no qualifier or negation of its own nearby.  odd: which words are such."""
        if not t.deciding <= set(keys[first:end].tolist()):
            return False
        return all(int(keys[k]) in t.bag for k in range(max(0, first - 2), min(len(keys), end + 2)) if odd[k])

    def scan(self, texts: list[str]) -> list[list[tuple[str, float, int, int, str | None, float]]]:
        """(name, Dice, first word, end word, the next licence for the passage or None, its Dice) of the matches in each text, in order."""
        out: list[list[tuple[str, float, int, int, str | None, float]]] = [[] for _ in texts]
        hashes, sizes = hash_words(map(words_of, texts))
        if len(hashes) < 2:
            return out
        keys = bigrams(hashes)
        ends = np.cumsum(sizes)
        hits: dict[int, dict[int, list[int]]] = {}
        for at in np.flatnonzero(self.maybe[keys >> np.uint64(48)]).tolist():
            for k in self.by_anchor.get(int(keys[at]), ()):
                doc = int(np.searchsorted(ends, at, "right"))
                if at + 1 < ends[doc]:
                    hits.setdefault(doc, {}).setdefault(k, []).append(at - int(ends[doc] - sizes[doc]))
        for doc, places in hits.items():
            start = int(ends[doc] - sizes[doc])
            own, odd = keys[start : int(ends[doc]) - 1], np.isin(hashes[start : int(ends[doc])], self.odd)
            found = set()
            for k, anchors in places.items():
                t = self.templates[k]
                for value, first, end in self.passages(own, t, np.array(anchors)):
                    if self.allowed(own, odd, t, first, end):
                        found.add((-value, first, t.name, end))
            ranked = sorted(found)
            taken: list[tuple[int, int, str, float]] = []
            for value, first, name, end in ranked:
                at = bisect_left(taken, (first,))
                if (at == len(taken) or end + 1 <= taken[at][0]) and (not at or first >= taken[at - 1][1]):
                    taken.insert(at, (first, end + 1, name, -value))
            second: dict[int, tuple[str, float]] = {}
            for value, first, name, end in ranked:
                at = bisect_right(taken, (end,)) - 1
                while at >= 0 and taken[at][1] > first:
                    if taken[at][2] != name:
                        second.setdefault(at, (name, -value))
                    at -= 1
            out[doc] = [(name, value, first, end, *second.get(k, (None, 0.0))) for k, (first, end, name, value) in enumerate(taken)]
        return out


MATCHES = "matches array<struct<license: string, dice: double, first_word: int, end_word: int, runner_up: string, runner_up_dice: double>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, matches of every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    match = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("runner_up", pa.string()), ("runner_up_dice", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in sliced(batches):
            found = scanner.scan([x or "" for x in batch.column(1).to_pylist()])
            rows = [[dict(zip(match.names, m, strict=True)) for m in x] for x in found]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(match))], names=["doc_id", "matches"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, {MATCHES}")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return scan(documents(spark, sf_dir)).select("doc_id", F.size("matches").alias("n_matches"), F.concat_ws(",", names).alias("licenses"), F.coalesce(F.array_max("matches.dice"), F.lit(0.0)).alias("best_dice"))
