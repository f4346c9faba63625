"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Windows come in tiers of 4, 16, 64, 256 and 1024 shingles, half overlapping; a template of up to half a tier's length lies
whole in some window of that tier. Shingles are five words (all words of a shorter template). A window and a template
are a candidate if they share the minimum under any of HASHES functions: bands of one row. A window of W shingles that holds t
of a template shares one with probability 1 - (1 - t / W)^48: for what counts as found (0.8 of a template over an eighth of
its tier) at least 0.993, for a whole template 0.998, and over 0.99999 for templates of one or two shingles. Windows without any shingle of any template
share no minimum with one, so only windows around known shingles are hashed: a lossless short cut.

Then the share of the template's shingles that stand in the window is counted exactly, on words. Templates are a fixed or
stated table (TEMPLATES, or the caller's; up to MAX_WORDS words in all, else ValueError); documents are scanned in place, without a
shuffle. Null and empty texts have no windows and no licenses; repeated rows each come out; long texts are scanned whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, map_arrow, plain_words

SHINGLE, HASHES, LEAST = 5, 48, 0.8
TIERS = (4, 16, 64, 256, 1024)
MAX_WORDS = 1_000_000

# Opening lines and notices of public licenses.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_MULTIPLY = np.array([zlib.crc32(b"m%d" % i) << 32 | zlib.crc32(b"n%d" % i) | 1 for i in range(HASHES)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """One number for each k neighbouring words."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _STEP
    return out ^ (out >> np.uint64(31))


def _minima(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes[None, :] * _MULTIPLY[:, None]
    return (mixed ^ (mixed >> np.uint64(32))).min(1)


class Scanner:
    """Templates by tier; made once on the driver, of fixed size."""

    def __init__(self, templates: dict[str, str]):
        if sum(len(t.split()) for t in templates.values()) > MAX_WORDS:
            raise ValueError(f"templates of more than {MAX_WORDS} words")
        self.templates = []
        for name, text in sorted(templates.items()):
            words = plain_words(text.encode())
            if words:
                k = min(SHINGLE, len(words))
                hashes = shingle_hashes(words, k)
                tier = next((w for w in TIERS if 2 * len(hashes) <= w), 2 * len(hashes))
                self.templates.append((name, k, tier, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}, _minima(np.unique(hashes))))
        self.known = {k: np.unique(np.concatenate([shingle_hashes(list(s), k) for _, kk, _, shingles, _ in self.templates if kk == k for s in shingles])) for k in {t[1] for t in self.templates}}
        self.maps = {}
        for k, known in self.known.items():
            self.maps[k] = np.zeros(1 << 20, bool)
            self.maps[k][(known >> np.uint64(20)) & np.uint64((1 << 20) - 1)] = True

    def scan(self, text: bytes) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment) of the best window of each template that is found."""
        words = plain_words(text)
        best: dict[str, tuple[float, int, int]] = {}
        for k, known in self.known.items():
            hashes = shingle_hashes(words, k)
            maybe = np.flatnonzero(self.maps[k][(hashes >> np.uint64(20)) & np.uint64((1 << 20) - 1)])
            at = maybe[np.isin(hashes[maybe], known)] if len(maybe) else maybe
            if not len(at):
                continue
            for tier in {t for _, kk, t, _, _ in self.templates if kk == k}:
                half = tier // 2
                for start in np.unique(np.concatenate([at // half, np.maximum(at // half - 1, 0)])) * half:
                    window = hashes[start : start + tier]
                    minima = _minima(window)
                    for name, kk, t, shingles, own in self.templates:
                        if kk == k and t == tier and (minima == own).any():
                            here = {tuple(words[i : i + k]) for i in range(start, start + len(window))}
                            share = len(shingles & here) / len(shingles)
                            if share >= LEAST and share > best.get(name, (0.0,))[0]:
                                inside = [i for i in range(start, start + len(window)) if tuple(words[i : i + k]) in shingles]
                                best[name] = (share, int(inside[0]), int(inside[-1] + k))
        return [(name, a, b, share) for name, (share, a, b) in sorted(best.items())]


def found(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, matches) of every row; matches: template, first word, end word and containment of each template found."""
    scanner = Scanner(templates)
    schema = "doc_id long, matches array<struct<template:string,start:int,end:int,containment:double>>"
    names = ("template", "start", "end", "containment")
    plain = docs.select(F.col("doc_id").cast("long"), binary("text").alias("text"))
    return map_arrow(plain, lambda b: {"doc_id": b.column(0), "matches": [[dict(zip(names, m, strict=True)) for m in scanner.scan(t)] for t in b.column(1).to_pylist()]}, schema)


def report(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_licenses, licenses, containment, spans) of every row: comma-joined names and word spans, the lowest containment (0 without any)."""
    m = F.col("matches")
    spans = F.array_join(F.transform(m, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found(docs, templates).select("doc_id", F.size(m).cast("long").alias("n_licenses"), F.array_join(m["template"], ",").alias("licenses"), F.coalesce(F.array_min(m["containment"]), F.lit(0.0)).alias("containment"), spans.alias("spans"))
