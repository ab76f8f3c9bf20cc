"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A template of n words counts as found where any 2n words in a row, wherever they begin, hold CONTAINED
or more of its shingles: a copy may have up to n words more than the template. For retrieval, a text is
looked at through windows of 3n words, n apart, so that any 2n words in a row lie in a window that has
the first of them among its first n. Window and template are compared by MinHash
values of their 5-word shingles. A template whose shingles a window holds to the wanted share has a
similarity of at least that share times its shingles over all of the two; as many bands of one value
are used as make a collision likely to MISS (``bands_for``). What is retrieved is verified by exact
containment over all 2n words in a row within the window. Only windows with a shingle of a template
among their first n words are hashed, as what is found begins with one.

Defined results: words are runs of letters, digits and non-ASCII, A-Z lower-cased; null, empty and blank
texts hold nothing; a template of 1 to 4 words is one shingle; each row is scanned by itself; an empty
table gives no rows; other columns pass through ``licenses``, but for those named like its results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .op3_jaccard import _factors
from .shared import boxed, with_text
from .wordhash import ALNUM_LOW, grams, pieces, utf8, words

SHINGLE, CONTAINED, MISS = 5, 0.8, 1e-6

# Public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def bands_for(shingles: int, window_shingles: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """One-value bands that let a template of so many shingles be missed with probability `miss` where a window holds the wanted share of it."""
    held = max(1, ceil(contained * shingles))
    j = held / (window_shingles + shingles - held)
    return max(1, ceil(log(miss) / log(1 - j))) if j < 1 else 1


def runs(places: list[int], shingles: list[int], reach: int, least: float) -> list[tuple[int, int]]:
    """(first, last) of the places at most `reach` apart among which there are `least` different shingles; for each last the first of all."""
    out, held, a = [], Counter(), 0
    for place, x in zip(places, shingles, strict=True):
        held[x] += 1
        while place - places[a] > reach:
            held[shingles[a]] -= 1
            if not held[shingles[a]]:
                del held[shingles[a]]
            a += 1
        if len(held) >= least:
            out.append((places[a], place))
    return out


class Templates:
    def __init__(self, texts: dict[str, str], contained: float = CONTAINED, miss: float = MISS):
        self.names, self.contained = sorted(texts), contained
        h, _, _, off = words(*utf8(pa.array([texts[n] for n in self.names], pa.string())), ALNUM_LOW)
        self.sets, self.k, self.words = [], [], np.diff(off)
        for a, b in zip(off[:-1], off[1:], strict=True):
            k = min(SHINGLE, int(b - a))
            self.k.append(k)
            self.sets.append(np.unique(grams(h[a:b], k)) if k else np.zeros(0, np.uint64))
        # one pass for each length of template and of shingle: window, step, bands, values of its templates
        self.passes = []
        for n, k in sorted({(int(n), k) for n, k in zip(self.words, self.k, strict=True) if k}):
            own = [i for i in range(len(self.names)) if self.words[i] == n and self.k[i] == k]
            bands = max(bands_for(len(self.sets[i]), 3 * n - k + 1, contained, miss) for i in own)
            a, b = _factors(bands)
            values = np.stack([[((self.sets[i] * a[j] + b[j]) >> np.uint64(32)).min() for j in range(bands)] for i in own])
            self.passes.append((n, k, a, b, own, values, np.unique(np.concatenate([self.sets[i] for i in own]))))

    def found(self, h: np.ndarray, woff: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, template, first word, end word), sorted: from the first to the last shingle of the template, over the runs of 2n words that hold enough of it, joined where they touch."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for n, k, a, b, own, values, every in self.passes:
            g = grams(h, k)
            if not len(g):
                continue
            at = np.minimum(np.searchsorted(every, g), len(every) - 1)
            hit = np.flatnonzero(every[at] == g)
            text = np.searchsorted(woff, hit, "right") - 1
            ok = hit + k <= woff[text + 1]
            hit, text = hit[ok], text[ok]
            # the windows of 3n words, n apart from the text's beginning, that have such a shingle among their first n
            starts = np.unique(woff[text] + (hit - woff[text]) // n * n)
            for s in starts.tolist():
                d = int(np.searchsorted(woff, s, "right")) - 1
                e = min(s + 3 * n, int(woff[d + 1]))
                w = g[s : max(s, e - k + 1)]
                if not len(w):
                    continue
                sig = np.array([((w * x + y) >> np.uint64(32)).min() for x, y in zip(a, b, strict=True)])
                for i in np.array(own)[(values == sig).any(axis=1)].tolist():
                    places = np.flatnonzero(np.isin(w, self.sets[i]))
                    least = self.contained * len(self.sets[i]) - 1e-9
                    if len(np.unique(w[places])) >= least:
                        for x, y in runs(places.tolist(), w[places].tolist(), 2 * n - k, least):
                            out.setdefault((d, i), []).append((s + x, s + y + k))
        rows = []
        for (d, i), spans in out.items():
            merged: list[list[int]] = []
            for s, e in sorted(spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            rows += [(d, i, s, e) for s, e in merged]
        return sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def licenses(documents: DataFrame, templates: dict[str, str] | None = None, text: str = "text", contained: float = CONTAINED, miss: float = MISS) -> DataFrame:
    """documents with n_words and found: array<struct<license, start, end>> (words) added. The templates are a stated, small set that every worker gets."""
    held = documents.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, contained, miss))
    docs = boxed(documents, ["n_words", "found"])
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL("n_words long, found array<struct<license:string,start:long,end:long>>").fields)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for batch in with_text(batches, text):
            for part in pieces(batch, "text"):
                h, _, _, woff = words(*utf8(part.column("text")), ALNUM_LOW)
                found: list = [[] for _ in range(part.num_rows)]
                for d, i, s, e in t.found(h, woff):
                    found[d].append({"license": t.names[i], "start": s - int(woff[d]), "end": e - int(woff[d])})
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(woff)), pa.array(found, kind)], names=["doc", "n_words", "found"])

    return docs.mapInArrow(scan, schema).select("doc.*", "n_words", "found")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return docs.select("doc_id", "n_words", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"), spans.alias("spans"))
