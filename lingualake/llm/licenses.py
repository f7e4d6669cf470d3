"""License notices in texts: MinHash bands over overlapping word windows, then exact shingle containment.

For a template of n shingles, windows of 1.5 n shingles start every 0.5 n, so a notice lies whole in one of
them, and a window that holds three quarters of the template has a Jaccard similarity over 0.42 with it. A
band is one register; with BANDS of them such a window misses the template with a probability under 3e-6.
A window's register can only equal a template's where the template's smallest shingle occurs, so
registers are computed at these places alone. Retrieved windows are verified on the shingles themselves.

The templates are few and go to each task with the code; rows never leave their task.

Cases: a null or empty text matches nothing. Texts of under five words have one shingle, all their words,
and match a template that is just that. Each row is scanned whole, by itself; repeated rows match alike;
a row without an id is reported with a null id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .shingles import mixed, runs, word_numbers

BANDS = 32
#: A window matches with PART[0] / PART[1] of the template's shingles.
PART = (3, 4)

# The opening notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-Clause notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_FACTORS = mixed(np.arange(101, 101 + BANDS, dtype=np.uint64)) | np.uint64(1)
_FOUND = pa.schema([("license", pa.string()), ("containment", pa.float64()), ("windows", pa.int64()), ("first_word", pa.int64())])


def shingles(text: bytes) -> np.ndarray:
    """A number for each five words of letters and digits, A-Z in lower case, in order."""
    return runs(word_numbers(text.lower().translate(_TO_SPACE).split()))


class Templates:
    """Templates with their registers, by the shingles that attain these."""

    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        self.sets = [np.unique(shingles(t.encode())) for t in texts.values()]
        self.at: dict[int, list[tuple[int, int]]] = {}
        for t, own in enumerate(self.sets):
            for f, factor in enumerate(_FACTORS):
                self.at.setdefault(int(own[(own * factor).argmin()]), []).append((t, f))
        self.minima = np.array(sorted(self.at), np.uint64)

    def window(self, t: int) -> tuple[int, int]:
        """Size and step of template `t`'s windows, in shingles."""
        n = len(self.sets[t])
        return -(-3 * n // 2), -(-n // 2)

    def matches(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(license, containment, windows, first word of the best window) of each template found in a text."""
        own = shingles(text)
        places = np.flatnonzero(np.isin(own, self.minima))
        windows: dict[int, set[int]] = {}
        for p in places.tolist():
            for t, f in self.at[int(own[p])]:
                size, step = self.window(t)
                for k in range(max(0, (p - size) // step + 1), p // step + 1):
                    if k not in windows.get(t, ()):
                        part = own[k * step : k * step + size] * _FACTORS[f]
                        if part.min() == (own[p : p + 1] * _FACTORS[f])[0]:
                            windows.setdefault(t, set()).add(k)
        out = []
        for t, candidates in sorted(windows.items()):
            size, step = self.window(t)
            inside = {k: len(np.intersect1d(own[k * step : k * step + size], self.sets[t])) for k in candidates}
            good = {k: n for k, n in inside.items() if PART[1] * n >= PART[0] * len(self.sets[t])}
            if good:
                best = min(good, key=lambda k: (-good[k], k))
                out.append((self.names[t], good[best] / len(self.sets[t]), len(good), best * step))
        return out


def _scan(texts: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                own = templates.matches(text)
                rows += [row] * len(own)
                found += own
            columns = list(zip(*found, strict=True)) or [()] * len(_FOUND)
            ids = batch.column("_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True))], ["id", *_FOUND.names])

    return run


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Rows (id, license, containment, windows, first_word) of each template found in a text."""
    kind = f"id {df.schema[id_col].dataType.simpleString()}, license string, containment double, windows bigint, first_word bigint"
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES), kind)


def sql() -> str:
    """The same matches by brute force over all windows, for DuckDB's `documents`."""
    values = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
    words = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"""
    cut = "list_transform(range(greatest(0, least(len(w), greatest(1, len(w) - 4)))), lambda i: array_to_string(w[i + 1 : i + 5], ' '))"
    return f"""
        WITH t AS (SELECT license, {words} AS w FROM (VALUES {values}) v(license, text)),
             ts AS (SELECT DISTINCT license, unnest({cut}) AS s FROM t),
             n AS (SELECT license, count(*) AS n FROM ts GROUP BY 1),
             d AS (SELECT doc_id, {words} AS w FROM documents),
             ds AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS p FROM (SELECT doc_id, {cut} AS l FROM d)),
             h AS (SELECT doc_id, license, s, p, n, CAST(ceil(n / 2) AS BIGINT) AS step, CAST(ceil(1.5 * n) AS BIGINT) AS size
                   FROM ds JOIN ts USING (s) JOIN n USING (license)),
             k AS (SELECT doc_id, license, n, step, s, unnest(range(CAST(greatest(0, floor((p - size) / step) + 1) AS BIGINT), p // step + 1)) AS k FROM h),
             g AS (SELECT doc_id, license, n, k, step, count(DISTINCT s) AS found FROM k GROUP BY ALL HAVING {PART[1]} * count(DISTINCT s) >= {PART[0]} * n)
        SELECT doc_id, license, max(found) / n AS containment, count(*) AS windows, arg_min(k * step, struct_pack(a := -found, k := k)) AS first_word
        FROM g GROUP BY doc_id, license, n
    """
