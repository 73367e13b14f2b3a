"""Operator 1: license scan by conditional compression.

A word with one of the ``ANCHORS`` (each template holds one) places a template in the text.
A candidate block is as many words as the template has, from its place on, and a margin of
the words that may differ on both sides, over line ends and inside lines of any length.
Each block is compressed alone and with the template as zstandard raw dictionary, both by
their wording; the templates are
ranked by the share of their own size that they save.  The winners, in that order, are laid
over the text at the anchors they have in common and confirmed by their exact wording: the
words that differ are counted and reported, and at most ``max_difference`` of the
template's words may.  A confirmed notice is reported once, with its place in the text.

Case, white space and punctuation around words do not count as wording.

Defined results: null and empty texts hold no notice; a notice at the very end or inside a
longer line is found like any other; several notices in a text are reported one by one;
equal rows each return theirs; a null id is reported as null; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shared import text_chunks

# fixed values: public license notices, as their stewards word them
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions: The above copyright notice and this permission notice shall be included in all copies "
           "or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                  "permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                        "License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
                    "binary form must reproduce the above copyright notice, this list of conditions and the following "
                    "disclaimer in the documentation and/or other materials provided with the distribution.",
}
ANCHORS = ("licens", "licenc", "permission", "redistribut", "copyright")
MIN_SHARE = 0.2
MAX_DIFFERENCE = 0.1
LEVEL = 3
EDGE = re.compile(r"^\W+|\W+$")


def wording(text: str) -> list[str]:
    """The words that count: lower case, without punctuation at their ends."""
    return [w for w in (EDGE.sub("", x) for x in text.lower().split()) if w]


class Scanner:
    """Templates with their dictionaries and the sizes they compress to."""

    def __init__(self, templates: dict[str, str], anchors=ANCHORS) -> None:
        import zstandard as z
        self.plain = z.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.anchors = anchors
        self.templates = []
        for name, text in sorted(templates.items()):
            words = wording(text)
            at: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                if any(a in w for a in anchors):
                    at.setdefault(w, []).append(i)
            if not at:
                raise ValueError(f"template {name} has no anchor")
            said = " ".join(words).encode()
            raw = z.ZstdCompressionDict(said, dict_type=z.DICT_TYPE_RAWCONTENT)
            own = len(self.plain.compress(said))
            self.templates.append((name, words, at, z.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False), own))

    def starts(self, words: list[str], i: int, k: int, max_difference: float) -> list[int]:
        """Places of template ``k`` that reach word ``i`` and have an anchor in common."""
        _, own, at, _, _ = self.templates[k]
        margin = int(max_difference * len(own))
        lo, hi = i - len(own) - margin, i + margin
        near = range(max(0, lo), min(len(words), i + len(own) + margin + 1))
        return sorted({j - o for j in near for o in at.get(words[j], ()) if lo < j - o <= hi})

    def ranked(self, words: list[str], i: int, min_share: float, max_difference: float) -> list[tuple[float, int]]:
        """(share of the template's size that it saves at its best place at word ``i``, template), best first."""
        alone: dict[tuple[int, int], tuple[bytes, int]] = {}
        shares = []
        for k, (_, own, _, compressor, size) in enumerate(self.templates):
            margin, saved = int(max_difference * len(own)), []
            for s in self.starts(words, i, k, max_difference):
                at = max(0, s - margin), s + len(own) + margin
                if at not in alone:
                    block = " ".join(w for w in words[at[0]:at[1]] if w).encode("utf-8", "replace")
                    alone[at] = block, len(self.plain.compress(block))
                block, plain = alone[at]
                saved.append(plain - len(compressor.compress(block)))
            if saved:
                shares.append((max(saved) / size, k))
        return sorted((s for s in shares if s[0] >= min_share), key=lambda s: (-s[0], s[1]))

    def differences(self, words: list[str], i: int, k: int, max_difference: float) -> tuple[int, int, int, str]:
        """(words that differ, first, end, their wording) of template ``k`` at its best place at word ``i``."""
        own = self.templates[k][1]
        best = (len(own) + 1, 0, 0, "")
        for s in self.starts(words, i, k, max_difference):
            a, b = max(0, s), min(len(words), s + len(own))
            part = words[a:b]
            m = difflib.SequenceMatcher(None, own, part, autojunk=False)
            ops = [o for o in m.get_opcodes() if o[0] != "equal"]
            n = sum(max(o[2] - o[1], o[4] - o[3]) for o in ops)
            if n < best[0]:
                said = "; ".join(f"{' '.join(own[o[1]:o[2]])} -> {' '.join(part[o[3]:o[4]])}" for o in ops)
                best = (n, a, b, said)
        return best

    def scan(self, text: bytes, min_share: float = MIN_SHARE, max_difference: float = MAX_DIFFERENCE) -> list[tuple]:
        """(license, line, words, share, words that differ, wording differences) of each notice."""
        low = text.lower()
        if not any(a.encode() in low for a in self.anchors):
            return []
        rest: list[str] = []  # the words, without those of confirmed notices
        line_of: list[int] = []
        for j, line in enumerate(text.decode("utf-8", "replace").split("\n")):
            words = wording(line)
            rest += words
            line_of += [j] * len(words)
        out = []
        for i in [i for i, w in enumerate(rest) if any(a in w for a in self.anchors)]:
            if not rest[i]:
                continue
            for share, k in self.ranked(rest, i, min_share, max_difference):
                name, own = self.templates[k][:2]
                while True:  # again on what is left: an equal notice may stand beside
                    n, a, b, said = self.differences(rest, i, k, max_difference)
                    if n > max_difference * len(own):
                        break
                    rest[a:b] = [""] * (b - a)
                    out.append((name, line_of[a], b - a, share, n, said))
                if not rest[i]:
                    break
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, min_share: float = MIN_SHARE,
                 max_difference: float = MAX_DIFFERENCE) -> DataFrame:
    """(doc_id, license, line, n_words, share_saved, n_differences, differences) per notice."""
    templates = dict(templates or TEMPLATES)
    Scanner(templates)  # a template without anchor is an error here, not in a task

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in text_chunks(batch):
                rows = [(ids[i].as_py(), *hit) for i, t in enumerate(texts, first) for hit in scanner.scan(t, min_share, max_difference)]
                cols = list(zip(*rows)) if rows else [()] * 7
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 ["doc_id", "license", "line", "n_words", "share_saved", "n_differences", "differences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id long, license string, line long, n_words long, share_saved double, n_differences long, differences string")
