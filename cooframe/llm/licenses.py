"""Licence scans by conditional compression of candidate blocks with licence templates."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOTICE = "you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause-licensed": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-licensed": "Licensed under the BSD 3-Clause License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "GPL-2.0-text": _NOTICE.format("General Public", "2"),
    "GPL-3.0-text": _NOTICE.format("General Public", "3"),
    "LGPL-2.1-text": _NOTICE.format("Lesser General Public", "2.1"),
    "LGPL-3.0-text": _NOTICE.format("Lesser General Public", "3"),
    "AGPL-3.0-text": _NOTICE.format("Affero General Public", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "ISC": "Released under the ISC License.",
    "ISC-licensed": "Licensed under the ISC License.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}
#: A line that names a licence by its identifier.
_SPDX = "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause MPL-2.0 EPL-2.0 BSL-1.0 ISC Unlicense Zlib CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0"
TEMPLATES |= {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in _SPDX.split()}
#: What the names of templates add to those of licences.
_FORM = re.compile("-(?:licensed|text|spdx)$")
#: Comment marks that are letters; other marks are no words anyway.
_MARK = r"(?:REM|rem|dnl|C|c)"
_GAP = rf"\W+(?:{_MARK}\W+)?"
#: A text without any of these words is not scanned. These may stand on two lines of a comment; any word broken by a hyphen may be one.
CUE = rf"(?i)licen[cs]e|copyright|rights{_GAP}reserved|creative{_GAP}commons|\bCC\W*(?:BY|0)|public{_GAP}domain|\bGPL|permission{_GAP}(?:is{_GAP}(?:hereby|granted)|to{_GAP}use)|redistribution{_GAP}and{_GAP}use|spdx|[a-z]-\r?\n"
#: Blocks end at blank lines; a line of comment marks alone is blank.
_END = re.compile(rf"\n(?:[^\w\n]*(?:{_MARK}[^\w\n]*)?\n)+")
#: A word may go on after a hyphen at a line end.
_BREAK = re.compile(rf"-\r?\n[^\w\n]*(?:{_MARK}[^\w\n]+)?")
_WORD = re.compile(rf"[^\W_]+(?:(?:\.|{_BREAK.pattern}|-)[^\W_]+)*")
_TOKEN = re.compile(rf"(?m:^)[^\w\n]*{_MARK}(?=[ \t])|(?P<word>{_WORD.pattern})")
#: A word on one line.
_PART = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Least share of the compressed size of the stretch that aligns with it that a template must save, and most words by which the two may differ.
SAVED, WRONG = 0.3, 2
#: Least part of what a template saves on its own text that it must save on the stretch.
PART = 1 / 3


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _marks(text: list[str]) -> set[str]:
    """Words that tell one licence from another and may not differ: versions, clauses, names."""
    loose = set("this work is was are licensed under the a an released license licence version v of to and by in terms subject".split())
    return {w for w in text if w not in loose}


class Scanner:
    """Compresses every block with each template as raw dictionary, ranks templates by the bytes that they save, and confirms by words."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, level: int = 3) -> None:
        self.plain = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        self.names = list(templates)
        self.words = {k: words(t) for k, t in templates.items()}
        self.marks = {k: _marks(own) for k, own in self.words.items()}
        self.vocabulary = {w for own in self.words.values() for w in own}
        #: A word longer than all of the templates is cut to one character more.
        self.longest = max(map(len, self.vocabulary), default=0) + 1
        # blocks are compressed with literals left as they are, so that what a match saves does not hang on the text around it
        lean = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, window_log=17, hash_log=14, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(compression_params=lean)
        self.with_, self.beside, self.full = {}, {}, {}
        for k, own in self.words.items():
            raw = zstandard.ZstdCompressionDict(" ".join(own).encode() + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.with_[k] = zstandard.ZstdCompressor(level=level, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)
            raw = zstandard.ZstdCompressionDict(" ".join(own).encode() + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=lean)
            self.beside[k] = zstandard.ZstdCompressor(compression_params=lean, dict_data=raw)
            self.full[k] = self._saved(own, k)[0]
        #: Templates by half a block's words, within which each lies with room for WRONG words on either side.
        self.halves: dict[int, list[str]] = {}
        for k, own in self.words.items():
            self.halves.setdefault((1 << max(2, (len(own) - 1).bit_length())) + 2 * WRONG, []).append(k)
        #: For each template the places in it of a word that every confirmed stretch has, the one in fewest templates.
        self.anchors: dict[str, list[tuple[str, int]]] = {}
        spread = Counter(w for own in self.words.values() for w in set(own))
        for k, own in self.words.items():
            mark = min(self.marks[k], key=lambda w: (spread[w], own.count(w), -len(w), w), default=None)
            # without telling words: one of any WRONG + 1 places must be there
            self.anchors[k] = [(w, j) for j, w in enumerate(own) if w == mark] if mark else [(w, j) for j, w in enumerate(own[: WRONG + 1])]
        self.known: dict[tuple[str, int, str], tuple[int, int, float, int, int] | None] = {}

    def ranked(self, own: list[str], names: list[str]) -> list[str]:
        """Those of ``names`` that save bytes of a block's compressed size, most first."""
        raw = " ".join([w[: self.longest] for w in own]).encode()
        alone = len(self.alone.compress(raw))
        found = [(alone - len(self.beside[k].compress(raw)), k) for k in names]
        return [k for _, k in sorted([x for x in found if x[0] > 0], key=lambda x: -x[0])]

    def _saved(self, own: list[str], k: str) -> tuple[int, float]:
        """What a template saves of the compressed size of a stretch: bytes and share."""
        raw = " ".join(own).encode()
        alone = len(self.plain.compress(raw))
        gain = alone - len(self.with_[k].compress(raw))
        return gain, gain / alone

    def block(self, own: list[str]) -> list[tuple[int, int, str, float, int]]:
        """(first, end, licence, share saved, words that differ) of every confirmed stretch of a paragraph, in words.

        Where templates of one licence claim the same words, the one that saves most bytes has them.
        """
        places: dict[str, list[int]] = {}
        for p, w in enumerate(own):
            if w in self.vocabulary:
                places.setdefault(w, []).append(p)
        claims: dict[tuple[int, int, str], tuple[int, float, int]] = {}
        for half, names in self.halves.items():
            for at in range(0, max(1, len(own) - half), half):
                for k in self.ranked(own[at : at + 2 * half], names):
                    for w, j in self.anchors[k]:
                        ps = places.get(w, [])
                        for p in ps[bisect_left(ps, at) : bisect_left(ps, at + 2 * half)]:
                            # with at most WRONG words more or less on either side, the stretch lies between these
                            a = max(0, p - j - WRONG)
                            if found := self._fits(own[a : p - j + len(self.words[k]) + WRONG], p - j - a, k):
                                claims[a + found[0], a + found[1], k] = found[4], found[2], found[3]
        out: list[tuple[int, int, str, float, int]] = []
        taken: dict[str, list[tuple[int, int]]] = {}
        for (a, b, k), (_, saved, wrong) in sorted(claims.items(), key=lambda x: (-x[1][0], x[1][2], x[0][0], x[0][1], self.names.index(x[0][2]))):
            spans = taken.setdefault(_FORM.sub("", k), [])
            i = bisect_left(spans, (a, b))
            if (i == 0 or spans[i - 1][1] <= a) and (i == len(spans) or spans[i][0] >= b):
                spans.insert(i, (a, b))
                out.append((a, b, k, saved, wrong))
        return sorted(out, key=lambda x: (x[0], x[1], self.names.index(x[2])))

    def _fits(self, near: list[str], place: int, k: str) -> tuple[int, int, float, int, int] | None:
        if not self.marks[k].issubset(near):
            return None
        key = (k, place, " ".join(near))
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self._fit(near, k)
        return self.known[key]

    def _fit(self, near: list[str], k: str) -> tuple[int, int, float, int, int] | None:
        """(first, end, share saved, words that differ, bytes saved) of the stretch of ``near`` that departs least from a template, None if that is not confirmed."""
        template = self.words[k]
        if sum((Counter(near) & Counter(template)).values()) < len(template) - WRONG:
            return None
        best = None
        # words beside the stretch may align by chance; so ends of ``near`` are left out in turn
        for a in range(2 * WRONG + 1):
            for b in range(len(near), len(near) - 2 * WRONG - 1, -1):
                first, end, wrong, missing = self.aligned(near[a:b], template)
                if wrong <= WRONG and not missing and (best is None or wrong < best[2]):
                    best = (a + first, a + end, wrong)
                    if not wrong:
                        break
            if best and not best[2]:
                break
        if best is None:
            return None
        gain, saved = self._saved(near[best[0] : best[1]], k)
        return (best[0], best[1], saved, best[2], gain) if saved >= SAVED and gain >= PART * self.full[k] else None

    @staticmethod
    def aligned(own: list[str], template: list[str]) -> tuple[int, int, int, set[str]]:
        """The closest stretch of ``own``, words by which it departs from a template, and telling words that it lacks or adds."""
        pairs = [m for m in difflib.SequenceMatcher(None, own, template, autojunk=False).get_matching_blocks() if m.size]
        if not pairs:
            return 0, 0, len(template), _marks(template)
        first, end = pairs[0].a, pairs[-1].a + pairs[-1].size
        same = sum(m.size for m in pairs)
        return first, end, max(end - first, len(template)) - same, _marks(own[first:end]) ^ _marks(template)

    def scan(self, text: str) -> list[tuple[int, int, str, float, int]]:
        """(first, end, licence, saved, differing words) of every confirmed stretch of a whole text, in code points."""
        out = []
        at = 0
        for stop, following in [(m.start(), m.end()) for m in _END.finditer(text)] + [(len(text), len(text))]:
            found = self._tokens(text, at, stop)
            for a, b, *what in self.block([w for w, _, _ in found]):
                out.append((found[a][1], found[b - 1][2], *what))
            at = following
        return out

    def _tokens(self, text: str, at: int, stop: int) -> list[tuple[str, int, int]]:
        """Words in small letters with first and end; a word broken at a line end is whole where templates have it, with its hyphen or without."""
        out = []
        for m in _TOKEN.finditer(text, at, stop):
            if (w := m["word"]) is None:
                continue
            w, first = w.lower(), m.start()
            if "\n" in w:
                for whole in (_BREAK.sub("-", w), _BREAK.sub("", w)):
                    if whole in self.vocabulary:
                        out.append((whole, first, m.end()))
                        break
                else:
                    out += [(x[0].lower(), first + x.start(), first + x.end()) for x in _PART.finditer(m["word"])]
            else:
                out.append((w, first, m.end()))
        return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, licenses array<string>, spans array<struct<first, end, license, saved, differs>>`` for every row of ``docs`` (doc_id, text).

    Paragraphs end at blank lines; their lines are joined and comment marks
    dropped. Blocks are all stretches of a paragraph of about twice a template's
    words, each half over the next; every block is compressed alone and with
    each template of that length as dictionary. Templates that save bytes are
    confirmed by words, without a bound on their number. Texts without a cue word, which the first expression finds in the JVM, and
    null or empty ones have empty arrays and never reach Python's scanner.
    ``licenses`` is sorted and distinct; ``spans`` are the stretches that align
    with a template, in text order, in code points of the whole text; a block
    has as many as are confirmed, but of templates of one licence only the one
    that saves most has the same words. Rows with equal doc_id are scanned each on its
    own; other columns are ignored; nothing is shuffled.
    """
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [scanner.scan(t) if t else [] for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("first", "end", "license", "saved", "differs"), s)) for s in f] for f in found]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("differs", pa.int64())]))
            names = [sorted({_FORM.sub("", s[2]) for s in f}) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(spans, kind)], ["doc_id", "licenses", "spans"])

    text = F.col("text").cast("string")
    cued = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(CUE), text).alias("text"))
    return cued.mapInArrow(run, "doc_id long, licenses array<string>, spans array<struct<first: long, end: long, license: string, saved: double, differs: long>>")
