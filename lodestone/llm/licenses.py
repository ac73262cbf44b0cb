"""License scans (operator 9): a generalised suffix automaton of licence tokens.

Texts stream through the automaton, which gives for each word the length of the longest run ending there that some
template contains; suffix links lead to the shorter runs of the other templates. A run that can't be extended at a place
of a template is a seed of that place; the seeds of a template are chained in its order into spans by dynamic
programming, and a template is reported where a chain covers enough of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pass, texts

#: Words of a text whose A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Phrases whose every occurrence counts, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices by which public licences are applied to a work, and telling sentences of their texts.
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-short": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Full texts of short public licences, without their copyright lines.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause-text": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"{_BSD_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    ends: dict[int, list[int]] = field(default_factory=dict)  # by template: where the occurrences of the state's run end


class Automaton:
    """The suffix automaton of several token lists."""

    def __init__(self, lists: list[list[str]]):
        self.ids: dict[str, int] = {}
        self.states = [State(0, -1)]
        for t, tokens in enumerate(lists):
            last = 0
            for k, word in enumerate(tokens):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids) + 1))
                self.states[last].ends.setdefault(t, []).append(k + 1)
        for s in sorted(range(1, len(self.states)), key=lambda i: -self.states[i].length):
            up = self.states[self.states[s].link]
            for t, places in self.states[s].ends.items():
                up.ends[t] = sorted({*up.ends.get(t, []), *places})

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        if token in states[last].next:  # an earlier list has this run
            q = states[last].next[token]
            return q if states[q].length == states[last].length + 1 else self._clone(last, q, token)
        states.append(State(states[last].length + 1, 0))
        new, p = len(states) - 1, last
        while p >= 0 and token not in states[p].next:
            states[p].next[token] = new
            p = states[p].link
        if p >= 0:
            q = states[p].next[token]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, q, token)
        return new

    def _clone(self, p: int, q: int, token: int) -> int:
        states = self.states
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next)))
        copy = len(states) - 1
        states[q].link = copy
        while p >= 0 and states[p].next.get(token) == q:
            states[p].next[token] = copy
            p = states[p].link
        return copy

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """For each token the state and the length of the longest run that ends there; token 0 is in no template."""
        states, s, n, out = self.states, 0, 0, []
        for token in tokens:
            while s and token not in states[s].next:
                s = states[s].link
                n = states[s].length
            if token in states[s].next:
                s, n = states[s].next[token], n + 1
            out.append((s, n))
        return out


class Scanner:
    """Finds phrases and templates in texts. min_seed: words of a seed; max_gap: words between seeds of one chain; cover: share of a template that a chain must hold."""

    def __init__(self, min_seed: int = 2, max_gap: int = 8, cover: float = 0.75):
        self.min_seed, self.max_gap, self.cover = min_seed, max_gap, cover
        self.names = [*TEMPLATES, *PHRASES.values()]
        self.lists = [words(t) for t in [*TEMPLATES.values(), *PHRASES]]
        self.automaton = Automaton(self.lists)
        get = self.automaton.ids
        self.phrases = [([get[w] for w in words(p)], label) for p, label in PHRASES.items()]
        self.last = {p[-1] for p, _ in self.phrases}
        self.places = [self._places(s) for s in range(len(self.automaton.states))]

    def _places(self, s: int) -> list[tuple[int, int, int, int | None]]:
        """(template, end, length, next token) of each place of a template where the state's run or the longest suffix that fits ends; length 0 stands for the run's own."""
        out, done, states, own = [], set(), self.automaton.states, s
        while s > 0 and (s == own or states[s].length >= self.min_seed):
            for t, ends in states[s].ends.items():
                if t < len(TEMPLATES):
                    for end in ends:
                        if (t, end) not in done:
                            done.add((t, end))
                            follow = self.automaton.ids[self.lists[t][end]] if end < len(self.lists[t]) else None
                            out.append((t, end, 0 if s == own else states[s].length, follow))
            s = states[s].link
        return out

    def _runs(self, seen: list[str]) -> list[tuple[int, list[int]]]:
        """Stretches of at least two words that templates know: their start and token ids."""
        get, out, start, run = self.automaton.ids.get, [], 0, []
        known = self.automaton.ids.keys()
        if known.isdisjoint(seen):
            return []
        for at, token in enumerate(map(get, seen)):
            if token:
                if not run:
                    start = at
                run.append(token)
            elif run:
                if len(run) > 1:
                    out.append((start, run))
                run = []
        if len(run) > 1:
            out.append((start, run))
        return out

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Number of words; (start, label) of each place of a phrase; (template, start, end, share covered) of each span, in words."""
        seen = words(text)
        places, seeds = [], {}
        for start, run in self._runs(seen):
            found = self.automaton.statistics(run)
            for i, (state, n) in enumerate(found):
                if run[i] in self.last:
                    for tokens, label in self.phrases:
                        if n >= len(tokens) and run[i + 1 - len(tokens) : i + 1] == tokens:
                            places.append((start + i + 1 - len(tokens), label))
                if n >= self.min_seed:
                    then, at = run[i + 1] if i + 1 < len(run) else 0, start + i + 1
                    for t, end, shorter, follow in self.places[state]:
                        if follow != then:
                            size = shorter or n
                            seeds.setdefault(t, []).append((at - size, at, end - size, end))
        return len(seen), places, [s for t, own in seeds.items() for near in self._promising(t, own) for s in self._chains(t, near)]

    def _promising(self, t: int, seeds: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
        """The seeds in groups that no chain connects, without groups whose seeds together hold too little of the template for any chain.

        A chain counts a word of the template once, so what its group's seeds hold together bounds it.
        """
        size, begins, low = len(self.lists[t]), [], len(seeds) and seeds[-1][0]
        for a, _, _, _ in reversed(seeds):
            low = min(low, a)
            begins.append(low)  # the first word of this seed and all behind it
        begins.reverse()
        start, end = 0, 0
        for k in range(len(seeds) + 1):
            if k == len(seeds) or k > start and begins[k] > end + self.max_gap:
                held = bytearray(size)
                for c, d in {s[2:] for s in seeds[start:k]}:
                    held[c:d] = b"\x01" * (d - c)
                if sum(held) >= self.cover * size:
                    yield seeds[start:k]
                start, end = k, 0
            if k < len(seeds):
                end = max(end, seeds[k][1])

    def _chains(self, t: int, seeds: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The chains of seeds (text start, text end, template start, template end) that cover enough, best first, none over another.

        A chain's seeds follow each other in text and template; words that overlap the seed before count once. seeds are
        in order of text end, so those that a seed can follow lie shortly before it.
        """
        size, best, low = len(self.lists[t]), [], 0  # best: words covered, text start of the best chain that ends with the seed
        reach = max(b - a for a, b, _, _ in seeds) + self.max_gap
        for k, (a, b, c, d) in enumerate(seeds):
            while seeds[low][1] < b - reach:
                low += 1
            top = (b - a, a)
            for j in range(low, k):
                _, end, _, stop = seeds[j]
                if end < b and stop < d and a - end <= self.max_gap:
                    gain = b - a - max(0, end - a, stop - c)
                    if gain > 0 and (best[j][0] + gain, best[j][1]) > top:
                        top = (best[j][0] + gain, best[j][1])
            best.append(top)
        out, taken = [], []
        for n, start, end in sorted(((n, a, seeds[k][1]) for k, (n, a) in enumerate(best) if n >= self.cover * size), key=lambda x: (-x[0], x[2] - x[1], x[1])):
            k = bisect_left(taken, (end,))  # those that begin before the chain's end; the last of them ends last
            if not k or taken[k - 1][1] <= start:
                taken.insert(k, (start, end))
                out.append((self.names[t], start, end, n / size))
        return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of df.

    Whole texts are read; null is empty. Every place of a phrase counts, those of several phrases too. score is 1 where a
    phrase stands, else the largest share of a template that a chain covers, else 0. spans lists template:start:end in
    words. Repeated rows and null ids each get a row.
    """

    def make():
        scanner = Scanner()

        def work(batch):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in texts(batch.column(1)):
                n, places, spans = scanner.scan(text)
                base = {label for _, label in places}
                starts = [s for s, _ in places]
                row = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), 1.0 if base else max((s[3] for s in spans), default=0.0), ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in sorted(spans, key=lambda s: (s[1], s[0]))))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out | {"doc_id": batch.column(0)}

        return work

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return text_pass(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id", "text"], make, schema)
