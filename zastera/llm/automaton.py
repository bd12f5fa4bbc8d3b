"""Licence scan by a generalised suffix automaton of licence tokens.

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. The automaton holds the token
sequences of all templates and base phrases. A text is streamed through it once; at every word the length of the
longest suffix that occurs in some template is known (matching statistics), and by the suffix links that of the
longest one in each template. Matches of at least LEAST words that can't be made longer within their template are
chained, per template, in the order of both text and template with gaps of at most GAP words; a chain that covers at
least COVER of a template is a span of that licence. Chains are closed once they lie more than GAP words behind, so
the work grows with the text. Base phrases are found at every place from the states' suffix links.

Null and empty texts have no words and no labels. Rows are independent of each other; repeated rows give
repeated results; no rows give no rows. Only doc_id and text are read, whatever other columns are called; texts are
read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .common import prepare

LEAST, GAP, COVER = 3, 8, 0.8

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence texts and notices, by label.
_MIT = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_ISC = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_BSD = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_FSF = "as published by the free software foundation either version"
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", _MIT),
    ("mit", f"{_MIT} {_AS_IS}"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_ISC}"),
    ("0bsd", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted {_ISC}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-or-later", f"under the terms of the gnu general public license {_FSF} 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", f"under the terms of the gnu general public license {_FSF} 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0-or-later", f"under the terms of the gnu affero general public license {_FSF} 3 of the license or at your option any later version"),
    ("gnu", "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]


class Automaton:
    """Suffix automaton of several token sequences.

    ends[v]: (sequence, end) of every occurrence of v's strings; whole[v]: the sequences that are suffixes of v's longest string.
    """

    def __init__(self, sequences: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        own: list[list[tuple[int, int]]] = [[]]
        final: dict[int, list[int]] = {}
        for k, seq in enumerate(sequences):
            last = 0
            for at, token in enumerate(seq):
                last = self._extend(last, token)
                while len(own) < len(self.length):
                    own.append([])
                own[last].append((k, at + 1))
            final.setdefault(last, []).append(k)
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                own[self.link[v]] += own[v]
        self.ends = [sorted(set(x)) for x in own]
        self.whole: list[list[int]] = [[] for _ in own]
        for v in sorted(range(1, len(own)), key=lambda v: self.length[v]):
            self.whole[v] = self.whole[self.link[v]] + final.get(v, [])

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, token: int) -> int:
        """The state for p's string and token, with no longer string in it."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # another sequence has been here
            return self._split(last, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = self._split(p, token) if p >= 0 else 0
        return new

    def statistics(self, tokens: list[int]):
        """(state, length of the longest suffix of tokens[:i + 1] that occurs in a sequence) for each i."""
        v = size = 0
        for token in tokens:
            while v and token not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if token in self.next[v]:
                v = self.next[v][token]
                size += 1
            yield v, size


class Scanner:
    """Spans and base places of token arrays."""

    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str]):
        vocabulary: dict[str, int] = {}
        self.sequences = [[vocabulary.setdefault(w, len(vocabulary)) for w in t.split()] for t in [*base, *(t for _, t in templates)]]
        self.labels = [*base.values(), *(x for x, _ in templates)]
        self.n_base = len(base)
        self.automaton = Automaton(self.sequences)
        column = pa.array([*vocabulary])
        parts = [K.words(data, off, K.LETTERS_LOWER) for _, _, data, off in K.chunks(column)]
        self.index = K.HashIndex(np.concatenate([w.hash for w in parts]))
        self.phrases = [[(k, len(self.sequences[k])) for k in whole if k < self.n_base] for whole in self.automaton.whole]
        self.own = [self._ends(v) for v in range(len(self.automaton.ends))]
        self.above: list[dict[int, tuple[int, list[int]]] | None] = [None] * len(self.own)

    def _ends(self, v: int) -> dict[int, list[int]]:
        """Templates in which v's strings occur, and where those end."""
        out: dict[int, list[int]] = {}
        for k, end in self.automaton.ends[v]:
            if k >= self.n_base:
                out.setdefault(k, []).append(end)
        return out

    def _shorter(self, v: int) -> dict[int, tuple[int, list[int]]]:
        """Templates that only hold shorter suffixes of v's strings: the longest one's length, and where it ends."""
        if (found := self.above[v]) is None:
            found, seen, u = {}, set(self.own[v]), self.automaton.link[v]
            while u > 0 and self.automaton.length[u] >= LEAST:
                found |= {k: (self.automaton.length[u], ends) for k, ends in self.own[u].items() if k not in seen and k not in found}
                u = self.automaton.link[u]
            self.above[v] = found
        return found

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Base places (phrase, start) and spans (label, start, end, share of the template) of one text; -1: unknown word."""
        places, matches = [], []
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < 2:
                continue
            before: dict[int, tuple[int, list[int]]] = {}
            for at, (v, size) in enumerate([*self.automaton.statistics(ids[a:b].tolist()), (0, 0)], a):
                here = {k: (size, ends) for k, ends in self.own[v].items()} | self._shorter(v) if size >= LEAST else {}
                for k, (n, ends) in before.items():
                    if here.get(k, (0,))[0] != n + 1:
                        matches.append((at - n, at, k, ends))
                for k, n in self.phrases[v] if v else ():
                    if n <= size:
                        places.append((k, at - n + 1))
                before = here
        return places, self._chain(matches) if matches else []

    def _chain(self, matches: list[tuple[int, int, int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """Spans of the matches (start, stop, template, ends in it), which come in the order of their ends."""
        open_: dict[int, list[list[int]]] = {}  # template: [start, end in the text, end in the template, covered]
        done: list[tuple[str, int, int, float]] = []

        def close(k: int, chains: list[list[int]]) -> None:
            whole = len(self.sequences[k])
            done.extend((self.labels[k], c[0], c[1], c[3] / whole) for c in chains if c[3] >= COVER * whole)

        for start, stop, k, ends in matches:
            held = open_.get(k, [])
            close(k, [c for c in held if c[1] + GAP < start])
            chains = [c for c in held if c[1] + GAP >= start]
            fresh = []
            for end in ends:
                first = end - (stop - start)
                twice = lambda c: max(0, c[1] - start, c[2] - first)  # noqa: B023, E731  # words that both hold count once
                best = max((c for c in chains if c[1] < stop and c[2] < end and first <= c[2] + GAP and twice(c) < stop - start), key=lambda c: c[3] - twice(c), default=None)
                fresh.append([best[0], stop, end, best[3] + stop - start - twice(best)] if best else [start, stop, end, stop - start])
            open_[k] = chains + fresh
        for k, chains in open_.items():
            close(k, chains)
        best_of: dict[tuple[str, int], tuple[str, int, int, float]] = {}
        for x in done:
            if (old := best_of.get(x[:2])) is None or (x[3], x[2]) > (old[3], old[2]):
                best_of[x[:2]] = x
        return sorted(best_of.values(), key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """docs (doc_id, text): n_words, base places, spans and labels."""
    prepare(docs.sparkSession)

    def run(batches):
        scanner = Scanner(templates, base)
        names = list(base.values())
        for batch in batches:
            rows = []
            for _, _, data, off in K.chunks(batch.column(1)):
                w = K.words(data, off, K.LETTERS_LOWER)
                ids = scanner.index.find(w.hash)
                for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True):
                    places, spans = scanner.scan(ids[a:b])
                    starts = [x for _, x in places]
                    own = {names[k] for k, _ in places}
                    rows.append((b - a, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in spans})), min(1.0, max([x[3] for x in spans], default=0.0)), [{"label": x, "start": s, "stop": e, "share": c} for x, s, e, c in spans]))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, stop: long, share: double>>")
