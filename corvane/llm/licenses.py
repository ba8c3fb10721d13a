"""License scans: a generalised suffix automaton of licence tokens.

The templates are passages of licences (their paragraphs and notices). The
automaton accepts every run of tokens of every template. A text is streamed
through it and gives its matching statistics (the longest template run that ends
at each word); matches of ``SEED`` words or more are chained, template by
template, where they follow or overlap one another with small gaps, and the
chain covers a span of the template. A passage counts as present when its best
chain covers ``COVER`` of it or ``LONG`` words; of chains over the same stretch of
text that with the most covered words gives the label, the first template on a
tie. Only stretches of words that all occur in some template are streamed: a
match cannot reach beyond one.

Base phrases are looked up exactly, word by word.

Defined results: a null text counts as empty (0 words, no labels, score 0);
repeated rows are returned as often as they come; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import textkit as K
from corvane.llm.store import small_batches, table

#: Phrase and its label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Paragraphs and notices of public licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache-2", "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions you must give any other recipients of the work or derivative works a copy of this license and you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2", "unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation any warranties or conditions of title non infringement merchantability or fitness for a particular purpose"),
    ("apache-2", "in no event and under no legal theory whether in tort including negligence contract or otherwise unless required by applicable law such as deliberate and grossly negligent acts or agreed to in writing shall any contributor be liable to you for damages"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "this notice may not be removed or altered from any source distribution"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("gpl", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2 or later"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("bsd", "released under the 3 clause bsd license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl-2", "licensed under the mozilla public license version 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("cc-by", "licensed under the creative commons attribution license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law"),
    ("cc0", "released under the creative commons zero public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
)
#: Shortest match that starts a chain, largest gap in words within a chain, and least share and words of a template that make it present.
SEED, GAP, COVER, LONG = 4, 6, 0.6, 12
#: Chain of one template: covered words, and the first and the end of its words in the text.
Chain = tuple[int, int, int]

#: Words are letters a-z and digits and everything beyond ASCII.
WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


class SuffixAutomaton:
    """Generalised: it accepts the substrings of all the sequences that were added."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]  # ends: (template, position of the last token)

    def add(self, template: int, tokens: list[int]) -> None:
        last = 0
        for at, token in enumerate(tokens):
            last = self._extend(last, token)
            self.ends[last].append((template, at))

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        cur = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return cur

    def _clone(self, p: int, q: int, token: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def finish(self) -> "SuffixAutomaton":
        """Give each state the ends of all states whose suffix it is."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] = list(dict.fromkeys(self.ends[self.link[s]] + self.ends[s]))
        return self

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        state = size = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            yield state, size


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return K.Words(raw, np.array([0, len(raw)]), WORD_BYTE, K.FOLDED).hashes


class Scanner:
    """Automaton, vocabulary and phrases, ready for a worker."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in templates]
        words = [_hashes(t) for _, t in templates]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
        self.sizes = [len(w) for w in words]
        automaton = SuffixAutomaton()
        for k, w in enumerate(words):
            automaton.add(k, np.searchsorted(self.vocabulary, w).tolist())
        self.automaton = automaton.finish()
        self.phrases = [(_hashes(p), label) for p, label in phrases]

    def token_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, -1 for other words."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def runs(self, ids: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of ``SEED`` words or more of the vocabulary, within one text."""
        known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        starts, ends = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        long = ends - starts >= SEED
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            cuts = firsts[(firsts > s) & (firsts < e)].tolist()
            for a, b in zip([s, *cuts], [*cuts, e]):
                if b - a >= SEED:
                    yield a, b

    def matches(self, ids: list[int], at: int) -> list[tuple[int, int, int, int]]:
        """Longest matches of ``SEED`` words or more: (template, its start, word of the text, length)."""
        out: list[tuple[int, int, int, int]] = []
        before = (0, 0)
        for k, now in enumerate([*self.automaton.statistics(ids), (0, 0)]):
            if before[1] >= SEED and now[1] <= before[1]:
                size = before[1]
                out += [(t, end - size + 1, at + k - size, size) for t, end in self.automaton.ends[before[0]]]
            before = now
        return out

    def chains(self, matches: list[tuple[int, int, int, int]]) -> dict[int, Chain]:
        """Best chain of each template: matches in the order of text and template, with gaps of ``GAP`` words at most on both sides; what overlaps counts once."""
        best: dict[int, Chain] = {}
        by: dict[int, list] = {}
        for t, p, q, size in matches:
            by.setdefault(t, []).append((q, p, size))
        for t, own in by.items():
            open_: list[tuple[int, int, int, int, int, int]] = []  # text and template start, text and template end, covered, first word
            for q, p, size in sorted(set(own)):
                gain, first = size, q
                for qs, ps, qe, pe, covered, begin in open_:
                    shared = max(0, qe - q, pe - p)
                    if qs < q and ps < p and shared < size and q - qe <= GAP and p - pe <= GAP and covered + size - shared > gain:
                        gain, first = covered + size - shared, begin
                open_ = [x for x in open_ if q - x[2] <= GAP] + [(q, p, q + size, p + size, gain, first)]
                if gain > best.get(t, (0,))[0]:
                    best[t] = gain, first, q + size
        return best

    def present(self, chains: dict[int, Chain]) -> tuple[set[str], float]:
        """Labels of the passages that are there, and the largest covered share of a passage."""
        share = {t: min(1.0, c[0] / self.sizes[t]) for t, c in chains.items()}
        there = sorted((t for t, c in chains.items() if share[t] >= COVER or c[0] >= LONG), key=lambda t: (-chains[t][0], t))
        kept: list[Chain] = []
        labels: set[str] = set()
        for t in there:
            _, a, b = chains[t]
            if any(2 * (min(b, d) - max(a, c)) > b - a for _, c, d in kept):
                continue  # a better chain holds most of this stretch
            kept.append(chains[t])
            labels.add(self.labels[t])
        return labels, max(share.values(), default=0.0)


@functools.lru_cache(1)
def _default() -> Scanner:
    return Scanner(TEMPLATES, PHRASES)


def _rows(scanner: Scanner, batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs, _ = K.string_buffers(batch.column("text"))
    words = K.Words(data, offs, WORD_BYTE, K.FOLDED)
    firsts, n = words.first, batch.num_rows
    base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
    labels: list[set] = [set() for _ in range(n)]
    own: list[set] = [set() for _ in range(n)]
    for tokens, label in scanner.phrases:
        m = len(tokens)
        hits = np.flatnonzero(words.hashes[: len(words.hashes) - m + 1] == tokens[0]) if len(words.hashes) >= m else np.empty(0, int)
        for j in range(1, m):
            hits = hits[words.hashes[hits + j] == tokens[j]]
        doc = np.searchsorted(firsts, hits, "right") - 1
        inside = hits + m <= firsts[doc + 1]
        for h, d in zip(hits[inside].tolist(), doc[inside].tolist()):
            at = h - int(firsts[d])
            base[d] += 1
            first[d] = at if first[d] < 0 else min(first[d], at)
            last[d] = max(last[d], at)
            labels[d].add(label)
    score = np.array([1.0 if x else 0.0 for x in labels])
    ids = scanner.token_ids(words.hashes)
    found: dict[int, list] = {}
    for a, b in scanner.runs(ids, firsts):
        d = int(np.searchsorted(firsts, a, "right")) - 1
        found.setdefault(d, []).extend(scanner.matches(ids[a:b].tolist(), a))
    for d, matches in found.items():
        own[d], share = scanner.present(scanner.chains(matches))
        score[d] = max(score[d], share)
    none = lambda x: pa.array(np.where(x < 0, 0, x), pa.int64(), mask=x < 0)
    return pa.record_batch(
        [batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(base), none(first), none(last), pa.array([",".join(sorted(x)) for x in labels]), pa.array([",".join(sorted(x | y)) for x, y in zip(labels, own)]), pa.array(score)],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def license_labels(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``; score is the covered share of the best template, 1 with a base phrase."""
    scanner = scanner or _default()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                yield _rows(scanner, batch)

    fields = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))
