"""License scans: template-markup matching with token automata.

A template is license wording with markup: ``[[ ... ]]`` is an optional region (they
nest), ``{{n}}`` a replaceable region of up to n words, everything else is mandatory.
A template is compiled into an automaton over words; it accepts a passage whose
mandatory words stand there exactly and in order. A text is searched for the longest
mandatory run of each template first, so automata only run where they can accept.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.

Defined results: a null text counts as an empty one; a text without words has no labels
and the score 0; repeated rows and null ids are kept as they are. Of passages of one
template that begin at a word the longest counts, and the next one begins behind it;
passages of several templates all count, so a short notice inside a whole license gives
its label too. Texts of any length are read whole. An empty table gives an empty one.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import pieces_of

#: Phrases that are looked for as they are, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following
disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for any direct
indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability
or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_GNU = """[[this file is part of {{6}}]] {{}} is free software you can redistribute it and or modify it under the terms of the gnu {kind}
as published by the free software foundation either version {version} of the license or [[at your option]] any later version"""

#: Label -> templates (fixed values): short notices, and the whole wording of public licenses.
TEMPLATES = {
    "mit": [
        "[[this {{2}} is]] released under the [[terms of the]] mit license", "[[is]] licensed under the [[terms of the]] mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        f"""[[the]] [[mit license]] [[mit]] [[copyright [[c]] {{{{12}}}}]] [[all rights reserved]] permission is hereby granted free of charge to any person obtaining a copy of
        this software and associated documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]]
        shall be included in all copies or substantial portions of the software {_WARRANTY}""",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0", "released under the apache license [[version]] 2 0",
        """[[copyright {{12}}]] licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in
        writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
        implied see the license for the specific language governing permissions and limitations under the license""",
    ],
    "gpl-3.0": [
        "[[this {{2}} is]] [[licensed under]] [[the terms of]] the [[gnu]] general public license version 3 [[0]]", "gnu gpl [[version]] [[v]] 3",
        _GNU.replace("{{}}", "this program").format(kind="general public license", version="3"),
    ],
    "gpl-2.0": [
        "[[this {{2}} is]] [[licensed under]] [[the terms of]] the [[gnu]] general public license version 2 [[0]]",
        _GNU.replace("{{}}", "this program").format(kind="general public license", version="2"),
    ],
    "lgpl-2.1": [_GNU.replace("{{}}", "this library").format(kind="lesser general public license", version="2 1")],
    "cc-by-4.0": ["[[licensed under]] [[a]] cc by 4 0", "creative commons attribution 4 0 international [[license]]"],
    "cc-by-nc-4.0": ["[[licensed under]] [[a]] cc by nc 4 0", "creative commons attribution noncommercial 4 0 international [[license]]"],
    "cc-by-sa-4.0": ["[[licensed under]] [[a]] cc by sa 4 0", "creative commons attribution sharealike 4 0 international [[license]]"],
    "bsd-2-clause": [f"[[copyright [[c]] {{{{12}}}}]] [[all rights reserved]] {_BSD} {_BSD_END}"],
    "bsd-3-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "[[licensed under]] the [[3 clause]] bsd license",
        f"""[[copyright [[c]] {{{{12}}}}]] [[all rights reserved]] {_BSD} [[3]] neither the name of {{{{10}}}} nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission {_BSD_END}""",
    ],
    "isc": [
        """[[copyright [[c]] {{12}}]] permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any
        special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    ],
    "zlib": [
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
        the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not
        required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may
        not be removed or altered from any source distribution""",
    ],
    "copyright": ["copyright [[c]] {{6}} all rights reserved"],
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """A template, compiled. States are numbered; ``steps`` go on with a word,
    ``jumps`` without one, ``skips`` with any word."""

    def __init__(self, template: str):
        self.steps: list[dict[bytes, int]] = [{}]
        self.jumps: list[list[int]] = [[]]
        self.skips: list[int] = [-1]
        at, opened, run, self.anchor = 0, [], [], b""
        for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                self.jumps[opened.pop()].append(at)
            elif token[0] == "{":
                first = at
                for _ in range(int(token[2:-2])):
                    self.skips[at], at = self._state(), len(self.steps) - 1
                    self.jumps[first].append(at)
            else:
                word = token.lower().encode()
                self.steps[at][word], at = self._state(), len(self.steps) - 1
                if not opened:
                    run.append(word)
                    continue
            self._keep(run)
        self._keep(run)
        if opened or not self.anchor:
            raise ValueError(f"a template needs closed regions and mandatory words: {template}")
        self.end = at
        self.closed = [self._closure({k}) for k in range(len(self.steps))]
        if any(self.skips[k] >= 0 for k in self.closed[0]):
            raise ValueError(f"a template can't begin with a replaceable region: {template}")
        self.first = {w for k in self.closed[0] for w in self.steps[k]}

    def _keep(self, run: list[bytes]) -> None:
        joined = b" " + b" ".join(run) + b" "
        if run and len(joined) > len(self.anchor):
            self.anchor = joined
        run.clear()

    def _state(self) -> int:
        self.steps.append({})
        self.jumps.append([])
        self.skips.append(-1)
        return len(self.steps) - 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for k in self.jumps[todo.pop()]:
                if k not in out:
                    out.add(k)
                    todo.append(k)
        return frozenset(out)

    def longest(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted passage that begins at ``start``; -1: none."""
        now, best = self.closed[0], -1
        for i in range(start, len(words)):
            nxt: set[int] = set()
            for k in now:
                if (t := self.steps[k].get(words[i], -1)) >= 0:
                    nxt |= self.closed[t]
                if self.skips[k] >= 0:
                    nxt |= self.closed[self.skips[k]]
            if not nxt:
                break
            now = frozenset(nxt)
            if self.end in now:
                best = i + 1
        return best


class Scanner:
    """Automata of all templates and the base phrases."""

    def __init__(self, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None):
        self.automata = [(label, Automaton(t)) for label, ts in (TEMPLATES if templates is None else templates).items() for t in ts]
        self.base = {f" {p} ".encode(): label for p, label in (BASE if base is None else base).items()}

    def scan(self, text: bytes | None) -> dict:
        """n_words; places: (word, end, label) of base phrases; spans: (start, end, label) of
        accepted passages, in words."""
        words = words_of(text or b"")
        joined = b" " + b" ".join(words) + b" "
        places, spans = [], []
        for phrase, label in self.base.items():
            at = joined.find(phrase)
            seen, since = 0, 0
            while at >= 0:
                seen += joined.count(b" ", since, at)
                since = at
                places.append((seen, seen + phrase.count(b" ") - 1, label))
                at = joined.find(phrase, at + 1)
        for label, a in self.automata:
            if a.anchor in joined:
                ready = 0
                for i, w in enumerate(words):
                    if i >= ready and w in a.first and (end := a.longest(words, i)) >= 0:
                        spans.append((i, end, label))
                        ready = end
        return {"n_words": len(words), "places": sorted(places), "spans": sorted(spans)}


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, n_words, places, spans) of every row."""
    scanner = scanner or Scanner()
    place = pa.struct([("word", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])

    def rows(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                got = [scanner.scan(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([g["n_words"] for g in got], pa.int64()),
                    pa.array([[{"word": w, "end": e, "label": x} for w, e, x in g["places"]] for g in got], pa.list_(place)),
                    pa.array([[{"start": s, "end": e, "label": x} for s, e, x in g["spans"]] for g in got], pa.list_(span)),
                ], ["doc_id", "n_words", "places", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_words long, places array<struct<word:long,end:long,label:string>>, spans array<struct<start:long,end:long,label:string>>")


def judged(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row for each document: counts, first and last place, labels, and as the score
    the share of words in accepted passages and base phrases."""
    out = scan(docs, scanner)
    passages = F.expr("array_sort(concat(transform(places, p -> named_struct('start', p.word, 'end', p.end)), transform(spans, s -> named_struct('start', s.start, 'end', s.end))))")
    out = out.withColumn("passages", passages)
    covered = F.expr("aggregate(passages, named_struct('n', 0L, 'e', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.end - greatest(s.start, a.e)), 'e', greatest(a.e, s.end)), a -> a.n)")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.expr("array_min(places.word)").alias("first_word"), F.expr("array_max(places.word)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(places.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(places.label, spans.label))), ',')").alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0).cast("double").alias("score"),
    )
