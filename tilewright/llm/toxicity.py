"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters to Latin ones, digit and sign
substitutions to letters, zero-width characters removed. The lexicon is learned from
labelled rows: words and word beginnings whose document frequency is much higher among
toxic documents, with their log odds as weights. A hit inside an exception phrase (word
pairs around a term that occur in clean documents) does not count. The sum of weights,
as such and for each hundred words, gives a score by a logistic curve.

Defined results: a null text counts as an empty one; a text without hits has the score
of the curve at zero; a row with a null id is scored and never used for fitting;
repeated rows are scored one by one, equal texts alike. Of hits that overlap the heaviest
counts, of equally heavy ones the first; a score of exactly the bound is toxic; terms of
equal gain are taken in the order of length, then letters. Texts of any length are
folded and matched whole. Without toxic or clean labelled rows the lexicon is empty and
the score is the share of toxic labels (0 without labels); an empty table gives an empty
one. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import drop_stored, held_out, pieces_of, stored, with_labels

#: Parameters of the model: at most so many labelled rows are used for fitting, and the
#: lexicon has so many terms at most.
MOST_LABELLED, MOST_TERMS = 6_000, 400
STEMS = (4, 5)

_FOLD = dict(zip(map(ord, "аеорсухіјѕԁһӏкмтвнзбαεορτυικνχАЕОРСУХІЈЅКМТВНΑΕΟΡΤΥΙΚΝΧΒΗΜΖ"), "aeopcyxijsdhlkmtbhzbaeoptuiknxaeopcyxijskmtbhaeoptyiknxbhmz", strict=True))
_FOLD |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
_FOLD |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
_FOLD |= dict.fromkeys(map(ord, "“”‘’«»–—…¿¡\u00a0"), " ")
_INSIDE = re.compile(r"(?<=\w)[!|](?=\w)")
_ODD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
#: 1 may stand for l or i, so it and l itself become i; ! and | do so between letters.
_BYTES = bytearray(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
for _a, _b in zip(b"013457@$lL", b"oieastasii", strict=True):
    _BYTES[_a] = _b
_BYTES = bytes(_BYTES)


def fold(text: str | None) -> str:
    """The folded words of a text, each with one space before and after it."""
    low = (text or "").lower()
    if not low.isascii() and _ODD.search(low):
        low = low.translate(_FOLD)
    if "!" in low or "|" in low:
        low = _INSIDE.sub("i", low)
    words = low.encode("utf-8", "replace").translate(_BYTES).split()
    return f" {b' '.join(words).decode('utf-8', 'replace')} "


def fold_term(term: str) -> str:
    """A folded term; a space at an end says that a word begins or ends there."""
    return " " * term.startswith(" ") + fold(term).strip() + " " * term.endswith(" ")


def _terms(words: set[str]) -> set[str]:
    """Whole words (with spaces) and beginnings of words (a space before)."""
    out = {f" {w} " for w in words}
    for k in STEMS:
        out |= {f" {w[:k]}" for w in words if len(w) > k}
    return out


class Lexicon:
    """Weighted terms and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset(), curve=(0.0, 0.0, 0.0)):
        self.weights = {fold_term(t): w for t, w in weights.items()}
        self.exceptions, self.curve = frozenset(map(fold_term, exceptions)), tuple(curve)
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.weights, self.exceptions, self.curve = state
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term in self.exceptions:
                self._automaton.add_word(term, (len(term), None))
            for term, w in self.weights.items():
                self._automaton.add_word(term, (len(term), w))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each counted hit: of overlapping hits the heaviest,
        and none inside an exception phrase."""
        a = self.automaton()
        if not len(a):
            return []
        found, excused = [], []
        for end, (n, w) in a.iter(folded):
            (excused if w is None else found).append((end - n + 1, end + 1, w))
        if excused:
            found = [x for x in found if not any(s <= x[0] and x[1] <= e for s, e, _ in excused)]
        out: list[tuple[int, int, float]] = []
        for s, e, w in sorted(found):
            if out and s < out[-1][1] - 1:
                if w > out[-1][2]:
                    out[-1] = (s, e, w)
            else:
                out.append((s, e, w))
        return out

    def measures(self, text: str | None) -> tuple[float, float]:
        """log(1 + sum of weights) and log(1 + sum for each hundred words)."""
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1)) if total else 0.0

    def score(self, text: str | None) -> float:
        x, y = self.measures(text)
        z = self.curve[0] + self.curve[1] * x + self.curve[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count_batches(**columns: Counter):
    """Batches (t, one count for each named counter)."""
    keys = list(set().union(*columns.values()))
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[k] for k in part], pa.int64()) for c in columns.values())], ["t", *columns])


def _folded(batches):
    for whole in batches:
        for batch in pieces_of(whole):
            for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
                yield fold(text.as_py()), y.as_py()


def _pick(docs_of: dict[str, set[int]], weight: dict[str, float], most_terms: int, least_new: int, n_toxic: int) -> dict[str, float]:
    """Terms in the order of the toxic documents that they add to those already
    covered, and those in a fiftieth of all toxic documents. Words that only come along
    with other words (those of copied texts) are not taken: their documents are the
    same as another word's."""

    def twin(t: str) -> bool:
        own = docs_of[t]
        return any(t.strip() not in u and u.strip() not in t and len(own & d) > 0.7 * len(own | d) for u, d in docs_of.items() if 0.7 * len(own) <= len(d) <= len(own) / 0.7)

    left, covered, out = dict(docs_of), set(), {}
    while left and len(out) < most_terms:
        gain = {t: len(d - covered) for t, d in left.items()}
        best = max(left, key=lambda t: (gain[t] * weight[t], -len(t), t))
        if gain[best] < least_new:
            break
        out[best] = weight[best]
        covered |= left.pop(best)
        left = {t: d for t, d in left.items() if best not in t}
    for t, d in sorted(left.items(), key=lambda x: (-len(x[1]), len(x[0]), x[0])):
        if len(out) < most_terms and len(d) >= max(least_new, 0.02 * n_toxic) and not any(k in t for k in out) and not twin(t):
            out[t] = weight[t]
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_terms: int = MOST_TERMS, least_docs: int = 5) -> Lexicon:
    """Learn terms, weights, exceptions and the curve from at most ``most`` labelled
    rows outside the held-out part, equal texts counted once. The driver gets counts of
    the terms of these rows and ``most`` short rows at most."""
    rows = stored(with_labels(docs, labels, "toxic", most).groupBy("text", "y").agg(F.min("doc_id").alias("doc_id")))
    n_toxic, n_clean = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n_toxic, n_clean = n_toxic or 0, n_clean or 0
    if not n_toxic or not n_clean:
        drop_stored(rows)
        p = n_toxic / max(1, n_toxic + n_clean)
        return Lexicon({}, curve=(30.0 if p == 1 else -30.0, 0.0, 0.0))
    least_docs = max(2, min(least_docs, n_toxic // 4))

    def in_toxic(batches):
        count = Counter()
        for folded, _ in _folded(batches):
            count.update(_terms(set(folded.split())))
        yield from _count_batches(toxic=count)

    counts = rows.where("y = 1").mapInArrow(in_toxic, "t string, toxic long").groupBy("t").agg(F.sum("toxic").alias("toxic"))
    toxic = {r.t: r.toxic for r in counts.where(F.col("toxic") >= least_docs).collect()}

    def in_clean(batches):
        count = Counter()
        for folded, _ in _folded(batches):
            count.update(_terms(set(folded.split())) & toxic.keys())
        yield from _count_batches(clean=count)

    counts = rows.where("y = 0").mapInArrow(in_clean, "t string, clean long").groupBy("t").agg(F.sum("clean").alias("clean"))
    clean = {r.t: r.clean for r in counts.collect()}
    weight = {t: min(6.0, math.log(((k + 0.5) / (n_toxic + 1)) / ((clean.get(t, 0) + 0.5) / (n_clean + 1)))) for t, k in toxic.items()}
    strong = {t: w for t, w in sorted(weight.items(), key=lambda x: (-x[1] * math.sqrt(toxic[x[0]]), x[0])) if w >= 2}

    def present(batches):
        for folded, _ in _folded(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_terms(set(folded.split())) & strong.keys())], pa.list_(pa.string()))], ["t"])

    docs_of: dict[str, set[int]] = {t: set() for t in strong}
    for k, r in enumerate(rows.where("y = 1").mapInArrow(present, "t array<string>").collect()):
        for t in r.t:
            docs_of[t].add(k)
    weights = _pick(docs_of, strong, most_terms, least_docs, n_toxic)
    plain = Lexicon(weights)

    def around(batches):
        toxic, clean = Counter(), Counter()
        for folded, y in _folded(batches):
            found = set()
            for s, e, _ in plain.hits(folded):
                e = max(folded.index(" ", s + 1) + 1, e)
                if s:
                    found.add(folded[folded.rindex(" ", 0, s) : e])
                if e < len(folded):
                    found.add(folded[s : folded.index(" ", e) + 1])
            (toxic if y else clean).update(found)
        yield from _count_batches(toxic=toxic, clean=clean)

    pairs = rows.mapInArrow(around, "t string, toxic long, clean long").groupBy("t").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    excused = pairs.where("clean >= 3 and clean >= 4 * toxic").collect()
    lexicon = Lexicon(weights, frozenset(r.t for r in excused))

    def measured(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                got = [lexicon.measures(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "y", "a", "b"])

    got = rows.mapInArrow(measured, "doc_id long, y int, a double, b double").toPandas().sort_values("doc_id", kind="stable")
    a = np.column_stack([np.ones(len(got)), got["a"], got["b"]])
    y, w = got["y"].to_numpy(float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(3), a.T @ (y - p) - 0.1 * w)
    drop_stored(rows)
    return Lexicon(weights, lexicon.exceptions, w.tolist())


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row."""

    def rows(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([lexicon.score(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
