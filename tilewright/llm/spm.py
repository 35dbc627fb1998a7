"""SentencePiece encoding and decoding with a unigram model.

Pieces live in a double-array trie over their characters; the best segmentation of a
text is found by Viterbi over log scores. A character without a piece of its own costs
the smallest score less 10 and is written as the pieces of its UTF-8 bytes (byte
fallback). A space is the marker U+2581, one is put before the text, and decoding turns
markers into spaces and drops the first. No piece holds a marker after another
character (checked on loading), so words with the markers before them are segmented
apart, many at a time, and kept for the rest of the task.

A BPE vocabulary's scores are ranks, not probabilities; log scores are then taken from
a Zipf law over the ranks. The tables are built on the driver from the vocabulary file
(its size is the bound of what tasks get) and sent with the task.

Defined results: a null or empty text has no pieces and decodes to an empty text; a
marker character in the text decodes to a space, as in the format itself; all else
comes back exactly. Of segmentations with equal scores the one with the longest last piece
counts. Texts of any length are encoded whole. An empty table gives an empty one. Only the
id and the text are read, so other columns may have any name; repeated rows and null ids
are kept as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import pieces_of

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_DEAD = -1


class DoubleArray:
    """base and check arrays over dense character codes (1..n)."""

    def __init__(self, words: list[tuple[tuple[int, ...], int]], n_codes: int):
        children: dict = {}
        n_nodes = 1
        for word, value in words:
            node = children
            for c in word:
                if c not in node:
                    node[c] = {}
                    n_nodes += 1
                node = node[c]
            node[0] = value
        size = 4 * n_nodes + 4 * n_codes
        used = bytearray(size)
        used[0] = 1
        base, check, values = [0] * size, [_DEAD] * size, [-1] * size
        hint: dict[tuple[int, bool], int] = {}
        stack, top = [(0, children)], 0
        while stack:
            state, node = stack.pop()
            values[state] = node.get(0, -1)
            codes = sorted(c for c in node if c)
            if not codes:
                continue
            key = (codes[0], len(codes) > 1)
            b = hint.get(key, 1)
            while True:
                b = max(b, used.find(0, b + codes[0]) - codes[0])
                if b + n_codes < len(used) and not any(used[b + c] for c in codes):
                    break
                b += 1
                if b + n_codes >= len(used):
                    used += bytearray(size)
                    base += [0] * size
                    check += [_DEAD] * size
                    values += [-1] * size
            hint[key] = b
            base[state] = b
            for c in codes:
                used[b + c] = 1
                check[b + c] = state
                stack.append((b + c, node[c]))
            top = max(top, b + codes[-1])
        end = top + n_codes + 2
        pad = max(0, end - len(base))
        self.base = np.array(base[:end] + [0] * pad, np.int32)
        self.check = np.array(check[:end] + [_DEAD] * pad, np.int32)
        self.value = np.array(values[:end] + [-1] * pad, np.int32)


class _Known(dict):
    """Word -> index; a new word gets the next one and waits to be segmented."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
    return flat[at]


class Unigram:
    """Pieces with scores; ``kinds``: n(ormal), b(yte), u(nknown) or c(ontrol)."""

    MOST_KNOWN = 400_000

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        normal = [k for k, kind in enumerate(kinds) if kind == "n" and pieces[k]]
        if any(MARK in p.lstrip(MARK) for p in (pieces[k] for k in normal)):
            raise ValueError("a piece holds a marker after another character")
        self.pieces, self.scores, self.kinds = pieces, np.array(scores, np.float64), kinds
        self.byte_ids = np.full(256, -1, np.int32)
        for k, kind in enumerate(kinds):
            if kind == "b":
                self.byte_ids[int(pieces[k][3:5], 16)] = k
        self.unknown = next((k for k, kind in enumerate(kinds) if kind == "u"), 0)
        self.byte_fallback = bool((self.byte_ids >= 0).all())
        chars = sorted({c for k in normal for c in pieces[k]})
        self.codes = np.zeros(0x110001, np.int32)
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.codes[ord(" ")] = self.codes[ord(MARK)]
        self.trie = DoubleArray([(tuple(int(self.codes[ord(c)]) for c in pieces[k]), k) for k in normal], len(chars) + 1)
        self.unknown_score = float(self.scores[normal].min()) - 10
        self.apart = not self.codes[10]
        self.split = re.compile("\n[^ \n]*| *[^ \n]+| +" if self.apart else " *[^ ]+| +")
        raw = [bytes([int(p[3:5], 16)]) if kind == "b" else p.replace(MARK, " ").encode() if kind == "n" else b"" if kind == "c" else " ⁇ ".encode() for p, kind in zip(pieces, kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "flat", "starts", "lengths")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat = _Known(), np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    # -- segmentation -------------------------------------------------------------

    def _unknown_ids(self, char: int) -> list[int]:
        if not self.byte_fallback:
            return [self.unknown]
        return self.byte_ids[list(chr(char).encode("utf-8", "surrogatepass"))].tolist()

    def viterbi(self, word: str) -> list[int]:
        """The best pieces of one word, a character at a time."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        chars = [ord(c) for c in word]
        codes = self.codes[chars].tolist()
        n = len(codes)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            state, single = 0, False
            for j in range(i, n):
                if not codes[j]:
                    break
                nxt = int(base[state]) + codes[j]
                if check[nxt] != state:
                    break
                state = nxt
                if (piece := int(value[state])) >= 0:
                    single |= j == i
                    if (s := best[i] + scores[piece]) > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, piece)
                if not base[state]:
                    break
            if not single and (s := best[i] + self.unknown_score) > best[i + 1]:
                best[i + 1], back[i + 1] = s, (i, -1)
        out, j = [], n
        while j:
            i, piece = back[j]
            out.append([piece] if piece >= 0 else self._unknown_ids(chars[i]))
            j = i
        return [k for part in reversed(out) for k in part]

    def _viterbi_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """viterbi() for words of one length, all at once: (ids, ids of each word)."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        w, n = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(w, n)
        codes = self.codes[chars]
        best = np.full((n + 1, w), -np.inf)
        best[0] = 0
        back, piece_at = np.zeros((n + 1, w), np.int32), np.full((n + 1, w), -1, np.int32)
        for i in range(n):
            rows, state = np.arange(w), np.zeros(w, np.int32)
            single = np.zeros(w, bool)
            for j in range(i, n):
                code = codes[rows, j]
                nxt = base[state] + code
                ok = (check[nxt] == state) & (code > 0)
                rows, state = rows[ok], nxt[ok]
                if not len(rows):
                    break
                piece = value[state]
                real = piece >= 0
                hit, piece = rows[real], piece[real]
                if j == i:
                    single[hit] = True
                s = best[i, hit] + scores[piece]
                up = s > best[j + 1, hit]
                hit = hit[up]
                best[j + 1, hit], back[j + 1, hit], piece_at[j + 1, hit] = s[up], i, piece[up]
            s = best[i] + self.unknown_score
            up = ~single & (s > best[i + 1])
            best[i + 1, up], back[i + 1, up], piece_at[i + 1, up] = s[up], i, -1
        rows, at, steps = np.arange(w), np.full(w, n), []
        while at.any():
            before = back[at, rows]
            piece = piece_at[at, rows]
            steps.append(np.where(at == 0, 0, np.where(piece >= 0, piece + 1, -1 - chars[rows, np.minimum(before, n - 1)].astype(np.int64))))
            at = before
        steps = np.array(steps[::-1]).T
        keep = steps != 0
        ids, lengths = steps[keep], keep.sum(1)
        if (odd := ids < 0).any():
            times = np.ones(len(ids), np.int64)
            parts = {c: self._unknown_ids(-1 - c) for c in set(ids[odd].tolist())}
            times[odd] = [len(parts[c]) for c in ids[odd].tolist()]
            starts = np.cumsum(times) - times
            wide = np.repeat(ids, times)
            for c, own in parts.items():
                first = starts[ids == c]
                for k, piece in enumerate(own):
                    wide[first + k] = piece + 1
            lengths = np.add.reduceat(times, np.cumsum(lengths) - lengths)
            ids = wide
        return (ids - 1).astype(np.int32), lengths

    def _learn(self) -> None:
        """Segment the words that wait."""
        new = [k if k.startswith("\n") and self.apart else " " + k for k in self.known.new]
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(new):
            by_length.setdefault(len(word), []).append(k)
        starts, lengths, flat, end = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.flat], len(self.flat)
        for n, own in by_length.items():
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                if n > 64 or len(part) < 4:
                    found = [self.viterbi(new[k]) for k in part]
                    ids, counts = np.array([k for f in found for k in f], np.int32), np.array([len(f) for f in found], np.int64)
                else:
                    ids, counts = self._viterbi_many([new[k] for k in part])
                starts[part], lengths[part] = end + np.cumsum(counts) - counts, counts
                flat.append(ids)
                end += len(ids)
        self.starts, self.lengths, self.flat = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths]), np.concatenate(flat)
        self.known.new = []

    def words(self, text: str) -> list[str]:
        """The text's parts that are segmented apart, each without the one space that
        it begins with; a part after a line break begins with that instead."""
        text = text.replace(MARK, " ")
        ready = text.replace("\n", " \n") if self.apart else text
        if "  " not in ready and not ready.startswith(" ") and not ready.endswith(" "):
            return ready.split(" ")
        return [w[1:] if w[0] == " " else w for w in self.split.findall(" " + text)]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text k has ids[offsets[k] : offsets[k + 1]]."""
        if len(self.known) > self.MOST_KNOWN:
            self._forget()
        index, found, ends = self.known.__getitem__, [], [0]
        for t in texts:
            if t:
                found.extend(map(index, self.words(t)))
            ends.append(len(found))
        if self.known.new:
            self._learn()
        words = np.array(found, np.int64)
        lengths = self.lengths[words]
        return _gather(self.flat, self.starts[words], lengths), np.concatenate([[0], np.cumsum(lengths)])[ends]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    # -- decoding -----------------------------------------------------------------

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        lengths = self.raw_lengths[ids]
        data = _gather(self.raw, self.raw_starts[ids], lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        ids = np.array(list(ids), np.int64)
        return self.decode_batch(ids, np.array([0, len(ids)]))[0]


def load(path: str = DEFAULT_MODEL, zipf: bool | None = None) -> Unigram:
    """The pieces of a SentencePiece model file. ``zipf``: log scores from ranks; by
    default for models whose scores are ranks (whole numbers)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces, scores = [p.id_to_piece(k) for k in range(n)], [p.get_score(k) for k in range(n)]
    kinds = ["b" if p.is_byte(k) else "u" if p.is_unknown(k) else "c" if p.is_control(k) or p.is_unused(k) else "n" for k in range(n)]
    if zipf or zipf is None and all(float(s).is_integer() for s in scores):
        order = sorted((k for k in range(n) if kinds[k] == "n"), key=lambda k: (-scores[k], k))
        total = np.log((1 / np.arange(1, len(order) + 1)).sum())
        for rank, k in enumerate(order):
            scores[k] = -float(np.log(rank + 1) + total)
    return Unigram(pieces, scores, kinds)


def encode(docs: DataFrame, model: Unigram) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, round_trip, ids) of every row; round_trip: the
    ids decode to the text."""

    def rows(batches):
        is_byte = np.array([k == "b" for k in model.kinds])
        for whole in batches:
            for batch in pieces_of(whole, 2 << 20):
                texts = batch.column("text").to_pylist()
                ids, offsets = model.encode_batch(texts)
                back = model.decode_batch(ids, offsets)
                same = [(t or "").replace(MARK, " ") == b for t, b in zip(texts, back, strict=True)]
                counts = np.diff(offsets)
                of_bytes = np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[offsets])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_bytes, pa.int64()), pa.array(same), lists], ["doc_id", "n_pieces", "n_byte_pieces", "round_trip", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_pieces long, n_byte_pieces long, round_trip boolean, ids array<int>")


def decode(rows: DataFrame, model: Unigram) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to an empty text."""

    def texts(batches):
        for batch in batches:
            got = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(texts, "doc_id long, text string")
