"""Substring dedup: exact repeats of ``window`` words, found by fixed-block anchors.

Every document is cut into blocks of half a window; any window holds a whole block of
its own document. So the index has every block, and every rolling run of a block's
length, of every document, probes it. All windows around a hit are looked up by hash, and
each one that has an earlier place elsewhere (by doc_id, then place) is paired with the
earliest one. Pairs that go on word by word make up a run, the maximal repeat of the two
places, and the words of both places are compared. Windows with equal words are marked;
those whose words differ, as hashes may be equal by chance, are looked up again among
themselves, until none is left. So results do not depend on the hashes. The words of all
marked windows are removed.

How it is spread: a task hashes its documents in batches and settles what repeats inside
a batch, by comparing words, so a passage that a third of all documents share is sent once
for each batch, not for each document. The other hashes go to buckets by value, four bytes
and a place each; the number of buckets follows the size of the input, so a bucket's size
does not. What comes back are places. Earlier places are fetched in pages of some words,
each page once, and joined with the runs that ask for it. Texts are only shuffled for
documents with hits, for the earlier ones, and again for those that lose words.

Defined results: null and empty texts have no words; texts of fewer words than a window
lose none; a null doc_id comes after all others; rows with equal id and text are one
document and get the same result; rows with one id and different texts are ordered by a
64-bit hash of the text, which stands for it. Of equal windows the one of the smallest id, then place, stays. Texts
of any length are read whole, in batches that end between documents. An empty table
gives an empty one. Only the id and the text are read, so other columns may have any
name.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import pieces_of, stored, union_all

#: Bytes of text for each bucket, and of a batch.
BUCKET_BYTES, BATCH_BYTES = 20 << 20, 6 << 20
#: Up to so many ids are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Words of a page of an earlier document, of which runs fetch what they are compared with.
PAGE = 64
_LAST = np.iinfo(np.int64).max
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Codes(dict):
    """A number for each word, and a hash for each number."""

    MOST = 400_000

    def __init__(self):
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, 7))
        return code

    def clear(self):
        super().clear()
        self.hashes = array("Q")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _rolling(words: np.ndarray, width: int, m: np.uint64, bits: int = 64) -> np.ndarray:
    """A hash of each run of ``width`` words; only ``bits`` bits of it tell runs apart."""
    n = len(words) - width + 1
    out, power = np.zeros(max(0, n), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width if n > 0 else 0):
            out += words[k : k + n] * power
            power = np.uint64((int(power) * int(m)) & 0xFFFFFFFFFFFFFFFF)
        out = _mixed(out)
        return out if bits >= 64 else _mixed(out & np.uint64((1 << bits) - 1))


def _classes(codes: np.ndarray, at: np.ndarray, width: int, h: np.ndarray) -> np.ndarray:
    """One number for all runs of ``width`` equal words. Runs with one hash are compared
    with the first of them, word by word; those that differ are numbered again."""
    out, left, before = np.empty(len(at), np.int64), np.arange(len(at)), 0
    while len(left):
        _, lead, inverse = np.unique(h[left], return_index=True, return_inverse=True)
        mine, first, same = at[left], at[left[lead]][inverse], np.ones(len(left), bool)
        for k in range(width):
            same &= codes[mine + k] == codes[first + k]
        out[left[same]] = before + inverse[same]
        before += len(lead)
        left = left[~same]
    return out


class _Batch:
    """Word hashes of some documents, one after another."""

    def __init__(self, ids, ties, texts, known: _Codes):
        if len(known) > known.MOST:
            known.clear()
        found, lengths, get = [], [], known.__getitem__
        for t in texts:
            before = len(found)
            if t:
                found.extend(map(get, t.split()))
            lengths.append(len(found) - before)
        self.ids, self.ties = np.asarray(ids, np.int64), np.asarray(ties, np.int64)
        self.codes = np.array(found, np.int64)
        self.words = np.array(known.hashes, np.uint64)[self.codes]
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.name = xxhash.xxh64_intdigest(self.ids.tobytes() + self.ties.tobytes() + self.words[:64].tobytes()) >> 1

    def valid(self, width: int) -> np.ndarray:
        """The starts of all runs of ``width`` words that end in the same document."""
        counts = np.maximum(0, self.lengths - width + 1)
        ends = np.cumsum(counts)
        return np.repeat(self.starts - (ends - counts), counts) + np.arange(int(counts.sum()))


def _ids(batch) -> tuple[np.ndarray, np.ndarray, list]:
    return batch.column("__id").to_numpy(), batch.column("__tie").to_numpy(), batch.column("text").cast(pa.binary()).to_pylist()


def _deltas(places: np.ndarray) -> bytes:
    """Rising places below 2^32, in two bytes each where the gaps allow it."""
    gaps = np.diff(places, prepend=0)
    if len(gaps) and gaps.max() < 1 << 16:
        return b"\2" + gaps.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return b"\4" + gaps.astype("<u4").tobytes()


def _places(data: bytes) -> np.ndarray:
    if data[0] == 2:
        return np.cumsum(np.frombuffer(data, np.uint8, offset=1).reshape(2, -1).T.copy().view("<u2").ravel().astype(np.int64))
    return np.cumsum(np.frombuffer(data, "<u4", offset=1).astype(np.int64))


def _by_bucket(bucket: np.ndarray, n_buckets: int):
    order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


_SENT = "kind int, key long, batch long, a binary, b binary, c binary"


def _sent(kind, key, batch, a=b"", b=b"", c=b""):
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key], pa.int64()), pa.array([batch], pa.int64()), *(pa.array([x], pa.binary()) for x in (a, b, c))], ["kind", "key", "batch", "a", "b", "c"])


def _probes(window: int, n_buckets: int, bits: int):
    """Blocks and rolling probes of each batch, by bucket; kind 1: its documents; kind 2:
    places of runs that repeat inside the batch."""
    block = window // 2

    def rows(batches):
        known = _Codes()
        for whole in batches:
            for piece in pieces_of(whole, BATCH_BYTES):
                own = _Batch(*_ids(piece), known)
                long = own.lengths >= window
                at = own.valid(block)
                doc = np.repeat(np.arange(len(own.lengths)), np.maximum(0, own.lengths - block + 1))
                keep = long[doc]
                at, doc = at[keep], doc[keep]
                if not len(at):
                    continue
                h = _rolling(own.words, block, _M[0], bits)[at]
                aligned = (at - own.starts[doc]) % block == 0
                order = np.argsort(h, kind="stable")
                s = h[order]
                fresh = np.concatenate([[True], s[1:] != s[:-1]])
                first = np.flatnonzero(fresh)
                size = np.diff(np.append(first, len(s)))
                some = np.logical_or.reduceat(aligned[order], first)
                rep = order[first]
                multi = np.zeros(len(h), bool)
                multi[order] = np.repeat(size > 1, size)
                yield _sent(1, own.name, own.name, own.ids.tobytes(), own.ties.tobytes(), own.starts.tobytes())
                if multi.any():
                    yield _sent(2, own.name, own.name, _deltas(at[multi]))
                back = np.argsort(rep)
                rep, some = rep[back], some[back]
                for k, idx in _by_bucket(((h[rep] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                    yield _sent(0, k, own.name, h[rep[idx]].astype(np.uint32).tobytes(), _deltas(at[rep[idx]]), np.packbits(some[idx]).tobytes())

    return rows


def _hits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What of a bucket meets a block elsewhere, by batch."""
    if key[0] != 0:
        return rows
    parts = [np.frombuffer(a, np.uint32) for a in rows["a"]]
    n = [len(p) for p in parts]
    h = np.concatenate(parts)
    aligned = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=k).astype(bool) for c, k in zip(rows["c"], n, strict=True)])
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    hit = np.zeros(len(h), bool)
    hit[order] = np.repeat((size > 1) & np.logical_or.reduceat(aligned[order], first), size)
    out, end = [], 0
    for batch, places, k in zip(rows["batch"], rows["b"], n, strict=True):
        mine = hit[end : end + k]
        end += k
        if mine.any():
            out.append((2, batch, batch, _deltas(_places(places)[mine]), b"", b""))
    return pd.DataFrame(out, columns=["kind", "key", "batch", "a", "b", "c"])


def _to_docs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Places of a batch -> places of each of its documents: (id, tie, places)."""
    docs = rows[rows["kind"] == 1]
    marks = rows[rows["kind"] == 2]
    if not len(marks) or not len(docs):
        return pd.DataFrame({"__key": [], "__tie2": [], "places": []})
    ids, ties, starts = (np.frombuffer(docs.iloc[0][c], np.int64) for c in "abc")
    at = np.unique(np.concatenate([_places(a) for a in marks["a"]]))
    doc = np.searchsorted(starts, at, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return pd.DataFrame({"__key": ids[doc[first]], "__tie2": ties[doc[first]], "places": [_deltas(x - starts[d]) for d, x in zip(doc[first], np.split(at, first[1:]), strict=True)]})


def _windows(window: int, n_buckets: int, bits: int, around: bool):
    """Candidate windows, by bucket of their hash: those around the hits, or those at
    them. Inside a batch the first of equal windows is sent, and the others are marked
    (kind 3)."""
    block = window // 2

    def rows(batches):
        known = _Codes()
        for whole in batches:
            for piece in pieces_of(whole, BATCH_BYTES):
                own = _Batch(*_ids(piece), known)
                hit = np.zeros(len(own.words) + 1, np.int64)
                for k, parts in enumerate(piece.column("hits").to_pylist()):
                    for p in parts:
                        hit[own.starts[k] + _places(p)] = 1
                seen = np.concatenate([[0], np.cumsum(hit)])
                at = own.valid(window)
                at = at[seen[at + (window - block if around else 0) + 1] > seen[at]]
                if not len(at):
                    continue
                doc = np.searchsorted(own.starts + own.lengths, at, side="right")
                h, other = (_rolling(own.words, window, m, bits)[at] for m in _M)
                same_words = _classes(own.codes, at, window, h)
                place = at - own.starts[doc]
                rank = np.empty(len(own.ids), np.int64)
                by = np.lexsort((own.ties, own.ids))
                same = np.concatenate([[False], (own.ids[by][1:] == own.ids[by][:-1]) & (own.ties[by][1:] == own.ties[by][:-1])])
                rank[by] = np.cumsum(~same)
                order = np.lexsort((place, rank[doc], same_words))
                s = same_words[order]
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                size = np.diff(np.append(first, len(s)))
                least = np.repeat(order[first], size)
                later = order[(rank[doc[order]] != rank[doc[least]]) | (place[order] != place[least])]
                yield _sent(1, own.name, own.name, own.ids.tobytes(), own.ties.tobytes(), own.starts.tobytes())
                if len(later):
                    yield _sent(3, own.name, own.name, _deltas(np.sort(at[later])))
                rep = np.sort(order[first])
                for k, idx in _by_bucket((other[rep] % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                    mine = rep[idx]
                    cut = np.flatnonzero(np.concatenate([[True], doc[mine][1:] != doc[mine][:-1]]))
                    d = doc[mine][cut]
                    table = np.column_stack([own.ids[d], own.ties[d], own.starts[d], np.diff(np.append(cut, len(mine)))])
                    yield _sent(0, k, own.name, h[mine].tobytes(), _deltas(at[mine]), table.tobytes())

    return rows


def _later(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's windows with equal hashes all but those at the first place, each with
    that place, by batch: (places, documents, number of the document and place)."""
    if key[0] != 0:
        return rows
    h = np.concatenate([np.frombuffer(a, np.uint64) for a in rows["a"]])
    at = np.concatenate([_places(b) for b in rows["b"]])
    tables = [np.frombuffer(c, np.int64).reshape(-1, 4) for c in rows["c"]]
    batch = np.repeat(np.arange(len(rows)), [len(a) // 8 for a in rows["a"]])
    table = np.concatenate(tables)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    own = order[np.repeat(size > 1, size)]
    if not len(own):
        return pd.DataFrame({"kind": [], "key": [], "batch": [], "a": [], "b": [], "c": []}).astype({"a": object})
    line = np.repeat(np.arange(len(table)), table[:, 3])
    ids, ties, place = table[line[own], 0], table[line[own], 1], at[own] - table[line[own], 2]
    order = np.lexsort((place, ties, ids, h[own]))
    s, ids, ties, place = h[own][order], ids[order], ties[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    lead = np.repeat(first, np.diff(np.append(first, len(s))))
    late = np.flatnonzero((ids != ids[lead]) | (ties != ties[lead]) | (place != place[lead]))
    late = late[np.argsort(own[order[late]])]
    mine, lead = own[order[late]], lead[late]
    out = []
    for k in np.unique(batch[mine]):
        here = batch[mine] == k
        firsts, number = np.unique(np.column_stack([ids[lead[here]], ties[lead[here]]]), axis=0, return_inverse=True)
        where = np.concatenate([number.ravel(), place[lead[here]]]).astype("<u4")
        out.append((2, rows["batch"].iloc[k], rows["batch"].iloc[k], _deltas(at[mine[here]]), firsts.tobytes(), where.tobytes()))
    return pd.DataFrame(out, columns=["kind", "key", "batch", "a", "b", "c"])


_FOUND = "__key long, __tie2 long, places binary, at int, n int, id0 long, tie0 long, page int, off int"


def _to_runs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of a batch -> marked places of each of its documents, and runs of windows
    paired with earlier ones, cut where a page of the earlier document ends."""
    docs = rows[rows["kind"] == 1]
    marked = _to_docs(key, rows[rows["kind"] != 2].assign(kind=lambda r: r["kind"].clip(upper=2)))
    out = [marked.assign(at=0, n=0, id0=0, tie0=0, page=0, off=0)]
    late = rows[rows["kind"] == 2]
    if len(late) and len(docs):
        ids, ties, starts = (np.frombuffer(docs.iloc[0][c], np.int64) for c in "abc")
        at = np.concatenate([_places(a) for a in late["a"]])
        firsts = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in late["b"]]
        where = [np.frombuffer(c, "<u4").reshape(2, -1).astype(np.int64) for c in late["c"]]
        first = np.concatenate([f[w[0]] for f, w in zip(firsts, where, strict=True)])
        place = np.concatenate([w[1] for w in where])
        order = np.argsort(at)
        at, first, place = at[order], first[order], place[order]
        fresh = (np.diff(at) != 1) | (np.diff(place) != 1) | (np.diff(first, axis=0) != 0).any(axis=1) | (place[1:] % PAGE == 0)
        cut = np.flatnonzero(np.concatenate([[True], fresh]))
        doc = np.searchsorted(starts, at[cut], side="right") - 1
        runs = {"__key": ids[doc], "__tie2": ties[doc], "places": None, "at": at[cut] - starts[doc], "n": np.diff(np.append(cut, len(at)))}
        out.append(pd.DataFrame(runs | {"id0": first[cut, 0], "tie0": first[cut, 1], "page": place[cut] // PAGE, "off": place[cut] % PAGE}))
    return pd.concat([x for x in out if len(x)] or out[:1])


def _pages(window: int):
    """The wanted pages of documents, each with the words that a window at its end needs."""

    def rows(batches):
        for whole in batches:
            for piece in pieces_of(whole):
                for i, tie, t, wanted in zip(*_ids(piece), piece.column("pages").to_pylist(), strict=True):
                    words = (t or b"").split()
                    cuts = [b" ".join(words[k * PAGE : (k + 1) * PAGE + window - 1]) for k in wanted]
                    n = len(cuts)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array(wanted, pa.int32()), pa.array(cuts, pa.binary())], ["id0", "tie0", "page", "words"])

    return rows


def _compare(window: int):
    """Runs against the words of their pages: places of windows with equal words, and of
    the others."""

    def rows(batches):
        for whole in batches:
            for piece in pieces_of(whole):
                out = []
                for i, tie, t, checks in zip(*_ids(piece), piece.column("checks").to_pylist(), strict=True):
                    words = (t or b"").split()
                    hit = np.zeros((2, len(words)), bool)
                    for c in checks:
                        at, n = c["at"], c["n"]
                        mine = words[at : at + n + window - 1]
                        theirs = c["words"].split()[c["off"] : c["off"] + n + window - 1]
                        if mine == theirs:
                            hit[0, at : at + n] = True
                        else:
                            wrong = np.concatenate([[0], np.cumsum([x != y for x, y in zip(mine, theirs, strict=True)])])
                            same = wrong[window:] == wrong[:-window]
                            hit[0, at : at + n] |= same
                            hit[1, at : at + n] |= ~same
                    out.append((i, tie, *(_deltas(np.flatnonzero(h)) if h.any() else None for h in hit)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["__key", "__tie2", "places", "other"])

    return rows


def _by_document(places: DataFrame) -> DataFrame:
    return stored(places.groupBy("__key", "__tie2").agg(F.collect_set("places").alias("hits")))


def _resolved(sent: DataFrame, resolve, n_buckets: int) -> DataFrame:
    return sent.repartition(n_buckets, "kind", "key").groupBy("kind", "key").applyInPandas(resolve, _SENT).groupBy("batch")


def _compared(texts: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(id, tie, places of windows with equal words, of others) of the documents with runs."""
    wanted = runs.groupBy(F.col("id0").alias("__key"), F.col("tie0").alias("__tie2")).agg(F.collect_set("page").alias("pages"))
    earlier, _ = _with_places(texts, stored(wanted))
    pages = earlier.drop("doc_id").mapInArrow(_pages(window), "id0 long, tie0 long, page int, words binary")
    pages = stored(pages.groupBy("id0", "tie0", "page").agg(F.first("words").alias("words")))
    checks = runs.drop("places").join(pages, ["id0", "tie0", "page"]).groupBy("__key", "__tie2")
    checks = stored(checks.agg(F.collect_list(F.struct("at", "n", "off", "words")).alias("checks")))
    some, _ = _with_places(texts, checks)
    return stored(some.drop("doc_id").mapInArrow(_compare(window), "__key long, __tie2 long, places binary, other binary"))


def _marked(texts: DataFrame, hits: DataFrame, window: int, n_buckets: int, bits: int) -> DataFrame:
    """(id, tie, parts of places) of all windows that start earlier too. Rounds after the
    first take the windows that were paired with other words."""
    found, around = [], True
    while True:
        some, _ = _with_places(texts, hits)
        sent = some.drop("doc_id").mapInArrow(_windows(window, n_buckets, bits, around), _SENT)
        late = stored(_resolved(sent, _later, n_buckets).applyInPandas(_to_runs, _FOUND))
        compared = _compared(texts, late.where("places IS NULL"), window)
        found += [x.where("places IS NOT NULL").select("__key", "__tie2", "places") for x in (late, compared)]
        left = compared.where("other IS NOT NULL").select("__key", "__tie2", F.col("other").alias("places"))
        if left.isEmpty():
            return _by_document(union_all(found))
        hits, bits, around = _by_document(left), 2 * bits, False


def _with_places(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with places, those without). Texts are only shuffled for the former,
    unless the ids are too many to be broadcast."""
    same = (F.col("__id") == F.col("__key")) & (F.col("__tie") == F.col("__tie2"))
    ids = places.select("__key", "__tie2")
    ids = F.broadcast(ids) if places.count() <= MOST_BROADCAST else ids
    some = docs.join(ids, same, "left_semi").join(places.hint("merge"), same).drop("__key", "__tie2")
    return some, docs.join(ids, same, "left_anti")


def without_repeats(docs: DataFrame, window: int = 20, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each text less the words covered by a window
    that also starts earlier, the others joined by one space. ``bits`` is the size of the
    hashes that find what is compared; the result does not depend on it."""
    assert window >= 2 and window % 2 == 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__tie"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = int(max(24, total // BUCKET_BYTES + 1))
    hits = _resolved(texts.drop("doc_id").mapInArrow(_probes(window, n_buckets, bits), _SENT), _hits, n_buckets)
    hits = _by_document(hits.applyInPandas(_to_docs, "__key long, __tie2 long, places binary"))
    some, others = _with_places(texts, _marked(texts, hits, window, n_buckets, bits))

    def cut(batches):
        for whole in batches:
            for piece in pieces_of(whole):
                has = "hits" in piece.schema.names
                out = []
                for k, t in enumerate(piece.column("text").cast(pa.binary()).to_pylist()):
                    words = (t or b"").split()
                    gone = 0
                    if has:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for p in piece.column("hits")[k].as_py():
                            at = _places(p)
                            edge[at] += 1
                            edge[at + window] -= 1
                        left = np.cumsum(edge)[:-1] == 0
                        gone = len(words) - int(left.sum())
                        kept = [words[i] for i in np.flatnonzero(left)]
                    else:
                        kept = words
                    out.append((len(words), gone, b" ".join(kept).decode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    schema = "doc_id long, n_words long, n_removed long, text string"
    return some.select("doc_id", "text", "hits").mapInArrow(cut, schema).unionByName(others.select("doc_id", "text").mapInArrow(cut, schema))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT x.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE gone.i IS NULL) AS kept
      FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
