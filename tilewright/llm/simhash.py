"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit of the 64-bit shingle hashes, set where over half
of them set it. Two fingerprints within ``radius`` bits share a variant within half the
radius of both, and any two that share a variant are within the radius. So every
distinct fingerprint emits its variants, variants meet by a shuffle, and what meets is
verified and linked; the components of the links are the groups.

What is shuffled is the variant's leading bits with the fingerprint; the other bits of
the variants are generated where they meet, so a fingerprint is sent to
1 + b + b(b-1)/2 buckets instead of 2,081 rows. b follows the number of distinct
fingerprints; buckets that hold far more variants than others (groups of near copies)
get more leading bits, and a task works through its bucket in parts of bounded size.
Equal fingerprints are merged before; of the links in a part only a spanning forest is
emitted, so no group is written out as all its pairs.

Defined results: a null text counts as an empty one; a text without words has the
fingerprint zero and is linked like any other; a null id is kept and never names a
group (component_id is null where all ids of a group are null); repeated rows get equal
results. A bit that exactly half the hashes set is 0, and fingerprints of exactly
``radius`` differing bits are linked. Texts of any length are read whole, in bounded
parts. An empty table gives an empty one. Only the id and the text are read, so other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import connected_components, pieces_of, stored

#: Variants that a bucket should hold, and that a task holds at a time.
BUCKET, PART = 1 << 21, 1 << 22


def fingerprint(data: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text (UTF-8), as an unsigned number."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - width]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def rows(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                fps = np.array([fingerprint(t or b"", width, seed) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, fp long")


def _masks(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ``bits`` bits with at most ``most`` (0 to 2) set, and how many are set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out, cost = [np.zeros(1, np.uint64)], [0]
    if most >= 1:
        out.append(one)
        cost += [1] * bits
    if most >= 2:
        i, j = np.triu_indices(bits, 1)
        out.append(one[i] | one[j])
        cost += [2] * len(i)
    return np.concatenate(out), np.array(cost, np.int64)


def _variants(bits: int, left: np.ndarray) -> np.ndarray:
    """How many variants of ``bits`` free bits there are with so many changes left."""
    return np.where(left == 2, 1 + bits + bits * (bits - 1) // 2, np.where(left == 1, 1 + bits, 1))


def _addressed(fps: np.ndarray, half: int, lead: int, deeper: dict[int, int], bits: int = 64):
    """(bucket, depth, index of the fingerprint, changes left): a row for each bucket
    that holds some variant. A bucket is the leading ``depth`` bits."""
    masks, cost = _masks(lead, half)
    heads = (fps >> np.uint64(bits - lead))[:, None] ^ masks[None, :]
    index = np.repeat(np.arange(len(fps)), len(masks))
    bucket, left = heads.ravel(), np.tile(half - cost, len(fps))
    if not deeper:
        return [(bucket, lead, index, left)]
    keys = np.array(sorted(deeper), np.uint64)
    more = np.array([deeper[int(k)] for k in keys], np.int64)
    at = np.minimum(np.searchsorted(keys, bucket), len(keys) - 1)
    extra = np.where(keys[at] == bucket, more[at], 0)
    out = []
    for bits_more in np.unique(extra).tolist():
        if not bits_more:
            own = extra == 0
            out.append((bucket[own], lead, index[own], left[own]))
            continue
        for k in range(half + 1):
            own = np.flatnonzero((extra == bits_more) & (left == k))
            if len(own):
                masks, cost = _masks(bits_more, k)
                next_bits = (fps[index[own]] >> np.uint64(bits - lead - bits_more)) & np.uint64((1 << bits_more) - 1)
                sub = (next_bits[:, None] ^ masks[None, :]) | (bucket[own] << np.uint64(bits_more))[:, None]
                out.append((sub.ravel(), lead + bits_more, np.repeat(index[own], len(masks)), np.tile(k - cost, len(own))))
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _meetings(fps: np.ndarray, left: np.ndarray, depth: int, part: int, bits: int = 64):
    """(variant, index of the fingerprint), sorted by the variant, of all variants in the
    bucket, in parts of bounded size; no variant is in two parts."""
    free = bits - depth
    if len(fps) < 2:
        return
    if _variants(free, left).sum() > part and free:
        bit = (fps >> np.uint64(free - 1)) & np.uint64(1)
        for v in (0, 1):
            now = left - (bit != v)
            own = np.flatnonzero(now >= 0)
            for key, owner in _meetings(fps[own], now[own], depth + 1, part, bits):
                yield key, own[owner]
        return
    keys, owners = [], []
    tails = fps & np.uint64((1 << free) - 1)
    for k in range(3):
        own = np.flatnonzero(left == k)
        if len(own):
            masks, _ = _masks(free, k)
            keys.append((tails[own][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    del keys, owners
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order].astype(np.int64)
    # nothing but the part itself is held while it is compared
    del order
    yield key, owner


def _met(fps: np.ndarray, left: np.ndarray, depth: int, radius: int, part: int):
    """Pairs of indices that share a variant in the bucket, in parts of bounded size: each
    fingerprint with the one before it at the variant. All at one variant are within the
    radius, so these pairs give all components."""
    for key, owner in _meetings(fps, left, depth, part):
        same = np.flatnonzero(key[1:] == key[:-1])
        a, b = owner[same], owner[same + 1]
        pairs = np.unique(np.minimum(a, b) * len(fps) + np.maximum(a, b))
        a, b = pairs // len(fps), pairs % len(fps)
        near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= radius)
        yield a[near], b[near]


def links(fps: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` at most ``radius`` (0 to 5) bits
    apart, enough to give all components; every link is verified."""
    half = radius // 2
    assert 0 <= half <= 2, "a radius over 5 has too many variants"
    if radius % 2:
        raise ValueError("an even radius is needed: two halves make it up")
    fps = fps.select("fp")
    n = fps.count() if n is None else n
    lead = int(min(20, max(4, np.ceil(np.log2(max(1, n * int(_variants(64, np.array(half))) / BUCKET))))))

    def weigh(batches):
        total = np.zeros(1 << lead)
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(values), 20_000):
                bucket, depth, _, left = _addressed(values[at : at + 20_000], half, lead, {})[0]
                total += np.bincount(bucket.astype(np.int64), weights=_variants(64 - depth, left), minlength=1 << lead)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "w"])

    hot = fps.mapInArrow(weigh, "bucket long, w double").groupBy("bucket").agg(F.sum("w").alias("w")).where(F.col("w") > 3 * BUCKET).collect()
    # a third of all buckets at most, so under 1 << lead numbers reach the driver
    deeper = {r.bucket: int(min(12, np.ceil(np.log2(r.w / BUCKET)))) for r in hot}

    def spread(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(values), 20_000):
                part = values[at : at + 20_000]
                for bucket, depth, index, _ in _addressed(part, half, lead, deeper):
                    for k in range(0, len(bucket), 100_000):
                        b = bucket[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(b.view(np.int64)), pa.array(np.full(len(b), depth, np.int32)), pa.array(part[index[k : k + 100_000]].view(np.int64))], ["bucket", "depth", "fp"])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, depth = np.uint64(key[0]), int(key[1])
        own = np.sort(rows["fp"].to_numpy().view(np.uint64))
        left = half - np.bitwise_count((own >> np.uint64(64 - depth)) ^ bucket).astype(np.int64)
        label = np.arange(len(own))
        for a, b in _met(own, left, depth, radius, PART):
            label = _forest(len(own), np.concatenate([a, np.arange(len(own))]), np.concatenate([b, label]))
        at = np.flatnonzero(label != np.arange(len(own)))
        # a link to the component's smallest may be longer than the radius; it stands for a chain of verified ones
        return pd.DataFrame({"a": own[at].view(np.int64), "b": own[label[at]].view(np.int64)})

    n_parts = int(max(fps.sparkSession.sparkContext.defaultParallelism * 4, (1 << lead) // 2))
    rows = fps.mapInArrow(spread, "bucket long, depth int, fp long").repartition(n_parts, "bucket", "depth")
    return rows.groupBy("bucket", "depth").applyInPandas(meet, "a long, b long").distinct()


def _components(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """keys (key, least) with ``first``, the smallest ``least`` of the component of their
    key by edges (a, b); ``least`` is a struct, and keys without edges are their own
    component. Nodes are named by ``least`` and their key, so a component's root is what
    is looked for, and nothing is grouped or joined by component."""
    node = F.struct("least", "key").alias("node")
    nodes = keys.select("key", node)
    ends = edges.join(nodes.select(F.col("key").alias("a"), F.col("node").alias("from")), "a").join(nodes.select(F.col("key").alias("b"), F.col("node").alias("to")), "b")
    roots = connected_components(ends.select(F.col("from").alias("a"), F.col("to").alias("b")))
    roots = roots.select(F.col("node.key").alias("key"), F.col("root.least").alias("first"))
    return keys.join(roots, "key", "left").select("key", "least", F.coalesce("first", "least").alias("first"))


def _named(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """rows with component_id, the smallest doc_id of the group of their key; edges link keys.
    Keys of over a thousandth of all rows, a thousand at most, meet them by a broadcast."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    keys = stored(rows.groupBy(F.col(key).alias("key")).agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("times")))
    total = keys.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    named = stored(_components(keys.drop("times"), edges).select("key", F.col("first.id").alias("component_id")).join(keys.select("key", "times"), "key"))
    named = named.withColumnRenamed("key", key)
    often = F.broadcast(named.where(F.col("times") * 1000 > total).drop("times"))
    rest = rows.join(often.select(key), key, "left_anti").join(named.where(F.col("times") * 1000 <= total).drop("times"), key)
    return rows.join(often, key).unionByName(rest)


def components(rows: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp)."""
    rows = stored(rows.select("doc_id", "fp"))
    fps = stored(rows.select("fp").distinct())
    return _named(rows, "fp", links(fps, radius)).select("doc_id", "fp", "component_id")


# -- similarity by wide fingerprints ------------------------------------------------

#: Bits of a wide fingerprint, bits of each part of it that is a key of its own, and how
#: many bits of all may differ in a candidate: 0.8 of common five-word shingles change 38 on
#: average (48 in texts of a few words), with a deviation of 6; unrelated texts differ in 128
#: with a deviation of 8.
WIDE, KEY, APART = 256, 32, 72
#: The least similarity, as a fraction; bytes of shingles that a task verifies at a time.
SIMILAR, BLOCK_BYTES = (4, 5), 16 << 20
#: Fingerprints of a bucket over which it is cut into blocks, each two of which are a task.
HOT = 1 << 18
#: Fingerprints at a variant that are compared together; variants of keys that a task holds at
#: a time and pairs that it compares at a time, about 100 and 35 bytes each.
FEW, HELD, PAIRS = 64, 1 << 20, 1 << 18


def _shingles(data: bytes, width: int) -> np.ndarray:
    """The hashes of the distinct shingles of a text, sorted; a text of fewer words is one shingle."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    k = min(width, n)
    starts = np.concatenate([[0], ends[: n - k]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64))


def _widened(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of WIDE bits of distinct shingles, as four numbers."""
    out = np.zeros(WIDE // 64, np.uint64)
    for w in range(WIDE // 64 if len(hashes) else 0):
        own = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (w + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        own = (own ^ (own >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        own ^= own >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 16):
            part = own[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * counts > len(own), bitorder="little").view("<u8")[0]
    return out


def _wide(data: bytes, width: int) -> np.ndarray:
    """A fingerprint of WIDE bits, as four numbers."""
    return _widened(_shingles(data, width))


def _near(sets: list[np.ndarray], least: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Links (a, b) between sets of a Jaccard similarity of ``least`` or more, enough to give
    the components of all such pairs. A set is compared with those outside its component
    that hold one of its rarest elements: sets as similar as that share some of them."""
    top, bottom = least
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    ends = np.cumsum(often)
    outside, marked = np.ones(len(sets), bool), np.zeros(len(often), bool)
    n_outside, out = len(sets), []
    for seed in range(len(sets)):
        if not outside[seed]:
            continue
        outside[seed] = False
        n_outside -= 1
        ahead = [seed]
        while ahead and n_outside:
            x = ahead.pop()
            own = place[starts[x] : starts[x] + sizes[x]]
            rare = own[np.argsort(often[own], kind="stable")[: len(own) + 1 - -(-top * len(own) // bottom)]].tolist()
            if not rare:
                continue
            others = np.unique(np.concatenate([holders[ends[r] - often[r] : ends[r]] for r in rare]))
            others = others[outside[others]]
            others = others[(bottom * np.minimum(sizes[others], len(own)) >= top * np.maximum(sizes[others], len(own)))]
            if not len(others):
                continue
            marked[own] = True
            common = np.array([np.count_nonzero(marked[place[starts[y] : starts[y] + sizes[y]]]) for y in others.tolist()])
            marked[own] = False
            hit = others[bottom * common >= top * (len(own) + sizes[others] - common)]
            outside[hit] = False
            n_outside -= len(hit)
            ahead += hit.tolist()
            out.append(np.column_stack([np.full(len(hit), x), hit]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _nodes(wide: np.ndarray) -> np.ndarray:
    """One long for each wide fingerprint."""
    h = np.zeros(len(wide), np.uint64)
    for w in range(wide.shape[1]):
        h = (h ^ wide[:, w]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def similar(docs: DataFrame, width: int = 5, apart: int = APART) -> DataFrame:
    """(doc_id, component_id) of every row; see _grouped()."""
    rows, links = _grouped(docs, width, apart)
    return _named(rows.select("doc_id", "node"), "node", links).select("doc_id", "component_id")


def surplus(docs: DataFrame, width: int = 5, apart: int = APART) -> DataFrame:
    """(doc_id, text_key, once): the rows that are not the one of their group, by their id
    and the hash of their text; ``once`` are rows of which one must stay, as the group's
    row is there several times. The one has the smallest id, then the smallest text_key;
    a null id comes last. Components are found by the text, so an id may have several texts."""
    rows, links = _grouped(docs, width, apart)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    ranked = stored(rows.groupBy("node", rank.alias("rank")).agg(F.count(F.lit(1)).alias("times")))
    keys = stored(ranked.groupBy(F.col("node").alias("key")).agg(F.min("rank").alias("least")))
    # each group's row is looked up by its own rank, so no node with many rows is a join key
    first = _components(keys, links).select(F.col("first").alias("rank"), F.lit(True).alias("once")).distinct()
    judged = ranked.join(first, "rank", "left").select("rank.doc_id", "rank.text_key", F.coalesce("once", F.lit(False)).alias("once"), "times")
    return stored(judged.where("not once or times > 1").select("doc_id", "text_key", "once"))


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _grouped(docs: DataFrame, width: int, apart: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node) of every row and (a, b), links between nodes that give all
    groups of texts that have 0.8 or more of their distinct ``width``-word shingles in
    common, by a chain of such pairs.

    One 64-bit fingerprint within four bits only finds texts that are nearly equal. So
    each text has a fingerprint of 256 bits, cut into eight keys of 32; each key is ball
    hashed with radius four (at 0.8, a pair meets in one of the eight with 0.99), and
    whatever meets and is within ``apart`` of all bits is a candidate. Every component of
    candidates is verified by the shingles themselves, as 64-bit hashes: they are made
    again, only for texts that have a candidate. Equal sets of shingles are merged before."""
    half, bits = 2, KEY

    def made(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                sets = [_shingles(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                wide = np.array([_widened(x) for x in sets]).reshape(-1, WIDE // 64)
                data = pa.array([w.tobytes() for w in wide], pa.binary())
                nodes = pa.array([_name(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), nodes, pa.array([len(x) for x in sets], pa.int64()), pa.array(_nodes(wide)), data], ["doc_id", "text_key", "node", "n", "fp", "wide"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", text_key())
    rows = stored(texts.mapInArrow(made, "doc_id long, text_key long, node long, n long, fp long, wide binary"))
    fps = stored(rows.select("wide").distinct())
    n = fps.count()
    lead = int(min(16, max(2, np.ceil(np.log2(max(1, n * int(_variants(bits, np.array(half))) / (4 * BUCKET)))))))

    def keys(wide: np.ndarray):
        for t in range(WIDE // bits):
            yield t, (wide[:, t * bits // 64] >> np.uint64(t * bits % 64)) & np.uint64((1 << bits) - 1)

    def in_buckets(wide: np.ndarray):
        """(bucket of a key, indices of the fingerprints that send it a variant)."""
        for t, key in keys(wide):
            bucket, _, index, _ = _addressed(key, half, lead, {}, bits)[0]
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange((1 << lead) + 1).astype(np.uint64))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                yield t << lead | b, index[order[ends[b] : ends[b + 1]]]

    def wides(batch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE // 64)

    def weigh(batches):
        total = np.zeros(WIDE // bits << lead, np.int64)
        for batch in batches:
            for b, own in in_buckets(wides(batch)):
                total[b] += len(own)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    blocks: dict[int, int] = {}
    if n > HOT:
        weights = fps.mapInArrow(weigh, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        blocks = {r.bucket: -(-r.n // HOT) for r in weights.where(F.col("n") > HOT).collect()}

    def spread(batches):
        for batch in batches:
            wide = wides(batch)
            names = _nodes(wide).view(np.uint64)
            for b, own in in_buckets(wide):
                n_blocks = blocks.get(b, 1)
                part = (names[own] % np.uint64(n_blocks)).astype(np.int64)
                for k in np.unique(part).tolist():
                    mine = own[part == k]
                    for other in [x for x in range(n_blocks) if x != k] or [k]:
                        for at in range(0, len(mine), 20_000):
                            data = wide[mine[at : at + 20_000]].tobytes()
                            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([min(k, other)], pa.int32()), pa.array([max(k, other)], pa.int32()), pa.array([data], pa.binary())], ["bucket", "i", "j", "data"])

    def meet(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        t, bucket = key[0] >> lead, np.uint64(key[0] & ((1 << lead) - 1))
        wide = np.concatenate([np.frombuffer(d, np.uint64) for d in got["data"]]).reshape(-1, WIDE // 64)
        own = next(k for s, k in keys(wide) if s == t)
        left = half - np.bitwise_count((own >> np.uint64(bits - lead)) ^ bucket).astype(np.int64)
        label, tree, seen = np.arange(len(own)), [], set()
        for variant, owner in _meetings(own, left, lead, HELD, bits):
            label = _linked(wide, variant, owner, label, apart, tree, seen)
        tree = np.concatenate(tree) if tree else np.zeros((0, 2), np.int64)
        names = _nodes(wide)
        return pd.DataFrame({"a": names[tree[:, 0]], "b": names[tree[:, 1]]})

    n_parts = int(max(docs.sparkSession.sparkContext.defaultParallelism * 4, (WIDE // bits << lead) // 2))
    sent = fps.mapInArrow(spread, "bucket long, i int, j int, data binary").repartition(n_parts, "bucket", "i", "j")
    edges = sent.groupBy("bucket", "i", "j").applyInPandas(meet, "a long, b long").distinct()
    return rows.select("doc_id", "text_key", "node"), _verified(texts, rows, connected_components(edges), width)


def _name(hashes: np.ndarray) -> int:
    """One long for a set of shingles."""
    name = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)
    return name - (1 << 64) if name >> 63 else name


def _verified(texts: DataFrame, rows: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """(a, b): links between nodes in one component of candidates whose shingles are similar,
    enough to give all components. Small components share tasks; one of over BLOCK_BYTES
    is cut into blocks, and each two blocks are a task."""
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("text_key").alias("text_key"), F.first("n").alias("n"))
    nodes = stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("node", "text_key", "n", F.coalesce("root", "fp").alias("root")))
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.sum(8 * F.col("n")).alias("bytes")).where("nodes > 1")
    parts = F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")
    sizes = stored(sizes.select("root", "nodes", F.greatest(parts, F.lit(1)).alias("parts")))
    # components of over a thousandth of all nodes, a thousand at most, meet them by a broadcast
    n_nodes = nodes.count()
    often = F.broadcast(sizes.where(F.col("nodes") * 1000 > n_nodes))
    rest = nodes.join(often.select("root"), "root", "left_anti").join(sizes.where(F.col("nodes") * 1000 <= n_nodes), "root")
    asked = stored(nodes.join(often, "root").unionByName(rest).select("text_key", "node", "n", "root", "parts"))
    total = asked.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(8 * F.col("n")), F.lit(0)).alias("bytes")).first()
    tasks = int(max(rows.sparkSession.sparkContext.defaultParallelism * 4, -(-total.bytes // BLOCK_BYTES)))
    asked = asked.drop("n")
    found = texts.select("text_key", "text").join(F.broadcast(asked) if total.rows <= 1_000_000 else asked, "text_key")
    once = found.groupBy("text_key", "node", "root", "parts").agg(F.first("text").alias("text"))

    def sets(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                for text, node, root, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("node", "root", "parts")), strict=True):
                    data, own = _shingles(text, width).tobytes(), node % n
                    places = [(min(own, k), max(own, k)) for k in range(n) if k != own] or [(-1, -1)]
                    for i, j in places:
                        yield root % tasks if n == 1 else root, i, j, root, node, data

    def sent(batches):
        names, types = ["task", "i", "j", "root", "node", "data"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        held, size = [], 0
        for row in sets(batches):
            held.append(row)
            size += len(row[-1]) + 64
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def verify(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in got.groupby("root", sort=False):
            names = own["node"].to_numpy()
            out.append(names[_near([np.frombuffer(d, np.uint64) for d in own["data"]])])
        links = np.concatenate(out)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    moved = once.mapInArrow(sent, "task long, i int, j int, root long, node long, data binary").repartition(tasks, "task", "i", "j")
    return moved.groupBy("task", "i", "j").applyInPandas(verify, "a long, b long")


def _linked(wide: np.ndarray, variant: np.ndarray, owner: np.ndarray, label: np.ndarray, apart: int, tree: list, seen: set) -> np.ndarray:
    """The components ``label``, joined by all pairs that share a variant and are at most
    ``apart`` bits apart; the links that join them go to ``tree``. Only pairs that are in
    one component already are left out, so the order of the rows makes no difference. A
    crowd of equal keys meets at every variant and is compared once: ``seen`` has those."""

    def join(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
        fresh = label[a] != label[b]
        pairs = np.unique(np.minimum(a[fresh], b[fresh]) * len(wide) + np.maximum(a[fresh], b[fresh]))
        a, b = pairs // len(wide), pairs % len(wide)
        near = np.bitwise_count(wide[a] ^ wide[b]).sum(1) <= apart
        a, b = a[near], b[near]
        if not len(a):
            return label
        kept = _spanning(label, a, b)
        tree.append(np.column_stack([a[kept], b[kept]]))
        return _forest(len(wide), np.concatenate([a, np.arange(len(wide))]), np.concatenate([b, label]))

    starts = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    size = np.diff(np.append(starts, len(variant)))

    def mixed(owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of owners, one variant after another, those at variants that have several components."""
        if not len(size):
            return owner, size
        at, starts = label[owner], np.cumsum(size) - size
        some = np.minimum.reduceat(at, starts) != np.maximum.reduceat(at, starts)
        return owner[np.repeat(some, size)], size[some]

    def cut(n: np.ndarray):
        """Slices of rows of n pairs each, with about PAIRS pairs."""
        return (p for p in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1) if len(p))

    owner, size = mixed(owner[np.repeat(size > 1, size)], size[size > 1])
    # the first against all joins most groups of near copies
    starts = np.cumsum(size) - size
    for part in cut(size):
        n, first = size[part] - 1, starts[part]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        label = join(owner[np.repeat(first, n)], owner[np.repeat(first, n) + 1 + step], label)
    owner, size = mixed(owner[np.repeat(size > 2, size)], size[size > 2])
    starts = np.cumsum(size) - size
    for m in np.unique(size[size <= FEW]).tolist():
        # all pairs but those with the first, which met all
        i, j = np.triu_indices(m - 1, 1)
        own = starts[size == m][:, None] + 1
        for part in cut(np.full(len(own), len(i))):
            label = join(owner[own[part] + i].ravel(), owner[own[part] + j].ravel(), label)
    many = np.flatnonzero(size > FEW)
    for r in many[np.argsort(-size[many], kind="stable")].tolist():
        members = np.sort(owner[starts[r] : starts[r] + size[r]])
        crowd = xxhash.xxh3_128_digest(members.tobytes())
        if crowd in seen:
            continue
        seen.add(crowd)
        value, count = np.unique(label[members], return_counts=True)
        # two of the largest component need no test, so each other one meets all
        rest = members[label[members] != value[count.argmax()]]
        step = max(1, PAIRS // len(members))
        for k in range(0, len(rest), step):
            own = rest[k : k + step]
            label = join(np.repeat(own, len(members)), np.tile(members, len(own)), label)
    return label


def _spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links make up a forest over the components ``label``."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(k)
    return np.array(out, np.int64)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    out = components(fingerprints(docs))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
