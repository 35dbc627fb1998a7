import random

import numpy as np
import pytest

import corpus_pipeline
from tilewright.llm import simhash


@pytest.mark.parametrize("few", [64, 2])
@pytest.mark.parametrize("part", [1 << 22, 700])
def test_all_that_meet_are_compared(few, part, monkeypatch):
    """Near copies of 256 bits with others sorted between them at every variant."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(3)
    key = np.uint64(0x12345678)
    groups = rng.integers(0, 1 << 63, (4, simhash.WIDE // 64)).astype(np.uint64)
    wide = np.stack([groups[k % 4] for k in range(40)])
    for row in wide:
        for bit in rng.integers(32, 256, 6).tolist():
            row[bit // 64] ^= np.uint64(1 << bit % 64)
    wide[:, 0] = (wide[:, 0] & ~np.uint64(0xFFFFFFFF)) | key
    fps, label, tree, seen = np.full(40, key), np.arange(40), [], set()
    for variant, owner in simhash._meetings(fps, np.full(40, 2), 0, part, 32):
        label = simhash._linked(wide, variant, owner, label, 52, tree, seen)
    assert label.tolist() == [k % 4 for k in range(40)]
    links = np.concatenate(tree)
    assert len(links) == 36 and (np.bitwise_count(wide[links[:, 0]] ^ wide[links[:, 1]]).sum(1) <= 52).all()


def test_crowd_at_one_key():
    """1,500 unrelated pairs of near copies that have one key: each pair is found."""
    rng = np.random.default_rng(8)
    wide = np.repeat(rng.integers(0, 1 << 63, (1500, simhash.WIDE // 64)).astype(np.uint64), 2, 0)
    wide[1::2, 1] ^= np.uint64(0xFF)
    wide[:, 0] = (wide[:, 0] & ~np.uint64(0xFFFFFFFF)) | np.uint64(0x12345678)
    order = rng.permutation(3000)
    fps, label, tree, seen = np.full(3000, 0x12345678, np.uint64), np.arange(3000), [], set()
    for variant, owner in simhash._meetings(fps, np.full(3000, 2), 0, 1 << 22, 32):
        label = simhash._linked(wide[order], variant, owner, label, 52, tree, seen)
    assert len(set(label.tolist())) == 1500 and {frozenset((order[label == k] // 2).tolist()) for k in set(label.tolist())} == {frozenset([k]) for k in range(1500)}


def jaccard(a, b):
    a, b = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_links_are_verified_by_shingles(spark, block, monkeypatch):
    """Texts at 0.7 stay apart though their fingerprints are close, repeated passages count
    once, and texts of one set of shingles are one."""
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(40):
        base = [word() for _ in range(300)]
        other = list(base)
        # a changed tail of n words takes n shingles of 296
        n = 52 if k % 2 else 30
        other[-n:] = [word() for _ in range(n)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    passage = " ".join(word() for _ in range(40))
    rows += [(100 + k, " ".join([passage] * 10 + [word() for _ in range(120)])) for k in range(2)]
    cycle = [word() for _ in range(6)]
    rows += [(110, " ".join(cycle * 4)), (111, " ".join(cycle * 9))]
    texts = dict(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(40):
        same = jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8
        assert same == (k % 2 == 0) and got[2 * k] == 2 * k and got[2 * k + 1] == (2 * k if same else 2 * k + 1)
    assert (got[100], got[101], got[110], got[111]) == (100, 101, 110, 110)


def test_near_sets_by_hand():
    rng = np.random.default_rng(6)
    for blocks in range(30):
        base = rng.integers(0, 1 << 60, (3, 60))
        sets = []
        for k in range(40):
            own = base[k % 3].copy()
            n = int(rng.integers(0, 14))
            own[rng.choice(60, n, False)] = rng.integers(0, 1 << 60, n)
            sets.append(np.unique(own[: int(rng.integers(50, 61))]).astype(np.uint64))
        pairs = [(a, b) for a in range(40) for b in range(a) if 5 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (len(sets[a]) + len(sets[b]) - c)]
        links = simhash._near(sets)
        assert {(max(a, b), min(a, b)) for a, b in links.tolist()} <= set(pairs)
        label = [simhash._forest(40, *(np.array(x, np.int64).reshape(-1, 2).T)) for x in (pairs, links)]
        assert (label[0] == label[1]).all()


def test_one_row_of_each_group_stays(spark):
    """Ids repeated over different texts, repeated rows and null ids."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(50)) for x in "abcd")
    rows = [(5, a), (9, a), (5, b), (2, b), (7, c), (7, c), (None, c), (None, d), (None, d), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, __id int, __key int, once int")
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(5, a), (2, b), (7, c), (None, d), (4, "")], key=str)


def groups_by_hand(texts):
    """The component of each text by all pairs of Jaccard 0.8 or more, and those pairs."""
    sets = [set(zip(*(w[k:] for k in range(5)))) if len(w := (t or "").lower().encode().split()) >= 5 else {tuple(w)} - {()} for t in texts]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    common = {}
    for own in holders.values():
        for b in range(len(own)):
            for a in range(b):
                common[own[a], own[b]] = common.get((own[a], own[b]), 0) + 1
    pairs = [(a, b) for (a, b), c in common.items() if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c)]
    empty = [k for k, s in enumerate(sets) if not s]
    pairs += list(zip(empty, empty[1:], strict=False))
    return simhash._forest(len(texts), *np.array(pairs, np.int64).reshape(-1, 2).T), pairs


@pytest.mark.parametrize("hot", [1 << 18, 150])
def test_groups_of_documents(spark, hot, monkeypatch):
    """All documents of a table against all pairs: no false group, and 0.9 of the pairs at least.
    With a low bound every bucket is cut into blocks."""
    monkeypatch.setattr(simhash, "HOT", hot)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    label, pairs = groups_by_hand([t for _, t in rows])
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    name = [got[i] for i, _ in rows]
    assert len(pairs) > 50 and sum(name[a] == name[b] for a, b in pairs) >= 0.9 * len(pairs)
    for k, (i, _) in enumerate(rows):
        assert label[k] == label[[x for x, _ in rows].index(got[i])]


def test_hot_buckets_are_split(spark, monkeypatch):
    """Fingerprints around one, more buckets to split than any fixed number."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    fps = np.unique(np.array([base[k % 3] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for k in range(300)], np.uint64))
    monkeypatch.setattr(simhash, "BUCKET", 1 << 9)
    links = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 4).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    a, b = np.nonzero(np.triu(near, 1))
    want = simhash._forest(len(fps), a, b)
    got = simhash._forest(len(fps), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert (want == got).all() and len(set(want.tolist())) < len(fps)
