"""Embedding near-dedup: hierarchical navigable small-world graphs per shard.

Only vectors with equal labels are compared. Equal vectors are merged first, and counted
with their number. Each label's vectors are dealt to shards of bounded size and a graph
is built for each shard; every vector queries every shard of its label, in batches that
travel to the graphs. A query's beam finds its first links, and from these the graph is
walked on for as long as nodes are links. An audit compares some queries of each batch
(those with an id divisible by 100, and 64 more) with brute force, and beams of a batch
that misses a link are widened until it misses none. What is found is verified by cosine
in double precision. A task returns counts and a spanning forest of its links, never all
pairs; the forests' components are the groups.

A label's work grows with the number of its shards times that of its vectors, as every
shard is queried. A graph is sent once for each ``TOGETHER`` shards that query it.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, vectors with a null label and rows with a null vec_id link with nothing;
vectors of different lengths are not compared; vectors keep the type of their column,
and double ones of any finite size are compared. Repeated rows are equal vectors, each
with its links to the others; a vec_id with several vectors has a row for each, with
its own links, and ``kept`` goes by the id. A cosine of exactly ``least`` is a link. An
empty table gives an empty one. Only vec_id, embedding and label are read, so other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import drop_stored, stored
from tilewright.llm.simhash import _components, _forest

#: Vectors of a shard at most, bytes of its vectors at most, links of a node on the lowest
#: layer, entries of a first beam, and query shards that meet one copy of a graph.
SHARD, SHARD_BYTES, LINKS, BEAM, TOGETHER = 8192, 8 << 20, 16, 24, 16
#: Cosines in single precision may be off by so much.
SLACK = 1e-4


class Graph:
    """A navigable small-world graph over unit vectors. The lowest layer has two more links
    for each node, its first child and next sibling in the tree of the nodes' nearest
    earlier ones, so that every node can be reached from the first."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.v, self.layers, self.entry = vectors, layers, entry
        self.asked, self.audit = 0, None

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, beam: int = 24, seed: int = 11) -> Graph:
        n = len(vectors)
        level = np.minimum(4, (-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int))
        level[0] = level.max()
        g = cls(vectors, [np.full((n, links if k else 2 * links), -1, np.int32) for k in range(level.max() + 1)], 0)
        tree = np.full((n, 2), -1, np.int32)
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + min(192, max(8, done))))
            entry = np.zeros((len(new), 1), np.int64)
            for k in range(len(g.layers) - 1, -1, -1):
                here = level[new] >= k
                found, sims = g._search(vectors[new], entry, beam if here.any() else 4, k)
                entry = found[:, :4]
                own = np.flatnonzero(here)
                if len(own):
                    g._connect(new[own], found[own], sims[own], k)
            for x, parent in zip(new.tolist(), found[:, 0].tolist(), strict=True):
                tree[x, 1], tree[parent, 0] = tree[parent, 0], x
            done = int(new[-1]) + 1
        g.layers[0] = np.concatenate([g.layers[0], tree], 1)
        return g

    def _search(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int, at_once: int = 8):
        """Beams (ids, similarities), best first, for many queries at once. Missing: -1."""
        v, links = self.v, self.layers[layer]
        m = len(q)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, len(v) + 1), bool)
        entry = np.where(entry < 0, entry[:, :1], entry)
        entry = np.sort(entry, 1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        k = min(beam, entry.shape[1])
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("akd,ad->ak", v[ids[:, :k]], q), -np.inf)
        open_[:, :k] = ids[:, :k] >= 0
        seen[rows, np.where(ids[:, :k] >= 0, ids[:, :k], len(v))] = True
        live = np.arange(m)
        while len(live):
            best = np.where(open_[live], sims[live], -np.inf)
            pick = np.argpartition(-best, min(at_once, beam) - 1, 1)[:, :at_once] if beam > at_once else np.tile(np.arange(beam), (len(live), 1))
            ok = np.isfinite(np.take_along_axis(best, pick, 1))
            go = ok.any(1)
            live, pick, ok = live[go], pick[go], ok[go]
            if not len(live):
                break
            r = live[:, None]
            near = np.where(ok[:, :, None], links[np.where(ok, ids[r, pick], 0)], -1).reshape(len(live), -1).astype(np.int64)
            open_[r, pick] = False
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near < 0) | seen[r, near]] = -1
            seen[r, np.where(near < 0, len(v), near)] = True
            s = np.full(near.shape, -np.inf, np.float32)
            who, what = np.nonzero(near >= 0)
            s[who, what] = np.einsum("kd,kd->k", v[near[who, what]], q[live[who]])
            all_s = np.concatenate([sims[live], s], 1)
            top = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
            sims[live] = np.take_along_axis(all_s, top, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], near >= 0], 1), top, 1)
        order = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row at most ``most`` of its candidates (best first): those nearer to
        the row's node than to any one chosen before, then the nearest of the rest."""
        n, k = ids.shape
        if k <= most:
            return ids
        vec = self.v[ids]
        chosen = np.zeros((n, k), bool)
        blocked = ids < 0
        for j in range(k):
            take = ~blocked[:, j] & (chosen.sum(1) < most)
            chosen[take, j] = True
            rows = np.flatnonzero(take)
            if len(rows) and j + 1 < k:
                between = np.einsum("akd,ad->ak", vec[rows, j + 1 :], vec[rows, j])
                blocked[rows, j + 1 :] |= between > sims[rows, j + 1 :]
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)
        return np.take_along_axis(ids, np.argsort(rank, 1)[:, :most], 1)

    def _connect(self, new: np.ndarray, found: np.ndarray, sims: np.ndarray, layer: int) -> None:
        links = self.layers[layer]
        most = links.shape[1]
        among = self.v[new] @ self.v[new].T
        np.fill_diagonal(among, -np.inf)
        k = min(16, len(new) - 1)
        if k:
            near = np.argpartition(-among, k - 1, 1)[:, :k]
            found = np.concatenate([found, new[near]], 1)
            sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], 1)
        order = np.argsort(-sims, 1, kind="stable")
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        found[~np.isfinite(sims)] = -1
        chosen = self._diverse(found, sims, most // 2 if most > 8 else most)
        links[new, : chosen.shape[1]] = chosen
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        s = np.einsum("ad,ad->a", self.v[a], self.v[b])
        order = np.lexsort((-s, b))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
        place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        keep = place < most
        a, b, place = a[keep], b[keep], place[keep]
        nodes = np.unique(b)
        more = np.full((len(nodes), most), -1, np.int64)
        more[np.searchsorted(nodes, b), place] = a
        cand = np.concatenate([links[nodes].astype(np.int64), more], 1)
        cand.sort(1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        s = np.where(cand >= 0, np.einsum("akd,ad->ak", self.v[cand], self.v[nodes]), -np.inf)
        order = np.argsort(-s, 1, kind="stable")
        cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
        width = int((cand >= 0).sum(1).max(initial=1))
        pruned = self._diverse(cand[:, :width], s[:, :width], most)
        links[nodes] = -1
        links[nodes, : pruned.shape[1]] = pruned

    def query(self, q: np.ndarray, beam: int):
        """Beams (ids, similarities), best first."""
        self.asked += len(q)
        entry = np.full((len(q), 1), self.entry, np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._search(q, entry, 4, k)[0]
        return self._search(q, np.concatenate([entry, np.zeros((len(q), 1), np.int64)], 1), beam, 0)

    def _walk(self, q: np.ndarray, row: np.ndarray, node: np.ndarray, least: float):
        """(rows of q, nodes) of similarity ``least`` or more that can be reached from those
        given by way of such."""
        n, links = len(self.v), self.layers[0]
        seen = np.zeros(len(q) * n, bool)
        seen[row * n + node] = True
        out, ahead = [], [(row, node)]
        while ahead:
            row, node = ahead.pop()
            out.append((row, node))
            for at in range(0, len(row), 1 << 15):
                near = links[node[at : at + (1 << 15)]]
                place = (row[at : at + (1 << 15), None] * n + near)[near >= 0]
                place = np.unique(place[~seen[place]])
                seen[place] = True
                r, c = place // n, place % n
                hit = np.einsum("kd,kd->k", self.v[c], q[r]) >= least
                if hit.any():
                    ahead.append((r[hit], c[hit]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def above(self, q: np.ndarray, least: float, beam: int = BEAM, block: int = 256):
        """Parts (queries, nodes): the pairs of similarity ``least`` or more that are found."""
        block = max(16, min(block, block * BEAM * 8 // beam))
        for at in range(0, len(q), block):
            part = q[at : at + block]
            ids, sims = self.query(part, min(beam, len(self.v)))
            row, col = np.nonzero((sims >= least) & (ids >= 0))
            row, node = self._walk(part, row, ids[row, col], least)
            yield row + at, node

    def linked(self, q: np.ndarray, least: float, beam: int = BEAM, sample: np.ndarray | None = None, exact=None) -> np.ndarray:
        """A table, queries by nodes: whether a pair is a link. ``sample`` queries are
        compared with all nodes; beams are widened until these miss no link (a beam of all
        nodes sees them all). ``exact``: a test of pairs that follows. self.audit: links of
        the sample, those found by the first beams, and the last beam."""
        sample = np.arange(len(q)) if sample is None else sample
        truth = np.concatenate([q[sample[k : k + 512]] @ self.v.T >= least + SLACK / 2 for k in range(0, len(sample), 512)] or [np.zeros((0, len(self.v)), bool)])
        found, first = np.zeros((len(q), len(self.v)), bool), None
        while True:
            for row, node in self.above(q, least, beam):
                found[row, node] = True
            missed = int((truth & ~found[sample]).sum())
            first = missed if first is None else first
            if not missed or beam >= len(self.v):
                break
            beam *= 2
        self.audit = (int(truth.sum()), int(truth.sum()) - first, beam)
        if exact is not None:
            for at in range(0, len(q), 64):
                row, node = np.nonzero(found[at : at + 64])
                for k in range(0, len(row), 1 << 16):
                    r, c = row[k : k + (1 << 16)] + at, node[k : k + (1 << 16)]
                    found[r, c] = exact(r, c)
        return found

    def audited(self, q: np.ndarray, least: float, beam: int = BEAM):
        """(queries, nodes) of linked(), audited by every fourth query."""
        return np.nonzero(self.linked(q, least, beam, np.arange(0, len(q), 4)))


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors, each times a power of two that brings its largest component near 1."""
    top = np.frexp(np.abs(raw).max(1))[1]
    # in two steps, as the power itself may be beyond the range
    return np.ldexp(np.ldexp(raw, -(top[:, None] // 2)), -(top[:, None] - top[:, None] // 2))


def _unit(raw: np.ndarray) -> np.ndarray:
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def _pack(kind: str):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        raw = np.array(rows["embedding"].tolist(), np.float64)
        g = Graph.build(_unit(_scaled(raw)))
        out = {c: rows[c].to_numpy(np.int64).tobytes() for c in ("rep", "times", "least")}
        return pd.DataFrame([{"label": key[0], "dim": key[1], "shard": key[2], "n_shards": rows["n_shards"].iloc[0], **out, "raw": raw.astype(kind).tobytes(), "layers": [x.tobytes() for x in g.layers], "wide": [x.shape[1] for x in g.layers]}])

    return pack


class _Shard:
    """The vectors of a packed row, and its graph if it has one."""

    def __init__(self, row, kind: str):
        self.reps, self.times, self.least = (np.frombuffer(row[c], np.int64) for c in ("rep", "times", "least"))
        self.raw = _scaled(np.frombuffer(row["raw"], kind).reshape(len(self.reps), -1).astype(np.float64))
        self.norm, self.unit = np.linalg.norm(self.raw, axis=1), _unit(self.raw)
        if row["kind"] == 0:
            self.graph = Graph(self.unit, [np.frombuffer(x, np.int32).reshape(len(self.reps), w) for x, w in zip(row["layers"], row["wide"], strict=True)], 0)

    def sample(self) -> np.ndarray:
        """Ids divisible by 100, and 64 more."""
        n = len(self.reps)
        return np.unique(np.concatenate([np.flatnonzero(self.least % 100 == 0), np.linspace(0, n - 1, min(n, 64)).astype(int)]))


def _parents(label: np.ndarray) -> np.ndarray:
    """For each member of a component another one, by a tree of eight children each, so
    that no member has many; the first has itself."""
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
    first = np.repeat(first, np.diff(np.append(first, len(order))))
    place = np.arange(len(order)) - first
    out = np.empty(len(order), np.int64)
    out[order] = order[first + np.maximum(0, place - 1) // 8]
    return out


def _meet(least: float, kind: str):
    def pairs(q: _Shard, g: _Shard) -> pd.DataFrame:
        exact = lambda a, b: np.einsum("ad,ad->a", q.raw[a], g.raw[b]) / (q.norm[a] * g.norm[b]) >= least
        found = g.graph.linked(q.unit, least - SLACK, sample=q.sample(), exact=exact)
        off = 0 if q is g else len(q.reps)
        if q is g:
            found |= found.T
            np.fill_diagonal(found, False)
        ids = q.reps if q is g else np.concatenate([q.reps, g.reps])
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(q.reps), 256):
            a, b = np.nonzero(found[at : at + 256])
            a, b = a + at, b + off
            n[at : min(at + 256, len(q.reps))] += found[at : at + 256] @ g.times
            if off:
                n[off:] += found[at : at + 256].T @ q.times[at : at + 256]
            label = _forest(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, label]))
        some = np.flatnonzero(n)
        true, first, beam = g.graph.audit
        links = pd.DataFrame({"rep": ids[some], "n": n[some], "other": ids[_parents(label)[some]]}, dtype="Int64")
        return pd.concat([links, pd.DataFrame({"asked": [g.graph.asked], "true": [true], "found": [first], "beam": [beam]}, dtype="Int64")])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = _Shard(rows[rows["kind"] == 0].iloc[0], kind)
        out = [pairs(g, g)] if key[3] == key[2] // TOGETHER else []
        for _, row in rows[rows["kind"] == 1].iterrows():
            out.append(pairs(_Shard(row, kind), g))
            g.graph.asked = 0
        return pd.concat(out)[["rep", "n", "other", "asked", "true", "found", "beam"]] if out else pd.DataFrame([], columns=["rep", "n", "other", "asked", "true", "found", "beam"])

    return meet


_FOUND = "rep long, n long, other long, asked long, true long, found long, beam long"


def _sound(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, embedding, label, rep), where rep is null for what links with nothing, and else
    a number of the label and vector, one for each; and the type of the components."""
    given = dict(vectors.dtypes)["embedding"]
    kind = "float" if given == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").alias("label"))
    sound = F.expr(f"coalesce(vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < {kind}('infinity')) and exists(embedding, x -> x <> 0), false)")
    salt = 0
    while True:
        named = v.withColumn("rep", F.when(sound, F.xxhash64(F.lit(salt), "label", "embedding")))
        kinds = named.where("rep is not null").groupBy("label", "embedding").agg(F.first("rep").alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        if kinds.where("n > 1").isEmpty():
            return named, kind
        salt += 1


def _found(named: DataFrame, kind: str, least: float, shard: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (rep, times, least), and what the graphs found of them."""
    classes = named.where("rep is not null").groupBy("label", "embedding", "rep").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("embedding"))
    classes = stored(classes)
    most = F.greatest(F.lit(1), F.least(F.lit(shard), F.lit(SHARD_BYTES) / (8 * F.col("dim")))).cast("int")
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select("label", "dim", F.ceil(F.col("n") / most).cast("int").alias("n_shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), "n_shards").cast("int"))
    label = dict(classes.dtypes)["label"]
    cores = named.sparkSession.sparkContext.defaultParallelism
    dealt = dealt.repartition(4 * cores, "label", "dim", "shard").groupBy("label", "dim", "shard")
    packed = stored(dealt.applyInPandas(_pack(kind), f"label {label}, dim int, shard int, n_shards int, rep binary, times binary, least binary, raw binary, layers array<binary>, wide array<int>"))
    n_graphs = packed.count()
    # a graph of shard g meets the shards up to g, so many together
    graphs = packed.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("shard") / TOGETHER))).alias("part"), F.lit(0).alias("kind"))
    asking = packed.where("shard + 1 < n_shards").withColumn("part", F.floor(F.col("shard") / TOGETHER))
    asking = asking.select("*", F.lit(1).alias("kind"), F.explode(F.sequence(F.col("shard") + 1, F.col("n_shards") - 1)).alias("g"))
    asking = asking.withColumn("shard", F.col("g")).withColumn("layers", F.lit(None).cast("array<binary>")).withColumn("wide", F.lit(None).cast("array<int>")).drop("g")
    met = graphs.unionByName(asking).repartition(int(max(8 * cores, n_graphs)), "label", "dim", "shard", "part").groupBy("label", "dim", "shard", "part")
    found = stored(met.applyInPandas(_meet(least, kind), _FOUND))
    drop_stored(packed)
    return classes, found


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    named, kind = _sound(vectors)
    classes, found = _found(named, kind, least, shard)
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    keys = stored(classes.select(F.col("rep").alias("key"), F.struct("least").alias("least")))
    groups = _components(keys, found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    groups = groups.select(F.col("key").alias("rep"), F.col("first.least").alias("component"))
    known = classes.select("rep", "times").join(counts, "rep", "left").join(groups, "rep")
    known = known.select("rep", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component")
    joined = named.select("vec_id", "rep").join(known, "rep", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def recall(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """One row: vectors that asked graphs; links of the audited ones, counted by brute force,
    and how many the first beams found of them; the widest beam that was needed."""
    found = _found(*_sound(vectors), least, shard)[1].where("asked is not null")
    return found.agg(F.sum("asked").alias("n_asked"), F.sum("true").alias("n_audited"), F.sum("found").alias("n_found"), F.max("beam").alias("beam"))


ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93),
r AS (SELECT a AS node, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.root, x.vec_id) AS component_id, x.vec_id = coalesce(c.root, x.vec_id) AS kept
FROM embeddings x LEFT JOIN n ON n.a = x.vec_id LEFT JOIN c ON c.node = x.vec_id
"""
