import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_similar_pairs import groups_by_hand
from tests.llm.test_text_operators import kept_lines, leaks_by_hand
from tilewright.llm import common, embeddings, quality, simhash, urlfilter

SCHEMA = "vec_id long, embedding array<float>, label int, rep long"


def links_by_hand(rows, least=0.93):
    sound = [i is not None and e is not None and len(e) > 0 and lab is not None and all(x is not None and math.isfinite(x) for x in e) and any(e) for i, e, lab in rows]
    v = [np.array(e, np.float32).astype(float) if ok else None for (_, e, _), ok in zip(rows, sound, strict=True)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sound[a] and sound[b] and rows[a][2] == rows[b][2] and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= least:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, n[k], low.get(find(k)), None if i is None else i == low[find(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, centres = [], rng.normal(size=(6, 16))
    for k in range(420):
        e = centres[k % 6] + rng.normal(scale=rng.choice([0.02, 0.2, 1.0]), size=16)
        rows.append((1000 - k, [float(x) for x in e.astype(np.float32)], k % 3))
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(30)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [None, 1.0], 1), (3005, rows[0][1], None), (None, rows[0][1], 0), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    want = links_by_hand(rows)
    for shard in (8192, 50):
        got = embeddings.near_duplicates(df, shard=shard).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    v = embeddings._unit(np.repeat(rng.normal(size=(40, 32)), 50, 0) + rng.normal(scale=0.25, size=(2000, 32)))
    g = embeddings.Graph.build(v)
    truth = {(int(a), int(b)) for a, b in np.argwhere(v @ v.T >= 0.9)}
    a, b = g.audited(v, 0.9)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert got <= truth | {(b, a) for a, b in truth} and len(got & truth) >= 0.995 * len(truth)


def test_graph_answers_at_every_size():
    """Every node can be reached, each vector asks the graph, and dense groups are found whole."""
    rng = np.random.default_rng(3)
    for n, scale in ((1, 1.0), (2, 0.01), (30, 0.02), (700, 0.02), (700, 3.0)):
        v = embeddings._unit(rng.normal(size=(1, 16)) + rng.normal(scale=scale, size=(n, 16)))
        g = embeddings.Graph.build(v)
        found = g.linked(v, 0.93)
        assert g.asked >= n and g.audit[0] == int((v @ v.T >= 0.93 + embeddings.SLACK / 2).sum())
        assert (found | ~(v @ v.T >= 0.93 + embeddings.SLACK / 2)).all()
        reached, ahead = {0}, [0]
        while ahead:
            fresh = {int(x) for x in g.layers[0][ahead.pop()] if x >= 0} - reached
            reached |= fresh
            ahead += fresh
        assert len(reached) == n


def test_large_label(spark):
    """A label of over 2,000 vectors, by graphs of one and of many shards."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 12))
    rows = [(k, [float(x) for x in (centres[k % 60] + rng.normal(scale=0.3 if k % 2 else 0.12, size=12)).astype(np.float32)], 1) for k in range(2300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    v = np.array([e for _, e, _ in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.93
    label = simhash._forest(len(rows), *np.nonzero(near))
    for shard in (8192, 120):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, shard=shard).collect()}
        missed = sum(int(near[k].sum()) - 1 - got[k].n_links for k in range(2300))
        assert all(got[k].n_links <= near[k].sum() - 1 for k in range(2300)) and missed <= 0.001 * near.sum()
        assert sum(got[k].component_id != label[k] for k in range(2300)) <= 2
    found = embeddings.recall(df, shard=120).first()
    assert found.n_asked >= 2300 and found.n_found >= 0.9 * found.n_audited


def test_repeated_ids_and_doubles(spark):
    got = embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 0.01], 5), (3, [0.01, 1.0], 5)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    rows = [(1, [1e300, 1e300], "a"), (2, [1.0, 1.0], "a"), (3, [1e-310, 1e-310], "a"), (4, [1e300, -1e300], "a"), (5, [1e300, 1e300], "b"), (6, [0.0, 2.0], "a"), (7, [-0.0, 2.0], "a")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)] + [(7, 7), (40, 39), (-3, 2)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in root)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


URLS = [
    (1, "http://Example.ORG/en/12?x=1", "example.org", "/en/12", "example.org/en/1", "block"), (2, "https://www.example.org/es/", "www.example.org", "/es/", "example.org/es/", "block"),
    (3, "http://a.org/z#f", "a.org", "/z", "org/", "allow"), (4, "http://a.com/fr/x", "a.com", "/fr/x", "com/fr/", "allow"), (5, "http://b.com/de/x", "b.com", "/de/x", "com/de/", "block"),
    (6, "http://org", "org", "", None, None), (7, "no scheme", "", "", None, None), (8, None, "", "", None, None), (9, "http://notorg/", "notorg", "/", None, None), (10, "x://a.org:80/p", "a.org:80", "/p", None, None),
    (11, "http://example.org?u=://b.org/", "example.org", "", None, None), (12, "http:///path", "", "/path", None, None), (None, "http://a.org/", "a.org", "/", "org/", "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u, *_ in URLS], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judged(df).collect()}
    for i, _, host, path, rule, verdict in URLS:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urlfilter.judged(df.limit(0)).count() == 0


def test_mined_rules_by_hand(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        lang, top = rng.choice(["fr", "de", "en"]), rng.choice(["com", "net"])
        rows.append((k, f"http://h{rng.randrange(9)}.example.{top}/{lang}/{rng.randrange(900)}.html"))
    df = spark.createDataFrame(rows + [(999, rows[0][1])], "page_id long, url string")
    host, path = urlfilter.parts(df["url"])
    judged = df.select(host.alias("host"), path.alias("path")).select("*", urlfilter.given(host=F.col("host"), path=F.col("path")).alias("g"), urlfilter.tokens(F.col("host"), F.col("path")).alias("items")).select("host", "path", "items", "g.verdict")
    rules = urlfilter.mine(judged, support=0.02)
    sets = {(r.host, r.path): (set(r["items"]), r.verdict) for r in judged.collect() if r.verdict}
    assert rules
    for tokens, verdict, confidence, support in rules:
        hit = [v for s, v in sets.values() if tokens <= s]
        assert confidence == pytest.approx(hit.count(verdict) / len(hit)) and support == pytest.approx(hit.count(verdict) / len(sets)) and confidence >= 0.9 and support >= 0.02
    got = {r.page_id: r for r in urlfilter.judged(df).collect()}
    for k, u in rows:
        if got[k].rule is None and "/fr/" in u:
            assert got[k].verdict == "allow"
        if got[k].rule is None and "/de/" in u:
            assert got[k].verdict == "block"


def url_parts(url):
    """(host, path, rule, verdict or None) by the rules as they are stated."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]), rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for h, p, v in [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


def url_tokens(url, host, path):
    out = {f"h{k}:{x}" for k, x in enumerate(reversed([x for x in host.split(".") if x]))}
    steps = [x for x in path.split("/") if x]
    out |= {f"p{k}:{x}" for k, x in enumerate(steps)} | {f"p{k}#{x[0]}" for k, x in enumerate(steps) if x[0] in "0123456789"}
    if m := re.search(r"\.([A-Za-z0-9]{1,8})$", path):
        out.add(f"e:{m[1]}")
    query = url.split("#")[0].split("?", 1)[1:] if url and "://" in url else []
    return out | {f"q:{x.split('=')[0]}" for x in "".join(query).split("&") if x.split("=")[0]}


def test_all_pages_by_hand(spark):
    """Every page of a table: host, path and rule as stated, verdicts by trying all rules."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, r.url) for r in pages.collect()]
    host, path = urlfilter.parts(F.col("url"))
    split = pages.select(host.alias("host"), path.alias("path"), urlfilter.query_keys(F.col("url")).alias("keys"))
    split = split.select("host", "path", urlfilter.given(F.col("host"), F.col("path"))["verdict"].alias("verdict"), urlfilter.tokens(F.col("host"), F.col("path"), F.col("keys")).alias("items"))
    same = {}
    rules = urlfilter.mine(split, same=same)
    got = {r.page_id: r for r in urlfilter.judged(pages).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path, rule, verdict = url_parts(url)
        if verdict is None:
            own = {same.get(x) for x in url_tokens(url, host, path)}
            verdict = next((v for t, v, _, _ in rules if t <= own), "allow")
        assert tuple(got[i]) == (i, host, path, rule, verdict)


def test_tokens_of_long_urls_and_many_rules(spark):
    """Tokens far behind in a host, a path or a query decide, and over 5,000 rules may stay."""
    rows = [(k, f"http://{'bad' if k % 2 else 'good'}.a.b.c.d.e{k}.org/a/b/c/d/{'x' if k % 2 else 'y'}/{k}?u=1&{'k' if k % 3 else 'j'}{k % 2}=2") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    host, path = urlfilter.parts(F.col("url"))
    split = df.select(host.alias("host"), path.alias("path"), F.when(F.col("page_id") % 2 == 1, "block").otherwise("allow").alias("verdict"), urlfilter.tokens(host, path, urlfilter.query_keys(F.col("url"))).alias("items"))
    same = {}
    rules = urlfilter.mine(split, support=0.1, same=same)
    block = {x for t, v, c, _ in rules if v == "block" and c == 1 for x in t}
    for t in ("h6:bad", "p4:x", "q:k1"):
        assert same[t] in block
    assert all(c == 1 and len(t) == 1 for t, _, c, _ in rules)
    many = spark.createDataFrame([(f"h{k}", f"/{k % 5400}", "allow", [f"p0:{k % 5400}"]) for k in range(5400)], "host string, path string, verdict string, items array<string>")
    assert len(urlfilter.mine(many, support=1 / 5400)) == 5400


def test_similar_texts(spark):
    """Copies with 0.8 or more of their five-word shingles are grouped, others are not."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(30)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base):
        for c in range(3):
            own = list(w)
            for _ in range(c * 3):
                own[rng.randrange(300)] = "changed"
            rows.append((100 + 3 * k + c, " ".join(own)))
    rows += [(900, None), (901, ""), (902, " "), (None, rows[0][1]), (903, "one two three"), (904, "one two three"), (905, "one two four")]
    got = dict((r.doc_id, r.component_id) for r in simhash.similar(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")).collect())
    for k in range(30):
        assert got[k] == k and all(got[100 + 3 * k + c] == k for c in range(3))
    assert got[900] == got[901] == got[902] == 900 and got[None] == 0 and (got[903], got[904], got[905]) == (903, 903, 905)
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def statistics_by_hand(text):
    """The 21 statistics of a text, by plain counting over its UTF-8 bytes."""
    data = (text or "").encode()
    n, words = len(data), data.split()
    size = [len(w) for w in words]
    mean = sum(size) / len(size) if size else 0
    kinds = {0: [], 1: range(65, 91), 2: range(97, 123), 3: range(48, 58), 4: [9, 11, 12, 13, 32], 5: [10], 6: list(b".,;:'\"-?()"), 7: range(128, 256)}
    of = {c: k for k, cs in kinds.items() for c in cs}
    share = [sum(of.get(c, 0) == k for c in data) / max(n, 1) for k in range(8)]
    often = {w: words.count(w) for w in set(words)}
    pairs = {(words[k], words[k + 1]) for k in range(len(words) - 1)}
    lines = [x.strip() for x in data.split(b"\n")]
    p = [data.count(bytes([c])) / n for c in set(data)]
    m = len(words)
    return [
        math.log(1 + m), math.log(1 + n), math.log(1 + mean), math.log(1 + (math.sqrt(sum((x - mean) ** 2 for x in size) / m) if m else 0)), *map(math.sqrt, share),
        math.log((len(often) + 1) / (m + 1)), math.log((list(often.values()).count(1) + 1) / (m + 1)), math.log((len(pairs) + 1) / (m + 1)), math.sqrt(max(often.values(), default=0) / max(m, 1)),
        math.log(len(set(lines)) / len(lines)), math.log(1 + n / len(lines)), math.sqrt(sum(x <= 3 for x in size) / m if m else 0), -sum(x * math.log2(x) for x in p), math.log((len(zlib.compress(data, 1)) + 1) / (n + 20)),
    ]


def test_statistics_by_hand(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [None, "", " ", "a", "É\n\né"]
    for t in texts:
        if t is None or len(t) < 20_000:
            assert quality.statistics(t) == pytest.approx(statistics_by_hand(t), abs=1e-9)


def test_pipeline(spark, sf_dir):
    """Every stage on its own input against what the stage must keep, by other means."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {i for i, r in before.items() if model.scores(np.array([statistics_by_hand(r.text)]))[0] >= 0.7}
    now = common.stored(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir))
    assert {r.doc_id for r in now.collect()} == good and now.columns == columns
    lines = common.stored(corpus_pipeline.STAGES[1][1](spark, now, sf_dir))
    want = {i: t for i, _, _, t in kept_lines([(r.doc_id, r.text) for r in now.collect()], 10, 1)}
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in want.items()} and lines.columns == columns
    kept = common.stored(corpus_pipeline.STAGES[2][1](spark, lines, sf_dir))
    ids = sorted(want)
    groups, pairs = groups_by_hand([want[i] for i in ids])
    assert {r.doc_id for r in kept.collect()} == {ids[k] for k in groups} and len(pairs) > 5 and kept.columns == columns
    clean = common.stored(corpus_pipeline.STAGES[3][1](spark, kept, sf_dir))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {x[0] for x in leaks_by_hand([(r.doc_id, r.text) for r in kept.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in kept.collect()} - leaks and clean.columns == columns
    out = corpus_pipeline.STAGES[4][1](spark, clean, sf_dir).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in clean.collect()} and all(r.round_trip for r in out)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in out)


def test_stages_take_any_rows(spark, sf_dir):
    """Null ids and texts, repeated rows, clashing names and no rows at all."""
    rows = [(None, None), (1, ""), (1, ""), (2, "a\n" * 30), (2, None), (None, "some words of a text")]
    docs = spark.createDataFrame([(i, t, None, "s", 3, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, id int, once int, leak int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf_dir)
            assert out.columns == docs.columns and out.count() <= frame.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).count() == frame.count()
