"""Each operator against a brute-force version, with nulls, empty and long texts, ties,
repeated rows, empty tables and columns whose names clash."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import decontam, licenses, linededup, quality, queries, simhash, spm, substring, toxicity

WORDS = "the of and river stone cloud green quiet lamp paper window seven garden winter market letter bridge silver".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def some_texts(n=120, seed=3):
    rng = random.Random(seed)
    own = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for k in range(n):
        words = [rng.choice(own) for _ in range(rng.randint(1, 90))]
        if k % 9 == 4 and out:
            words = out[rng.randrange(len(out))].split() + words[:2]
        if k % 7 == 5 and out:
            words = out[rng.randrange(len(out))].split()
        text = " ".join(words)
        if k % 5 == 1:
            text = "Common  LINE here\n" + text + "\n\n  common  line here\t\n" + text[:20]
        out.append(text)
    return out


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "k") for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD = [None, "", " ", "\n\n", "x", "Ünïcode ▁ text ☃", "a b c d", "\x0b\x0c tabs\tand\rreturns \x85 kept"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = some_texts() + ODD + ["same words " * 40] * 3 + ["long " * 30_000]
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def split(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


# -- line dedup ---------------------------------------------------------------------


def lines_by_hand(rows, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for k, (_, t) in enumerate(rows):
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, set()).add(k)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 1 or len(held[key(x)]) < least]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(docs, rows, nothing):
    assert sorted((tuple(r) for r in linededup.judged(docs).collect()), key=str) == lines_by_hand(rows, 10)
    assert linededup.judged(nothing).count() == 0
    out = linededup.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_line_dedup_null_and_repeated_ids(spark):
    pairs = [(None, "a\nhot"), (None, "hot\nb"), (5, "hot"), (5, "c\nHOT "), (6, None)]
    df = table(spark, [t for _, t in pairs], [i for i, _ in pairs])
    got = linededup.without_repeated_lines(df, least_docs=4).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, "a"), (None, "b"), (5, ""), (5, "c"), (6, "")], key=str)


def test_line_runs_settle(spark):
    runs = linededup.LineRuns(3)
    for _ in range(4):
        runs.add(spark.createDataFrame([("x",), ("x",), ("y",)], "key string"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {r.key for r in runs.repeated().collect()} == {"x", "y"} and {r.key for r in runs.settled.collect()} == {"x", "y"}


def kept_lines(rows, least_docs, least_length):
    """(id, lines, dropped, text) of (id, text) rows, by Python alone."""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    often = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            often[k] = often.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_length or often[key(x)] < least_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least_length,bound", [(1, 200_000), (3, 1), (0, 0)])
def test_lines_by_hand(spark, least_length, bound, monkeypatch):
    """Letters beyond ASCII, null and repeated ids, equal rows, long texts, any column names."""
    monkeypatch.setattr(linededup, "MOST_BROADCAST", bound)
    rng = random.Random(5)
    pool = ["É", "é", "ÉA", "Éa", "éa", "A", "a", " A\t", "", " ", "ãb", "ÃB", "日本", "日本X", "日本x", "ß", "É\x85", "É\xa0", "İ", "i̇", "Ab\r", "aB", "ab", "×÷", "×", "😀Q", "😀q"]
    rows = [(rng.choice([None, 1, 2, 3, *range(10, 60)]), rng.choice([None, "", "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))])) for _ in range(80)]
    rows += [(7, "x\nab"), (7, "x\nab"), (8, "\n".join(rng.choice(pool) for _ in range(30_000)))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, __kept int, places int, id int, tie int, row int")
    out = linededup.without_repeated_lines(docs, least_length=least_length, counts=("n", "m"))
    assert out.columns == [*docs.columns, "n", "m"]
    assert sorted(((r.doc_id, r.n, r.m, r.text) for r in out.collect()), key=str) == kept_lines(rows, 10, least_length)
    assert linededup.without_repeated_lines(docs.limit(0)).count() == 0


def test_runs_are_joined_without_exchange(spark):
    """Merging runs and leaving out settled keys moves and sorts only the new batch."""
    runs = linededup.LineRuns(2)
    for k in range(4):
        runs.add(spark.range(k, 50 + k).select((F.col("id") % 40).cast("string").alias("key")))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    with linededup._in_order(spark):
        one, two = runs.written(spark.range(30).selectExpr("cast(id as string) key").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))), runs.levels[2][0]
        plan = runs.merged(one, two)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    got = {r.key: r.n_docs for r in runs.repeated().collect()}
    assert len(got) == 40 and min(got.values()) >= 2


# -- SimHash ------------------------------------------------------------------------


def simhash_by_hand(text, width=4):
    words = split(lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_by_hand(pairs):
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f, least.get(find(k))) for k, (i, f) in enumerate(pairs)), key=str)


def test_simhash(docs, rows, nothing):
    want = groups_by_hand([(i, simhash_by_hand(t)) for i, t in rows])
    got = simhash.judged(docs).collect()
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got), key=str) == want
    assert simhash.judged(nothing).count() == 0


def test_simhash_links_at_every_distance(spark, monkeypatch):
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.append(f)
        for d in range(1, 7):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            fps.append(g)
    fps += [0, 1, 3, 7, 15, 31, (1 << 64) - 1]
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    pairs = list(enumerate(fps)) + [(None, fps[0]), (None, 12345 << 30)]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in pairs], "doc_id long, fp long")
    want = groups_by_hand(pairs)
    for bucket, part in ((1 << 21, 1 << 22), (500, 700)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "PART", part)
        got = simhash.components(df).collect()
        assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want


# -- substring dedup ----------------------------------------------------------------


def repeats_by_hand(rows, window):
    last = (1 << 63) - 1
    order = sorted(range(len(rows)), key=lambda k: (last if rows[k][0] is None else rows[k][0]))
    first, out = {}, []
    for k in order:
        words = split(rows[k][1])
        for p in range(len(words) - window + 1):
            first.setdefault(tuple(words[p : p + window]), (k, p))
    for k, (i, t) in enumerate(rows):
        words, gone = split(t), set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] != (k, p):
                gone.update(range(p, p + window))
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [4, 20])
def test_substring_dedup(docs, rows, nothing, window, monkeypatch):
    want = repeats_by_hand(rows, window)
    for size in (6 << 20, 300):
        monkeypatch.setattr(substring, "BATCH_BYTES", size)
        got = substring.without_repeats(docs, window)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert substring.judged(nothing).count() == 0


def test_substring_dedup_by_colliding_hashes(spark):
    texts = some_texts(24) + ["same words " * 40] * 2 + [" ".join(WORDS * 9)] * 2
    want = repeats_by_hand(list(enumerate(texts)), 10)
    got = substring.without_repeats(table(spark, texts), 10, bits=9).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_classes_of_runs_compare_words():
    codes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    got = substring._classes(codes, np.arange(7), 3, np.zeros(7, np.uint64))
    assert [[a == b for b in got] for a in got] == [[a == b or {a, b} == {0, 6} for b in range(7)] for a in range(7)]


def test_substring_dedup_null_and_repeated_ids(spark):
    text = " ".join(WORDS * 2)
    df = table(spark, [text, text, text], [None, 7, 7])
    got = sorted((tuple(r)[:3] for r in substring.without_repeats(df, 10).collect()), key=str)
    assert got == sorted([(None, 36, 36), (7, 36, 18), (7, 36, 18)], key=str)


# -- decontamination ----------------------------------------------------------------


def leaks_by_hand(docs, items, percent=80):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda w, n: {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)}
    out = []
    for j, text in items:
        w = words(text)
        if j is None or not w:
            continue
        n = min(5, len(w))
        want = cut(w, n)
        for i, t in docs:
            got = len(want & cut(words(t), n))
            if got * 100 >= percent * len(want):
                out.append((i, j, len(want), got))
    return sorted(out, key=str)


def test_decontamination(spark, docs, rows, nothing):
    rng = random.Random(8)
    source = [t for _, t in rows if t and len(t.split()) > 40][:12]
    items = []
    for k, t in enumerate(source):
        w = t.split()
        at = rng.randrange(len(w) - 30)
        part = w[at : at + 30]
        for _ in range(k % 3):
            part[rng.randrange(30)] = "changed"
        items.append((k, " ".join(part).upper() if k % 2 else ", ".join(part)))
    items += [(50, None), (51, ""), (52, "x"), (53, "a b c d"), (None, source[0]), (54, "same words same words same words"), (55, "no such item anywhere at all")]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = leaks_by_hand(rows, items)
    got = decontam.contained(docs, b)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want and len(want) > 12
    kept = decontam.without_leaks(docs, b)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {x[0] for x in want} and kept.columns == docs.columns
    odd = docs.withColumn("__id", F.lit(1)).withColumn("leak", F.lit(2))
    assert {r.doc_id for r in decontam.without_leaks(odd, b).collect()} == {r.doc_id for r in kept.collect()}
    assert decontam.contained(nothing, b).count() == 0 and decontam.contained(docs, b.limit(0)).count() == 0


# -- license scans ------------------------------------------------------------------


def test_license_scan(spark, nothing):
    texts = [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
        "Released under the MIT License. Released under the terms of the MIT license", "All rights reserved. all RIGHTS reserved", "cc by cc by cc", "released under the old mit license",
        "Copyright (c) 1999 Some Body All Rights Reserved", None, "", "The General Public Licenses", "nothing of note ☃all rights reserved", "the general public license version 2",
    ]
    got = {r.doc_id: r for r in licenses.judged(table(spark, texts)).collect()}
    assert [got[k].base_labels for k in range(len(texts))] == ["cc-by", "gpl", "", "", "reserved", "cc-by", "", "reserved", "", "", "", "", "gpl"]
    assert [got[k].labels for k in range(8)] == ["cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "apache-2.0", "mit", "reserved", "cc-by", "", "copyright,reserved"]
    assert got[12].labels == "gpl,gpl-2.0"
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].n_words) == (2, 0, 2, 5)
    assert (got[8].n_words, got[8].n_base, got[8].first_word, got[8].score) == (0, 0, None, 0.0)
    assert [got[k].score for k in (0, 3, 4, 7)] == [1.0] * 4 and got[5].score == 0.8 and got[6].score == 0.0
    assert licenses.judged(nothing).count() == 0


def test_license_base_by_hand(docs, rows):
    extra = "words CC BY and the general public license, all rights reserved cc by"
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    both = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n" + extra))).otherwise(F.col("text")))
    got = {r.doc_id: r for r in licenses.judged(both).collect()}
    for r in both.collect():
        w = words(r.text)
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        own = got[r.doc_id]
        assert (own.n_words, own.n_base, own.first_word, own.last_word) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert own.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= own.score <= 1


def test_template_markup():
    a = licenses.Automaton("use [[the [[old]]]] thing {{2}} now")
    find = lambda t: a.longest(t.encode().split(), 0)
    assert [find(t) for t in ("use thing now", "use the thing now", "use the old thing a b now", "use old thing now", "use thing a b c now")] == [3, 4, 7, -1, -1]
    for bad in ("[[only optional]]", "[[open", "{{2}} first", ""):
        with pytest.raises((ValueError, IndexError)):
            licenses.Automaton(bad)


def template_choices(template, rng):
    """A random passage that a template accepts, as words."""
    out, keep, stack = [], True, []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if token == "[[":
            stack.append(keep)
            keep = keep and rng.random() < 0.5
        elif token == "]]":
            keep = stack.pop()
        elif keep and token[0] == "{":
            out += [f"any{rng.randrange(9)}" for _ in range(rng.randint(0, int(token[2:-2])))]
        elif keep:
            out.append(token)
    return out


def longest_by_regex(template, words, start):
    """The end of the longest accepted passage, by trying every end against a pattern."""
    pattern = ""
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        pattern += {"[[": "(?:", "]]": ")?"}.get(token) or (f"(?:[^ ]+ ){{0,{token[2:-2]}}}" if token[0] == "{" else f"{re.escape(token)} ")
    whole = re.compile(pattern)
    return next((e for e in range(len(words), start, -1) if whole.fullmatch("".join(f"{w} " for w in words[start:e]))), -1)


def test_templates_by_another_matcher():
    rng = random.Random(11)
    for label, templates in licenses.TEMPLATES.items():
        for template in templates:
            scanner = licenses.Scanner({label: [template]}, {})
            for trial in range(4):
                words = ["before"] * rng.randint(0, 2) + template_choices(template, rng) + ["after"] * rng.randint(0, 2)
                if trial == 3:
                    words[rng.randrange(len(words))] = "changed"
                spans, ready = [], 0
                for k in range(len(words)):
                    if k >= ready and (end := longest_by_regex(template, words, k)) >= 0:
                        spans.append((k, end, label))
                        ready = end
                assert scanner.scan(" ".join(words).upper().encode())["spans"] == spans
                assert spans or trial == 3


def test_whole_licenses_are_found():
    got = licenses.Scanner().scan(("Copyright (c) 2001 Some One\n" + licenses._BSD.replace("[[", "").replace("]]", "") + " " + licenses._BSD_END.replace("{{8}}", "THE AUTHOR")).encode())
    assert {x for *_, x in got["spans"]} == {"bsd-2-clause", "bsd-3-clause"}


# -- SentencePiece ------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return spm.load()


def test_sentencepiece_round_trip(docs, rows, model, nothing):
    got = {r.doc_id: r for r in spm.encode(docs, model).collect()}
    texts = dict(rows)
    assert all(r.round_trip for r in got.values())
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(docs, model).select("doc_id", "ids"), model).collect()}
    assert back == {i: (t or "").replace(spm.MARK, " ") for i, t in texts.items()}
    for i, t in rows:
        assert list(got[i].ids) == [x for w in (model.split.findall(" " + t.replace(spm.MARK, " ")) if t else []) for x in model.viterbi(w)]
    assert spm.encode(nothing, model).count() == 0


def test_viterbi_is_the_best_of_all():
    pieces = ["<unk>", *(f"<0x{k:02X}>" for k in range(256)), "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba", "▁▁"]
    kinds = ["u", *"b" * 256, *"n" * 9]
    rng = random.Random(2)
    scores = [0.0] * 257 + [-rng.uniform(1, 9) for _ in range(9)]
    m = spm.Unigram(pieces, scores, kinds)
    known = {p: s for p, s, k in zip(pieces, scores, kinds, strict=True) if k == "n"}

    def best(s):
        if not s:
            return 0.0
        out = [known[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in known]
        return max(out + ([m.unknown_score + best(s[1:])] if s[0] not in known else []))

    for _ in range(200):
        text = "".join(rng.choice("ab  é") for _ in range(rng.randint(1, 9)))
        ids = m.encode(text)
        # the bytes of one unknown character cost its score once
        total, k = 0.0, 0
        while k < len(ids):
            if kinds[ids[k]] == "b":
                total, k = total + m.unknown_score, k + 2
            else:
                total, k = total + scores[ids[k]], k + 1
        assert total == pytest.approx(best((" " + text).replace(" ", spm.MARK))) and m.decode(ids) == text


def test_same_as_the_library(model, rows):
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(spm.DEFAULT_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece, s in zip(proto.pieces, model.scores, strict=True):
        piece.score = float(s)
    other = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for _, t in rows[:150]:
        if t:
            a, b = model.encode(t), other.encode(t)
            assert a == b or sum(model.scores[a]) == pytest.approx(sum(model.scores[b]), rel=1e-5)


# -- classifiers --------------------------------------------------------------------


def labelled(spark, bad, good, n=160):
    texts = [(bad if k % 4 == 0 else good)(random.Random(k)) for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), int(k % 4 == 0)) for k in range(n - 20)] + [(None, 1, 1), (3, None, None), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    return table(spark, texts + [None, "", texts[0]], list(range(n)) + [n, n + 1, None]), labels


def prose(rng):
    return ". ".join(" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(12)) for _ in range(6))


def checked(out, n, least):
    assert len(out) == n + 3
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality(spark, nothing):
    df, labels = labelled(spark, lambda rng: "BUY $$$ ### " * rng.randint(20, 60), prose)
    out = quality.judged(df, labels).collect()
    checked(out, 160, 0.7)
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in out if r.doc_id is not None and r.doc_id < 160)
    assert quality.judged(nothing, labels).count() == 0
    assert {r.score for r in quality.judged(df, labels.limit(0)).collect()} == {0.5}
    model = quality.fit(df, labels)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 160} == {k for k in range(160) if k % 4}


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0.0, 1.0], 300)
    m = quality.Discriminant(x, y)
    z = (x - m.mid) / m.scale
    want = []
    for k in (0, 1):
        own = z[y == k]
        cov = np.cov(own.T)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 0.05 * np.eye(3)
        d = z - own.mean(0)
        want.append(-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ai,ij,aj->a", d, np.linalg.inv(cov), d))
    assert np.allclose(m.difference(x), want[1] - want[0])


def test_toxicity(spark, nothing):
    def nasty(rng):
        words = prose(rng).split()
        words.insert(rng.randrange(len(words)), rng.choice(["idiot", "1d1ot", "іdiot", "stupid", "5tupid", "STUPID"]))
        return " ".join(words)

    df, labels = labelled(spark, nasty, prose, 400)
    out = toxicity.judged(df, labels).collect()
    checked(out, 400, 0.3)
    wrong = [r.doc_id for r in out if r.doc_id is not None and r.doc_id < 400 and r.predicted != int(r.doc_id % 4 == 0)]
    assert not wrong
    assert toxicity.judged(nothing, labels).count() == 0
    assert {r.score < 0.01 for r in toxicity.judged(df, labels.limit(0)).collect()} == {True}


def fold_by_hand(text):
    """Character by character: look-alikes, signs between letters, digits, then words."""
    out = []
    for c in (text or "").lower():
        to = toxicity._FOLD.get(ord(c), c)
        out += [] if to is None else [to]
    whole = "".join(out)
    word = lambda k: 0 <= k < len(whole) and (whole[k].isalnum() or whole[k] == "_")
    out = ["i" if c in "!|" and word(k - 1) and word(k + 1) else c for k, c in enumerate(whole)]
    signs = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "l": "i"}
    out = [c if ord(c) >= 128 else signs.get(c) or (c if c.isalpha() else " ") for c in out]
    return " " + " ".join(w for w in "".join(out).split(" ") if w) + " "


def score_by_hand(lexicon, text):
    """Every term tried at every place; of overlapping hits the heaviest, none in an exception."""
    whole = fold_by_hand(text)
    find = lambda t: [k for k in range(len(whole)) if whole.startswith(t, k)]
    excused = [(k, k + len(t)) for t in lexicon.exceptions for k in find(t)]
    hits = sorted((k, k + len(t), w) for t, w in lexicon.weights.items() for k in find(t) if not any(a <= k and k + len(t) <= b for a, b in excused))
    best = []
    for h in hits:
        if best and h[0] < best[-1][1] - 1:
            best[-1] = h if h[2] > best[-1][2] else best[-1]
        else:
            best.append(h)
    total, n = sum(h[2] for h in best), len(whole.split())
    z = lexicon.curve[0] + lexicon.curve[1] * np.log1p(total) + lexicon.curve[2] * np.log1p(100 * total / max(1, n))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_scores_by_hand(spark):
    """Every document of a table against a matcher without an automaton."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    assert lexicon.weights
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    extra = ["", None, "F\u0430ke! l!ke 1t", "a\u200bb|c"] + [f"x {t} y {e}" for t in lexicon.weights for e in [*lexicon.exceptions, ""]]
    for text in extra:
        assert lexicon.score(text) == pytest.approx(score_by_hand(lexicon, text), abs=1e-9)
    for i, text in texts.items():
        if len(text or "") < 4000:
            assert got[i] == pytest.approx(score_by_hand(lexicon, text), abs=1e-9), i


def test_lexicon_folds_and_excuses():
    lex = toxicity.Lexicon({" idiot ": 3.0, " scum": 2.0}, frozenset({" useful idiot "}), (-2.0, 2.0, 0.0))
    assert lex.measures("An ID10T!")[0] > 0 and lex.measures("1d!\u200bot") > (0, 0) and lex.measures("ѕсum") > (0, 0)
    assert lex.measures("a useful idiot") == (0.0, 0.0) and lex.measures("scummy idiot")[0] == pytest.approx(np.log1p(5))
    assert lex.score(None) == lex.score("") and lex.score("idiot") > 0.5 > lex.score("idyllic")


def test_queries_that_sql_can_express(spark, sf_dir, same):
    for name, sql in queries.ORACLE.items():
        same(queries.QUERIES[name](spark, sf_dir), sql)
