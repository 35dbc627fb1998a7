"""URL filters: given rules, and association rules mined from what they judge.

Given rules are (host, path) pairs; a rule fits its host and all subdomains where the
path starts with the rule's, and the longest fitting rule decides. The URLs so judged
are labels: each distinct one is a transaction of its tokens and its verdict, and
Spark's FP-growth mines the frequent combinations. Rules ``tokens -> verdict`` with
enough confidence are kept, less those to which a part of their tokens says the same.
URLs without a given rule are matched by an inverted index from each rule's rarest
token; the rule of the highest confidence, then support, decides, and without one the
default.

A URL's tokens are all its host labels, path parts and query keys, and its file ending,
each with its kind and place; a part that begins with a digit has one for that digit as
well. Tokens that all labelled URLs have together count as one, which keeps the
combinations of one transaction few; others are bounded by their support alone. Rules
come to the driver one by one, shorter ones first, and only those stay that no shorter
one makes redundant.

Defined results: a null URL, or one without ://, has an empty host and path, no tokens
and the default verdict; repeated rows are judged alike and count once for mining; rules
of equal confidence and support are taken in the order of their tokens; with no labelled
URLs, or an empty table, only the default is left. URLs of any length are read whole.
Only page_id and url are read, so other columns may have any name.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import drop_stored, lower_ascii, stored

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def given(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null: none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def query_keys(url: Column) -> Column:
    """The keys of a URL's query, in order."""
    at = F.instr(url, "://")
    query = F.regexp_extract(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    return F.filter(F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")


def tokens(host: Column, path: Column, keys: Column | None = None) -> Column:
    """The distinct tokens of a URL, each with its kind."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    none = F.array().cast("array<string>")
    found = [
        F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)),
        F.transform(steps, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x)),
        F.filter(F.transform(steps, lambda x, i: F.when(F.rlike(x, F.lit("^[0-9]")), F.concat(F.lit("p"), i.cast("string"), F.lit("#"), F.substring(x, 1, 1)))), lambda x: x.isNotNull()),
        F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(none),
    ]
    if keys is not None:
        found.append(F.transform(keys, lambda x: F.concat(F.lit("q:"), x)))
    return F.array_distinct(F.concat(*found))


def _labelled(pages: DataFrame) -> DataFrame:
    """(host, path, items, verdict): one row for each labelled URL, less what is behind its path."""
    rows = pages.where("verdict is not null").groupBy("host", "path")
    return rows.agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.first("verdict").alias("verdict"))


def together(labelled: DataFrame, least: int) -> dict[str, str]:
    """Each token of ``least`` URLs or more -> the smallest of those tokens that the same URLs
    have, judged by their number and two sums of the URLs' hashes. There are at most
    as many such tokens as a URL has on average, divided by the support."""
    each = labelled.select(F.xxhash64("host", "path").alias("a"), F.xxhash64("path", F.lit(1), "host").alias("b"), F.explode("items").alias("t"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    signed = each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), total("a").alias("a"), total("b").alias("b")).where(F.col("n") >= least).collect()
    first: dict[tuple, str] = {}
    for r in sorted(signed, key=lambda r: r.t):
        first.setdefault((r.n, r.a, r.b), r.t)
    return {r.t: first[r.n, r.a, r.b] for r in signed}


def mine(pages: DataFrame, support: float = 0.005, confidence: float = 0.9, same: dict[str, str] | None = None) -> list[tuple[frozenset[str], str, float, float]]:
    """[(tokens, verdict, confidence, support)] from rows (host, path, items, verdict),
    the best first; tokens stand for those that are together with them, which are added
    to ``same``."""
    from pyspark.ml.fpm import FPGrowth

    labelled = stored(_labelled(pages))
    n = labelled.count()
    if not n:
        drop_stored(labelled)
        return []
    found = together(labelled, max(1, math.ceil(support * n - 1e-9)))
    if same is not None:
        same.update(found)
    own = pages.sparkSession.createDataFrame([(t,) for t, first in found.items() if t == first], "t string")
    each = labelled.select("host", "path", "verdict", F.explode_outer("items").alias("t")).join(F.broadcast(own), "t", "left_semi")
    rows = stored(each.groupBy("host", "path", "verdict").agg(F.collect_list("t").alias("items")).select(F.concat("items", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items")))
    # URLs without a frequent token still count for the support
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / max(1, rows.count())), minConfidence=confidence).fit(rows)
    rules = model.associationRules.where("startswith(consequent[0], '=') and not exists(antecedent, x -> startswith(x, '='))")
    best: dict[tuple[frozenset, str], tuple[float, float]] = {}
    by_token: dict[str, list[tuple[frozenset, str]]] = {}
    share = rows.count() / n
    for r in rules.orderBy(F.size("antecedent")).toLocalIterator():
        items, verdict = frozenset(r.antecedent), r.consequent[0][1:]
        if not any(v == verdict and t < items and best[t, v][0] >= r.confidence for x in items for t, v in by_token.get(x, ())):
            best[items, verdict] = (r.confidence, r.support * share)
            by_token.setdefault(min(items), []).append((items, verdict))
    drop_stored(rows)
    drop_stored(labelled)
    return sorted(((t, v, c, s) for (t, v), (c, s) in best.items()), key=lambda x: (-x[2], -x[3], sorted(x[0]), x[1]))


def judged(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; rule: the given one, else null."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), query_keys(F.col("url")).alias("keys"))
    split = split.select("*", given(F.col("host"), F.col("path"), rules).alias("given"), tokens(F.col("host"), F.col("path"), F.col("keys")).alias("items"))
    split = split.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("verdict"), "items")
    same: dict[str, str] = {}
    found = mine(split, same=same)
    often: dict[str, int] = {}
    for t, *_ in found:
        for x in t:
            often[x] = often.get(x, 0) + 1
    index: dict[str, list[int]] = {}
    for k, (t, *_) in enumerate(found):
        index.setdefault(min(t, key=lambda x: (often[x], x)), []).append(k)

    def match(batches):
        for batch in batches:
            out = []
            for items, verdict in zip(batch.column("items").to_pylist(), batch.column("verdict").to_pylist(), strict=True):
                if verdict is None:
                    own = {same[x] for x in items or () if x in same}
                    fits = [k for x in own for k in index.get(x, ()) if found[k][0] <= own]
                    verdict = found[min(fits)][1] if fits else default
                out.append(verdict)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(out, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    return split.mapInArrow(match, f"page_id {kind}, host string, path string, rule string, verdict string")
