"""The block-max index against scoring every posting."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.text import STOP_WORDS
from spindrift.operators import index

SCHEMA = "doc_id long, text string, kind string, year double"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(1200):
        n = rng.choice([3, 8, 40, 120])
        text = [words[min(399, int(rng.expovariate(0.02)))] for _ in range(n)]
        rows.append((i, " ".join(text), rng.choice(["a", "b", None]), rng.choice([None, 1990.0, 2000.0, 2010.0])))
    return [*rows, (5000, None, "a", 1990.0), (5001, "", "b", None), (5002, "the of and", "a", 2000.0), (5003, rows[7][1], "a", 2000.0)]


QUERIES = [(1, "w0 w3 w250"), (2, "w399 unknown"), (3, "nothing here known"), (4, "w10"), (5, "the"), (6, " ".join(f"w{i}" for i in range(30)))]


def scored(corpus, keep=lambda r: True, k1=1.2, b=0.75):
    def words(text):
        return [w for w in re.findall(r"[^\W]{2,}", (text or "").lower()) if w not in STOP_WORDS]

    tokens = {r[0]: words(r[1]) for r in corpus}
    known = [len(tokens[r[0]]) for r in corpus if r[1] is not None]
    average, df = sum(known) / len(known), Counter(w for t in tokens.values() for w in set(t))
    out = {}
    for q, text in QUERIES:
        terms, found = set(words(text)), {}
        for r in filter(keep, corpus):
            counts = Counter(w for w in tokens[r[0]] if w in terms)
            if counts:
                norm = k1 * (1 - b + b * len(tokens[r[0]]) / average)
                found[r[0]] = sum(math.log((len(corpus) - df[w] + 0.5) / (df[w] + 0.5) + 1) * n * (k1 + 1) / (n + norm) for w, n in counts.items())
        out[q] = found
    return out


@pytest.fixture(scope="module")
def built(spark, corpus, tmp_path_factory):
    docs = spark.createDataFrame(corpus, SCHEMA).repartition(5)
    return index.build_index(docs, str(tmp_path_factory.mktemp("index") / "i"), attributes=("kind", "year"), range_docs=8, shards=3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def pages(found, skip, top):
    out = {}
    for q, docs in found.items():
        ranked = sorted(docs, key=lambda d: (-round(docs[d], 6), d))
        if page := ranked[skip : skip + top]:
            out[q] = page
    return out


def listed(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.key)
    return out


def test_equal_to_scoring_every_posting(built, queries, corpus):
    want = scored(corpus)
    for top, skip in ((10, 0), (7, 4), (5000, 0)):
        found = index.search_index(built, queries, top, skip)
        assert listed(found.hits) == pages(want, skip, top)
    got = {(r.query_id, r.key): r.score for r in found.hits.collect()}
    assert got == pytest.approx({(q, d): s for q, docs in want.items() for d, s in docs.items()}, abs=1e-6)


def test_postings_are_made_by_slices_of_whole_ranges(spark, queries, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SLICE_WORDS", 500)
    words, make = tmp_path / "words", index.shard_postings
    words.mkdir()

    def counted(table, *how):
        local = table.column("local").to_pylist()
        n = len(table.column("words").combine_chunks().flatten())
        (words / f"{table.column('shard')[0]}-{min(local)}").write_text(f"{n} {min(local) % 8}")
        return make(table, *how)

    monkeypatch.setattr(index, "shard_postings", counted)
    docs = spark.createDataFrame(corpus, SCHEMA).repartition(5)
    sliced = index.build_index(docs, str(tmp_path / "i"), range_docs=8, shards=2)
    made = [list(map(int, f.read_text().split())) for f in words.iterdir()]
    assert len(made) > 20 and all(n <= 500 + 8 * 120 and not rest for n, rest in made)
    postings = sliced.table(spark, "postings")
    assert not postings.select("shard", "term", F.explode("ranges").alias("r")).groupBy("shard", "term", "r").count().filter("count > 1").count()
    want = scored(corpus)
    found = index.search_index(sliced, queries, 10, total=True)
    assert listed(found.hits) == pages(want, 0, 10)
    assert {r.query_id: r.total for r in found.totals.collect()} == {q: len(f) for q, f in want.items() if f}


def test_blocks_are_skipped(built, queries):
    few, every = ({r.query_id: r for r in index.search_index(built, queries, k).blocks.collect()} for k in (5, 5000))
    assert all(r.skipped == 0 for r in every.values())
    assert all(few[q].visited + few[q].skipped == every[q].visited for q in every)
    # One term or a rare one beside it: most blocks lie under the fifth score. Thirty common terms leave a loose bound.
    assert all(few[q].skipped > 0.3 * every[q].visited for q in (1, 4)) and sum(r.skipped for r in few.values()) > 500


def test_filters_totals_facets_and_sorting(built, queries, corpus):
    keep = lambda r: r[2] == "a" and r[3] is not None and r[3] >= 2000
    found = index.search_index(built, queries, 6, 2, where=(F.col("kind") == "a") & (F.col("year") >= 2000), facets=("kind", "year"), total=True)
    want = scored(corpus, keep)
    assert listed(found.hits) == pages(want, 2, 6)
    assert {r.query_id: r.total for r in found.totals.collect()} == {q: len(d) for q, d in want.items() if q in (1, 2, 4, 6)}
    years = {r[0]: r[3] for r in corpus}
    counts = Counter((q, "year", str(years[d])) for q, docs in want.items() for d in docs) + Counter((q, "kind", "a") for q, docs in want.items() for _ in docs)
    assert {(r.query_id, r.facet, r.value): r["count"] for r in found.facets.collect()} == dict(counts)
    for down in (True, False):
        by_year = index.search_index(built, queries, 400, order_by="year", descending=down)
        sign = -1 if down else 1
        for q, keys in listed(by_year.hits).items():
            assert keys == sorted(scored(corpus)[q], key=lambda d: (years[d] is None, sign * (years[d] or 0), d))[:400]


def test_no_documents_and_no_queries(spark, queries, built, tmp_path):
    empty = index.build_index(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e")
    assert index.search_index(empty, queries).hits.count() == 0
    assert index.search_index(built, queries.limit(0)).hits.count() == 0
    assert index.search_index(built, queries, where=F.col("kind") == "none", total=True).hits.count() == 0


def test_bound_is_never_passed_over():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, width = int(rng.integers(1, 200)), int(rng.integers(1, 20))
        parts, total = [], np.zeros(n)
        for _ in range(int(rng.integers(1, 5))):
            docs = np.flatnonzero(rng.random(n) < rng.random())
            if len(docs):
                impacts, weight = rng.integers(1, 4, len(docs)) / 2.0, float(rng.integers(1, 3))
                starts = np.flatnonzero(np.diff(docs // width, prepend=-1))
                parts.append((index._Term(docs[starts] // width, np.maximum.reduceat(impacts, starts), starts, docs, impacts), weight))
                total[docs] += weight * impacts
        allowed, keys, k = rng.random(n) < 0.7, rng.permutation(n), int(rng.integers(1, 12))
        got, scores, _, _ = index.best_of_shard(parts, allowed, k, width, keys)
        want = sorted((d for d in range(n) if allowed[d] and total[d]), key=lambda d: (-total[d], keys[d]))[:k]
        assert got.tolist() == want and scores.tolist() == total[want].tolist()
