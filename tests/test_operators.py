import datetime
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.operators import (
    bandits, discovery, evaluation, experiments, factors, features, monitoring, ranking, samples, search, sessions,
    similarity, tfidf, vectors,
)


@pytest.fixture(scope="module")
def matrix(spark):
    """A skewed rating matrix: user 0 rated everything, item 0 was rated by everyone."""
    rng = np.random.default_rng(7)
    x = rng.integers(1, 6, (40, 25)) * (rng.random((40, 25)) < 0.3)
    x[0, :], x[:, 0] = 4, 3
    u, i = np.nonzero(x)
    data = pd.DataFrame({"user_id": u, "item_id": i, "rating": x[u, i].astype(float)})
    return x.astype(float), spark.createDataFrame(data)


def test_single_rating_has_no_spread(spark):
    df = spark.createDataFrame([(1, 1, 3.0, datetime.datetime.fromisoformat("2024-01-01"))], "user_id int, item_id int, rating double, timestamp timestamp")
    row = features.user_stats(df).first()
    assert (row.rating_std, row.days_active, row.interactions_per_day) == (0.0, 1, 1.0)


def test_percentile_matches_pandas_ranks(spark):
    counts = [1, 1, 2, 5, 5, 9]
    df = spark.createDataFrame(list(enumerate(counts)), "item_id int, total_ratings int")
    got = {r.item_id: r.popularity_percentile for r in features.popularity_percentile(df).collect()}
    want = (pd.Series(counts).rank(method="min") - 1) / (len(counts) - 1)
    assert got == pytest.approx(want.to_dict())


def test_encode_ids_are_dense_and_ordered(spark):
    keys = [5, 999_999, 100_000, 7, 250_000, 2**40, -(2**50)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.i for r in features.encode_ids(df.union(df), "k", "i").collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys))}
    words = spark.createDataFrame([(w,) for w in ("user_9", "user_10", None, "b", "Z")], "k string")
    got = {r.k: r.i for r in features.encode_ids(words, "k", "i").collect()}
    assert got == {"Z": 0, "b": 1, "user_10": 2, "user_9": 3}


def test_diversify_looks_past_the_best_fifty(spark):
    rows = [(1, i, 1.0 - i / 1000, "A") for i in range(60)] + [(1, 100, 0.9, "B")]
    df = spark.createDataFrame(rows, "user_id int, item_id int, score double, genre string")
    assert [r.item_id for r in ranking.diversify(df, 2).orderBy("rank").collect()] == [0, 100]


def test_prefixes_of_any_length(spark):
    items = spark.createDataFrame([(3, "Recommended Title", "x"), (2, "recommended title", "y"), (1, "r", "z")], "item_id int, title string, category string")
    got = {(r.prefix, r.value): (r["count"], r.item_id, r.category) for r in search.suggest(items).collect()}
    assert got["recommended ti", "recommended title"] == (2, 2, "y") and got["r", "r"] == (1, 1, "z")
    docs = spark.createDataFrame([("recommendation recommended",)], "text string")
    assert {r.value for r in search.autocomplete(docs).filter("prefix = 'recommend'").collect()} == {"recommendation", "recommended"}


def test_nothing_after_the_reference_day_counts(spark):
    at = datetime.datetime.fromisoformat
    rows = [(1, 1, 5.0, at("2024-01-10")), (2, 2, 5.0, at("2024-06-01")), (3, 2, 5.0, at("2024-06-02"))]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double, timestamp timestamp")
    assert [r.item_id for r in features.trending_items(df, as_of="2024-01-11").collect()] == [1]
    assert [r.item_id for r in features.item_stats(df, "2024-01-11").collect()] == [1]


def test_required_columns(spark):
    from spindrift.operators.cleaning import require_columns

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    require_columns(df, ["a", "b"])
    with pytest.raises(ValueError):
        require_columns(df, ["a", "c"])


def test_minmax_is_zero_when_all_scores_are_equal(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], "user_id int, item_id int, score double")
    assert [r.norm for r in ranking.minmax_normalize(df).collect()] == [0.0, 0.0]


def test_top_n_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in (9, 4, 7)], "user_id int, item_id int, score double")
    assert [r.item_id for r in ranking.top_n_per_user(df, 2).orderBy("rank").collect()] == [4, 7]


def test_cold_start_and_batch(spark):
    personal = spark.createDataFrame([(1, 5, 0.9, 1)], "user_id int, item_id int, score double, rank int")
    popular = spark.createDataFrame([(7, 0.5, 1), (8, 0.4, 2)], "item_id int, score double, rank int")
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    got = {(r.user_id, r.item_id, r.served_from) for r in ranking.cold_start(personal, popular, users).collect()}
    assert got == {(1, 5, "personal"), (2, 7, "popular"), (2, 8, "popular")}
    status = {(r.user_id, r.status) for r in ranking.batch_recs(personal.drop("rank"), users).collect()}
    assert status == {(1, "ok"), (2, "failed")}


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_dot_topn_matches_numpy(spark, block_rows):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(23, 6)), rng.normal(size=(31, 6))
    left = vectors.dense(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "i int, v array<double>"), "i", "v")
    right = vectors.dense(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "i int, v array<double>"), "i", "v")
    banned = {(0, int(np.argmax(a[0] @ b.T))), (5, 2)}
    exclude = spark.createDataFrame(list(banned), "left_id int, right_id int")
    got = vectors.dot_topn(left, right, 4, exclude=exclude, threshold=0.0, left_rows=block_rows, right_rows=block_rows).collect()
    scores = np.round(a @ b.T, 6)
    want = set()
    for i in range(len(a)):
        options = [(-scores[i, j], j) for j in range(len(b)) if (i, j) not in banned and scores[i, j] >= 0]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(sorted(options)[:4])}
    assert {(r.left_id, r.right_id, r["rank"]) for r in got} == want


def test_best_products_skip_what_their_bounds_rule_out():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8)) * 5
    right = np.vstack([c + rng.normal(size=(60, 8)) * 0.1 for c in centres])[rng.permutation(720)]
    left = centres[rng.integers(0, 12, 90)] + rng.normal(size=(90, 8)) * 0.1
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    none = np.zeros(0, np.int64)
    for a, b, share in ((unit(left), unit(right), 0.5), (left, right * rng.exponential(size=(720, 1)), 0.9)):
        block = lambda x: vectors._Block(np.arange(len(x)) * 3, x, none, none, none)
        got = vectors.best_products(block(a), block(b), 5, None, False, (none, none), 40)
        scores = np.round(a @ b.T, 6)
        want = [(i * 3, j * 3, scores[i, j]) for i in range(len(a)) for j in sorted(range(len(b)), key=lambda j: (-scores[i, j], j))[:5]]
        assert [(x, y, pytest.approx(z, abs=1e-6)) for x, y, z in want] == list(zip(*(g.tolist() for g in got[:3])))
        assert got[3] < share * a.size / 8 * len(b)


@pytest.mark.parametrize("slice_rows", [5, 4096])
def test_sparse_products_match_numpy(spark, slice_rows):
    rng = np.random.default_rng(9)
    x = np.where(rng.random((40, 30)) < 0.2, rng.random((40, 30)), 0)
    y = np.where(rng.random((55, 30)) < 0.2, rng.random((55, 30)) * rng.exponential(size=(55, 1)), 0)

    def sparse(m):
        rows = [(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(m)]
        return spark.createDataFrame(rows, "id bigint, idx array<bigint>, val array<double>")

    got = vectors.dot_topn(sparse(x), sparse(y), 6, threshold=0.01, left_rows=16, right_rows=30, slice_rows=slice_rows).collect()
    scores = np.round(x @ y.T, 6)
    want = {(i, j, r + 1) for i in range(40) for r, j in enumerate(j for j in sorted(range(55), key=lambda j: (-scores[i, j], j))[:6] if scores[i, j] >= 0.01)}
    assert {(r.left_id, r.right_id, r["rank"]) for r in got} == want


def test_dense_products_are_screened_in_single_precision_and_exact(monkeypatch):
    rng = np.random.default_rng(11)
    z = np.zeros(0, np.int64)
    double = vectors._products
    for scale in (1.0, 1e-3, 1e20):
        # Scores that single precision cannot tell apart, and ties.
        x, y = rng.normal(size=(300, 48)) * scale, np.repeat(rng.normal(size=(3, 48)), 400, axis=0) * scale
        y[:, 0] += rng.integers(0, 5, 1200) * 3e-6 * scale
        left, right = (vectors._Block(np.arange(len(m)), m, z, z, np.zeros(0)) for m in (x, y))
        if scale < 1e10:
            monkeypatch.setattr(vectors, "_products", None)
        ids, other, score, _ = vectors.best_products(left, right, 7, None, False, (np.arange(5), np.arange(5)), 100)
        monkeypatch.setattr(vectors, "_products", double)
        exact = np.round(x @ y.T, 6)
        exact[np.arange(5), np.arange(5)] = -np.inf
        want = [(i, j) for i in range(300) for j in np.lexsort((np.arange(1200), -exact[i]))[:7]]
        assert scale > 1 or list(zip(ids.tolist(), other.tolist())) == want
        assert score == pytest.approx([exact[p] for p in want], rel=1e-9)


def test_copies_of_a_row_stay_under_a_hundred():
    assert max(vectors.copies(10**7, 10**7)) < 100


def test_item_cosine_matches_numpy_in_any_blocking(spark, matrix):
    x, df = matrix
    norms = np.linalg.norm(x, axis=0)
    cosine = np.round(x.T @ x / np.outer(norms, norms), 6)
    want = set()
    for i in range(x.shape[1]):
        options = sorted((-cosine[i, j], j) for j in range(x.shape[1]) if j != i and cosine[i, j] > 0)[:5]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(options)}
    for item_block, batch in ((2048, 10_000), (4, 10_000), (4, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = similarity.item_item_cosine(df, k=5, item_block=item_block).collect()
        assert {(r.item_id, r.similar_id, r["rank"]) for r in got} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pair_chunks_do_not_change_the_sums(matrix, monkeypatch):
    x, _ = matrix
    u, i = np.nonzero(x)
    rows = pd.DataFrame({"user_id": u, "item_id": i, "rating": x[u, i], "block": 0, "cell_a": 0, "cell_b": 0})
    best = similarity._stream_cells(5, None)
    whole = pd.concat(best(iter([rows])), ignore_index=True)
    monkeypatch.setattr(similarity, "PAIR_CHUNK", 17)
    parts = iter([rows.iloc[a : a + 13] for a in range(0, len(rows), 13)])
    pd.testing.assert_frame_equal(whole, pd.concat(best(parts), ignore_index=True))


def test_cells_hold_the_pairs_that_occur_only():
    first, second = np.arange(0, 40_000, 2), np.arange(1, 40_000, 2)
    rows = pd.DataFrame({"user_id": np.repeat(np.arange(20_000), 2), "item_id": np.column_stack([first, second]).ravel(), "rating": 2.0, "block": np.tile([0, 1], 20_000), "cell_a": 0, "cell_b": 1})
    cell = similarity._Cell(0, 1)
    cell.add(rows, True)
    assert len(cell.best(10, None)) == 40_000 and cell.dots.size == 20_000


def test_packed_cells_keep_every_pair_of_a_history(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 6, (50, 30)) * (rng.random((50, 30)) < 0.4)
    u, i = np.nonzero(x)
    rows = pd.DataFrame({"user_id": u, "item_id": i, "rating": x[u, i].astype(float)})
    monkeypatch.setattr(similarity, "PACK_ROWS", 40)
    packed = pd.concat(similarity._packed_cells(4)(rows.iloc[a : a + 17] for a in range(0, len(rows), 17)))
    packed = packed.sort_values(["cell_a", "cell_b"], kind="stable")
    best = pd.concat(similarity._stream_cells(100, None)(similarity._unpacked_cells(iter([packed.iloc[:5], packed.iloc[5:]]))))
    want = x.T @ x
    got = np.zeros((30, 30))
    got[best["item_id"], best["similar_id"]] = best["score"]
    assert not best.duplicated(["item_id", "similar_id"]).any() and (got == want - np.diag(np.diag(want))).all()


def test_svd_matches_numpy(spark, matrix):
    x, df = matrix
    model = factors.svd_train(df, k=5, iterations=12)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert model.singular_values == pytest.approx(s[:5].tolist(), rel=1e-6)
    users = {r.id: np.array(r.val) for r in model.users.collect()}
    items = {r.id: np.array(r.val) for r in model.items.collect()}
    approx = np.array([[users[a] @ items[b] for b in range(x.shape[1])] for a in range(x.shape[0])])
    assert np.allclose(approx, (u[:, :5] * s[:5]) @ vt[:5], atol=1e-5)
    us = u[:, :5] * s[:5]
    assert model.explained_variance == pytest.approx(us.var(axis=0).sum() / x.var(axis=0).sum(), rel=1e-5)
    recs = factors.factor_recs(model, df, 3)
    assert recs.join(df, ["user_id", "item_id"]).count() == 0
    unknown = spark.createDataFrame([(999, 1), (1, 2)], "user_id int, item_id int")
    assert factors.predict(model, unknown).count() == 1


def test_content_recs_match_brute_force(spark):
    words = ["red blue", "red green", "blue blue sky", "sky", "green sky red"]
    docs = spark.createDataFrame(list(enumerate(words)), "item_id int, text string")
    liked = spark.createDataFrame([(1, 0, 5.0), (1, 3, 3.0), (2, 4, 2.0)], "user_id int, item_id int, rating double")
    v = tfidf.tfidf_vectors(docs, bigrams=False, min_df=1, max_df=1.0)
    dense = {r.id: dict(zip(r.terms, r.val)) for r in v.collect()}
    got = [(r.user_id, r.item_id, r.score) for r in tfidf.content_recs(liked, v, 2).orderBy("rank").collect()]
    scores = {j: round(5 * sum(w * dense[j].get(t, 0) for t, w in dense[0].items()), 6) for j in (1, 2, 4)}
    want = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:2]
    assert got == [(1, j, pytest.approx(s)) for j, s in want]


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([(1, "Cat cat dog"), (2, "the dog"), (3, "")], "item_id int, text string")
    got = {(r.id, r.term): r.weight for r in tfidf.tfidf(docs, min_df=1, max_df=1.0).collect()}
    idf = {"cat": np.log(4 / 2) + 1, "dog": np.log(4 / 3) + 1, "cat cat": np.log(2) + 1, "cat dog": np.log(2) + 1}
    raw = {"cat": 2 * idf["cat"], "dog": idf["dog"], "cat cat": idf["cat cat"], "cat dog": idf["cat dog"]}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    assert got == pytest.approx({**{(1, t): w / norm for t, w in raw.items()}, (2, "dog"): 1.0})


def test_search_prefers_rarer_terms(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple plum"), (3, "apple")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "Apple PLUM")], "query_id int, query string")
    assert search.text_search(docs, queries, 1).first().doc_id == 2


def test_negatives_are_unseen_distinct_and_complete(spark, matrix):
    x, df = matrix
    items = df.select("item_id").distinct()
    got = samples.negative_samples(df, items, ratio=4).toPandas()
    seen = df.groupBy("user_id").count().toPandas().set_index("user_id")["count"]
    assert not got.duplicated(["user_id", "item_id"]).any()
    assert all(x[u, i] == 0 for u, i in zip(got["user_id"], got["item_id"]))
    sizes = got.groupby("user_id").size()
    for user, n in seen.items():
        assert sizes.get(user, 0) == min(4 * n, x.shape[1] - n)


def test_buckets_match_hashlib(spark):
    users = [f"u{i}" for i in range(200)] + ["é", ""]
    df = experiments.ab_assign(spark.createDataFrame([(u,) for u in users], "user_id string"))
    for row in df.collect():
        bucket = int(hashlib.md5(row.user_id.encode()).hexdigest(), 16) % 10000
        assert (row.bucket, row.variant) == (bucket, "treatment" if bucket / 10000 < 0.3 else "control")


@pytest.mark.parametrize("split,arm", [(0.0, "control"), (1.0, "treatment")])
def test_split_ends(spark, split, arm):
    df = spark.range(50).select(experiments.variant(F.col("id"), split).alias("v"))
    assert {r.v for r in df.collect()} == {arm}


def test_ab_metrics_with_empty_lists(spark):
    schema = "user_id int, variant string, timestamp timestamp, response_time_ms double, error_occurred boolean, recommendations array<struct<confidence_score:double>>"
    t = datetime.datetime.fromisoformat("2024-01-02")
    df = spark.createDataFrame([(1, "control", t, None, False, []), (1, "control", t, 10.0, True, [(0.5,)])], schema)
    row = experiments.ab_metrics(df).first()
    assert (row.control_requests, row.control_users, row.treatment_requests) == (2, 1, 0)
    assert (row.control_avg_response_time_ms, row.control_error_rate) == (5.0, 50.0)
    assert (row.control_avg_confidence, row.control_mean_confidence) == (0.25, 0.5)


def test_session_gap_is_strict_and_crosses_chunks(spark):
    base = datetime.datetime.fromisoformat("2024-01-01 23:50:00")
    minute = datetime.timedelta(minutes=1)
    times = [base, base + 30 * minute, base + 60 * minute + datetime.timedelta(microseconds=1), base + 2000 * minute]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "event_id int, user_id int, timestamp timestamp")
    for chunk in ("hour", "day", "year"):
        got = [r.session_no for r in sessions.sessionize(df, 30, chunk=chunk).orderBy("event_id").collect()]
        assert got == [1, 1, 2, 3]


def test_exact_percentiles(spark):
    rng = np.random.default_rng(4)
    shares = (0.0, 0.3, 0.5, 0.95, 1.0)
    for values in (
        [1.0, 1.0, 2.0, 10.0, 11.0, 11.0, 40.0],
        [-3.5, -0.0, 0.0, 1e-310, -1e300, 7.0],
        [2.0] * 50 + rng.normal(size=301).tolist() + [2.0 + 2**-50] * 3,
        [5.0],
    ):
        df = spark.createDataFrame([(v,) for v in values + [None]], "v double").repartition(3)
        assert monitoring.exact_percentiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert monitoring.exact_percentiles(df.filter("v is null"), "v", (0.5,)) == [None]
    assert monitoring.exact_percentiles(spark.createDataFrame([(1.0,), (float("inf"),), (float("inf"),)], "v double"), "v", (0.0, 1.0)) == [1.0, float("inf")]


def test_ordered_bits_keep_the_order():
    values = np.array([-np.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0 + 2**-52, np.inf])
    bits = monitoring.ordered_bits(values)
    assert (np.diff(bits.astype(object)) > 0).all() and monitoring.ordered_bits(np.array([-0.0]))[0] == monitoring.ordered_bits(np.array([0.0]))[0]
    assert [monitoring.from_ordered_bits(int(b)) for b in bits] == values.tolist()


def test_alert_comparisons_are_strict(spark):
    metrics = spark.createDataFrame([("cache_hit_rate", 70.0), ("cpu_utilization", 80.1), ("system_availability", 98.0)], "metric string, value double")
    got = {r.metric: r.message for r in monitoring.alerts(metrics).collect()}
    assert got == {
        "cpu_utilization": "CPU utilization 80.1% exceeds threshold 80.0%",
        "system_availability": "System availability 98.0% below threshold 99.0%",
    }


def test_auc_with_ties(spark):
    data = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (1.0, 1)]
    row = evaluation.binary_metrics(spark.createDataFrame(data, "score double, label int")).first()
    assert row.auc == pytest.approx(5.5 / 6) and row.accuracy == pytest.approx(0.8)


def test_facets_and_modes(spark):
    schema = "item_id int, title string, genre string, category string, language string, year int, duration int, rating double, popularity double, created_date date"
    data = [(1, "a", "Drama", "c", "en", 1999, 60, 0.0, 0.5, None), (2, "b", "Drama", "d", "en", 2001, 0, 7.5, 0.9, datetime.date(2000, 1, 1))]
    df = spark.createDataFrame(data, schema)
    counts = {(r.facet, r.value): (r["count"], r.percentage) for r in discovery.facet_counts(df).collect()}
    assert counts[("genre", "Drama")] == (2, 100.0) and counts[("rating_range", "7-8")] == (1, 50.0)
    assert ("duration_range", "Under 1 hour") not in counts
    now = F.lit("2001-01-01").cast("date")
    got = [tuple(r) for r in df.select(*[F.round(discovery.mode_score(m, now), 3) for m in ("trending", "recent")]).collect()]
    assert got == [(0.5, 0.0), (0.09, 0.0)]
    page = discovery.discover(df, now, {"language": "en"}, limit=1)
    assert (page.first().item_id, page.first().total) == (2, 2)


def test_thompson_does_not_depend_on_partitions(spark):
    counts = spark.createDataFrame([(i, i + 2, i, 2) for i in range(20)], "item_id bigint, trials bigint, successes bigint, failures bigint")
    one = [tuple(r) for r in bandits.thompson_sampling(counts.repartition(1), 5).collect()]
    assert one == [tuple(r) for r in bandits.thompson_sampling(counts.repartition(4), 5).collect()]


def test_propagation_matches_numpy(spark, matrix):
    x, df = matrix
    a = (x > 0).astype(float)
    norm = a / np.sqrt(np.outer(a.sum(1), a.sum(0)))
    rng = np.random.default_rng(1)
    u, i = rng.normal(size=(40, 2)), rng.normal(size=(25, 2))
    users = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(u)], "user_id bigint, v0 double, v1 double")
    items = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(i)], "item_id bigint, v0 double, v1 double")
    got, _ = factors.lightgcn_propagate(df, users, items, layers=2)
    want = (u + norm @ i + norm @ (norm.T @ u)) / 3
    out = np.array([[r.v0, r.v1] for r in got.orderBy("user_id").collect()])
    assert np.allclose(out, want)


def test_propagation_sends_vectors_by_block_and_not_by_edge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(factors, "CELL_EDGES", 4)
    rng = np.random.default_rng(3)
    a = rng.random((30, 20)) < 0.3
    a[0], a[1, 1:], a[:, 2] = False, False, False
    norm = np.nan_to_num(a / np.sqrt(np.maximum(np.outer(a.sum(1), a.sum(0)), 1)))
    u, i = rng.normal(size=(30, 3)), rng.normal(size=(20, 3))
    u[5], i[4] = 0, 0  # no start vector
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(*np.nonzero(a), strict=True)] + [(None, 1), (2, None)], "user_id bigint, item_id bigint")
    users = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(u) if n != 5], "user_id bigint, a double, b double, c double")
    items = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(i) if n != 4], "item_id bigint, a double, b double, c double")
    written, cut = [], factors.cut_lineage
    monkeypatch.setattr(factors, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    got = factors.lightgcn_propagate(edges.union(edges), users, items, layers=3)
    assert ["users", "items", "u", "i", "r"] in written and written.count(["block", "ids", "values"]) == 2 * 4
    sides, x, y = [u.copy(), i.copy()], u, i
    for _ in range(3):
        x, y = norm @ y, norm.T @ x
        sides = [sides[0] + x, sides[1] + y]
    for key, df, want in zip(("user_id", "item_id"), got, sides, strict=True):
        rows = df.orderBy(key).collect()
        assert [r[key] for r in rows] == list(range(len(want)))
        assert np.allclose([[r.v0, r.v1, r.v2] for r in rows], want / 4)


def test_distinct_counts_stand_apart_from_the_other_aggregates(spark):
    from datetime import datetime

    rows = [(u, i, float(r), datetime(2024, 1, d)) for u, i, r, d in [(1, 5, 2, 1), (1, 5, 4, 2), (1, 6, 3, 3), (2, 5, 1, 4), (None, 5, 2, 4), (None, 5, 3, 5), (2, None, 5, 6)]]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double, timestamp timestamp")
    by_user, by_item = features.user_stats(df), features.item_stats(df)
    assert {(r.user_id, r.total_interactions, r.unique_items, r.avg_rating) for r in by_user.collect()} == {(1, 3, 2, 3.0), (2, 2, 1, 3.0), (None, 2, 1, 2.5)}
    assert {(r.item_id, r.total_ratings, r.unique_users) for r in by_item.collect()} == {(5, 5, 2), (6, 1, 1), (None, 1, 1)}
    assert by_user.columns[:8] == ["user_id", "total_interactions", "avg_rating", "rating_std", "min_rating", "max_rating", "unique_items", "first_interaction"]
    for stats in (by_user, by_item):
        plan = stats._jdf.queryExecution().toString()
        exchanged = [x for x in plan.split("Physical Plan")[1].splitlines() if "partial_count(distinct" in x or ("stddev" in x and "item_id" in x and "user_id" in x)]
        assert not exchanged, exchanged


def test_unseen_lists_hold_the_whole_complement(spark):
    users = spark.createDataFrame([(1,), (2,), (2,)], "user_id long")
    items = spark.createDataFrame([(i,) for i in range(25)], "item_id long")
    rated = spark.createDataFrame([(1, 3), (1, 3), (1, 24), (9, 1)], "user_id long, item_id long")
    got = {}
    for r in ranking.unseen_lists(users, items, rated, 10).collect():
        assert r["items"] == sorted(r["items"]) and {i // 10 for i in r["items"]} == {r.block}
        got.setdefault(r.user_id, set()).update(r["items"])
    assert got == {1: set(range(25)) - {3, 24}, 2: set(range(25))}


def test_list_quality_returns_and_watched_share(spark):
    log = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 1), (3, 1, 0)], "user_id int, position int, clicked int")
    best = 1 / np.log2(2) + 1 / np.log2(3)
    want = ((1 / np.log2(3) + 1 / np.log2(4)) / best + 1) / 2
    assert bandits.list_quality(log, ["user_id"], ["position"]).first().ndcg == pytest.approx(want)
    days = [(1, "2024-01-01"), (1, "2024-01-01"), (1, "2024-01-08"), (2, "2024-01-01"), (2, "2024-01-20"), (3, "2024-01-05")]
    active = spark.createDataFrame(days, "user_id int, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    row = bandits.return_rates(active).first()
    assert (row.retention_7d, row.retention_30d) == (pytest.approx(100 / 3), pytest.approx(200 / 3))
    watched = spark.createDataFrame([(1, 30.0), (1, 90.0), (2, 10.0), (3, 5.0)], "item_id int, minutes double")
    items = spark.createDataFrame([(1, 60), (2, 0)], "item_id int, duration int")
    row = bandits.watch_figures(watched, items).first()
    assert (row.watch_time, row.completion_rate) == (135.0, pytest.approx(0.75))


def test_vocabulary_is_exact_whatever_the_sketch_merges(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{int(x)}x" for x in rng.zipf(1.4, int(rng.integers(0, 60))) if x < 400) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    for cells in (7, 200, 1 << 18):
        monkeypatch.setattr(tfidf, "SKETCH_CELLS", cells)
        for bigrams, min_df, max_df, top in ((False, 1, 1.0, 20), (True, 3, 0.5, 35), (True, 1, 1.0, 100_000)):
            total, df = {}, {}
            for text in texts:
                words = (text or "").split()
                terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])] * bigrams
                for t in terms:
                    total[t] = total.get(t, 0) + 1
                for t in set(terms):
                    df[t] = df.get(t, 0) + 1
            known = [t for t in total if min_df <= df[t] <= max_df * len(texts)]
            want = {t: df[t] for t in sorted(known, key=lambda t: (-total[t], t))[:top]}
            words = tfidf.document_terms(docs, "item_id", "text")
            got = {r.term: r.df for r in tfidf.vocabulary(words, len(texts), bigrams, min_df, max_df, top).collect()}
            assert got == want


def test_tfidf_counts_terms_without_a_row_for_each(spark):
    texts = [(1, "red sky red sky"), (2, "red sky"), (1, "sky blue"), (None, "blue sky"), (None, "sky sky sky"), (3, None), (4, "the"), (5, "Émile émile ß9 ß9")]
    docs = spark.createDataFrame(texts, "item_id bigint, text string")
    vectors = tfidf.tfidf_vectors(docs, min_df=1, max_df=1.0)
    assert "Generate" not in vectors._jdf.queryExecution().toString()
    times, df = {}, {}
    for key, text in texts:
        words = [w for w in (text or "").lower().split() if w != "the"]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        for t in terms:
            times.setdefault(key, {}).setdefault(t, 0)
            times[key][t] += 1
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    got = {r.id: dict(zip(r.terms, r.val)) for r in vectors.collect()}
    assert got.keys() == times.keys()
    for key, own in times.items():
        raw = {t: n * (np.log(9 / (1 + df[t])) + 1) for t, n in own.items()}
        norm = np.sqrt(sum(w * w for w in raw.values()))
        assert got[key] == pytest.approx({t: w / norm for t, w in raw.items()}) and list(got[key]) == sorted(own, key=str.encode)
    assert tfidf.tfidf(docs.limit(0)).count() == 0


def test_long_lists_of_words_are_cut(monkeypatch):
    monkeypatch.setattr(tfidf, "SLICE_WORDS", 4)
    lists = [["a"] * 3, None, ["b"], ["c"] * 9, [], ["d", "e"]]
    parts = list(tfidf._slices([pa.record_batch({"words": pa.array(lists)})]))
    assert [p.column(0).to_pylist() for p in parts] == [lists[:3], lists[3:4], lists[4:]]


def test_gamma_draws_have_the_moments_of_the_distribution(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    for shape in (1.0, 4.5, 300.0):
        draws = np.array([r.x for r in keys.select(bandits.gamma_draw(F.lit(shape), F.col("k")).alias("x")).collect()])
        error = np.sqrt(shape / len(draws))
        assert (draws > 0).all() and abs(draws.mean() - shape) < 4 * error and draws.var() == pytest.approx(shape, rel=0.15)


def test_unseen_lists_join_histories_before_block_ids(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    items = spark.createDataFrame([(i,) for i in range(10)], "item_id long")
    rated = spark.createDataFrame([(1, 0), (1, 9), (2, 4), (2, 4)], "user_id long, item_id long")
    found = ranking.unseen_lists(users, items, rated, 4)
    got = {(r["user_id"], r["block"]): r["items"] for r in found.collect()}
    assert got == {
        (u, b): left for u in (1, 2, 3) for b in range(3)
        if (left := [i for i in range(4 * b, min(4 * b + 4, 10)) if (u, i) not in {(1, 0), (1, 9), (2, 4)}])
    }
    # The arrays of ids must not lie below the join with the histories, whose exchange would send them for each user.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "all#" not in plan[plan.index("Join LeftOuter") :].split("Aggregate")[0]


def test_unseen_digests_are_those_of_the_lists(spark, monkeypatch):
    users = spark.createDataFrame([(u,) for u in range(50)], "user_id long")
    items = spark.createDataFrame([(i,) for i in range(-13, 130)], "item_id long")
    rated = [(u, i) for u in range(60) for i in range(-13, 140) if (u * 7 + i * 5) % 11 == 0 and u % 5] + [(7, i) for i in range(40, 80)]
    rated = spark.createDataFrame(rated, "user_id long, item_id long")
    plain = {(r["user_id"], r["block"]): r["items"] for r in ranking.unseen_lists(users, items, rated, 40).collect()}
    want = {k: (len(v), hashlib.md5(",".join(map(str, v)).encode()).hexdigest()) for k, v in plain.items()}
    assert (7, 1) not in plain and plain[0, 0] == list(range(40)) and plain[0, -1] == list(range(-13, 0))
    for few in (0, 4, 99):
        monkeypatch.setattr(ranking, "FEW_SEEN", few)
        found = ranking.unseen_lists(users, items, rated, 40, digest=True)
        assert {(r["user_id"], r["block"]): (r["unseen"], r["items"]) for r in found.collect()} == want
    # Blocks that a user has nothing of take the block's own digest: no digest is made above that join.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan[plan.index("explode") - 400 : plan.index("explode")]


def test_unseen_in_groups(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "x"), (5, "b", "x")], "item_id long, genre string, category string")
    rated = spark.createDataFrame([(7, 1), (7, 1), (8, 2), (8, 3), (9, 4), (9, 99), (6, 5)], "user_id long, item_id long")
    found = ranking.unseen_in_groups(rated, items, ["genre", "category"])
    assert sorted(map(tuple, found.collect())) == [(7, 2), (7, 2), (8, 1)]
    # Candidates are not exchanged: nothing but the last projection lies above the explode.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")]


def test_unseen_candidates_are_the_whole_complement(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "item_id long")
    rated = spark.createDataFrame([(7, 1), (7, 1), (8, 2), (8, 3), (9, 99)], "user_id long, item_id long")
    users = spark.createDataFrame([(5,), (7,)], "user_id long")
    seen = {(7, 1), (8, 2), (8, 3)}
    for given, who in ((None, (7, 8, 9)), (users, (5, 7, 8, 9))):
        found = ranking.unseen_in_groups(rated, items, users=given)
        assert sorted(map(tuple, found.collect())) == [(u, i) for u in who for i in range(1, 6) if (u, i) not in seen]


def test_unseen_candidates_query_leaves_no_pair_out(spark, tmp_path):
    import duckdb

    from spindrift.registry import load_all

    con = duckdb.connect()
    con.execute("CREATE TABLE ids AS SELECT unnest(range(1, 5)) AS k")
    tables = {
        "part": "SELECT k AS p_partkey, 'a b' AS p_name, 'TYPE' || k AS p_type, 'B' || k AS p_brand, 1 AS p_size, 1.0::DOUBLE AS p_retailprice FROM ids",
        "customer": "SELECT k AS c_custkey, 'n' AS c_name, 0 AS c_nationkey, 1.0::DOUBLE AS c_acctbal, 's' AS c_mktsegment FROM ids",
        "nation": "SELECT 0 AS n_nationkey, 'n' AS n_name, 0 AS n_regionkey",
        "region": "SELECT 0 AS r_regionkey, 'r' AS r_name",
        "orders": "SELECT k AS o_orderkey, k AS o_custkey, TIMESTAMP '1998-01-01' AS o_orderdate FROM ids WHERE k < 3",
        "lineitem": "SELECT k AS l_orderkey, k AS l_partkey, 3.0::DOUBLE AS l_quantity FROM ids WHERE k < 3",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    queries, oracles = load_all()
    got = sorted(map(tuple, queries["unseen_candidates"](spark, str(tmp_path)).collect()))
    assert got == [(u, i) for u in range(1, 5) for i in range(1, 5) if u != i or u > 2]
    assert got == sorted(con.execute(oracles["unseen_candidates"]).fetchall())


def test_blocks_follow_the_filled_entries(spark, monkeypatch):
    def count(*_):
        return lambda left, right: pa.table({"left_id": pa.array([0]), "right_id": pa.array([left.num_rows]), "score": pa.array([float(right.num_rows)])})

    monkeypatch.setattr(vectors, "_cell", count)
    long = spark.range(4096).select("id", F.lit(None).cast("array<bigint>").alias("idx"), F.array_repeat(F.lit(1.0), 64).alias("val"))
    short = spark.range(4096).select("id", F.lit(None).cast("array<bigint>").alias("idx"), F.array(F.lit(1.0)).alias("val"))
    for left, right, place in ((long, short, "right_id"), (short, long, "score")):
        sent = vectors.dot_topn(left, right, 10_000).agg(F.sum(place)).first()[0]
        assert sent == 4096, "the side with longer rows is sent once here"


def test_factor_blocks_are_fewer_than_partitions(spark):
    _, blocks, count = factors._numbered(spark.range(5000), 32)
    assert count == 4 and blocks.count() == 4


def test_svd_in_slices_leaves_its_factors_only(spark, monkeypatch):
    import os

    from spindrift import session

    rng = np.random.default_rng(5)
    held = rng.integers(1, 6, (40, 30)) * (rng.random((40, 30)) < 0.5)
    ratings = spark.createDataFrame([(int(u) * 3, int(i) - 9, float(held[u, i])) for u, i in zip(*np.nonzero(held))], "user_id long, item_id long, rating double")
    written = []

    def noted(df, *args, **options):
        out = session.cut_lineage(df, *args, **options)
        written.append(out.stage_path)
        return out

    monkeypatch.setattr(factors, "cut_lineage", noted)
    whole = factors.svd_train(ratings, k=6, iterations=8, oversample=20)
    monkeypatch.setattr(factors, "SLICE_BYTES", 1)
    first = len(written)
    sliced = factors.svd_train(ratings, k=6, iterations=8, oversample=20)
    assert len(written) - first > 2 * first - 10, "26 columns are multiplied in three slices"
    assert sum(os.path.exists(p.removeprefix("file:")) for p in written) == 2 * (2 + 2), "both factor tables and both tables of ids"
    want = np.linalg.svd(held.astype(float))[1][:6]
    assert whole.singular_values == pytest.approx(want, rel=1e-6) and sliced.singular_values == pytest.approx(want, rel=1e-6)
    assert whole.explained_variance == pytest.approx(sliced.explained_variance)
    a, b = ({r["id"]: np.abs(r["val"]) for r in m.items.collect()} for m in (whole, sliced))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-5) for i in a)


def test_packed_cells_come_one_block_at_a_time():
    import pandas as pd

    from spindrift.operators import similarity

    rng = np.random.default_rng(2)
    rows = pd.DataFrame([(u, int(i), float(u + i)) for u in range(20) for i in np.sort(rng.choice(24, 8, replace=False))], columns=["user_id", "item_id", "rating"])
    parts = list(similarity._packed_cells(6)(iter([rows])))
    assert [p["cell_a"].unique().tolist() for p in parts] == [[b] for b in range(6)]
    got = pd.concat(similarity._unpacked_cells(iter(parts)))
    for (a, b), cell in got.groupby(["cell_a", "cell_b"]):
        both = set(rows[rows["item_id"] % 6 == a]["user_id"]) & set(rows[rows["item_id"] % 6 == b]["user_id"])
        want = rows[rows["user_id"].isin(both) & (rows["item_id"] % 6).isin([a, b])]
        assert sorted(zip(cell["item_id"], cell["rating"])) == sorted(zip(want["item_id"], want["rating"]))


def test_factor_tables_are_written(spark):
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(9)], "user_id long, item_id long, rating double")
    model = factors.als_train(ratings, rank=2, iterations=1)
    assert "Join" not in model.users._jdf.queryExecution().optimizedPlan().toString()
    found = factors.predict(model, ratings.select("user_id", "item_id"), vectors=True).groupBy("user_id").agg(F.sum("prediction"), F.first("_i"))
    held = {r["id"]: r["val"] for r in model.users.collect()}, {r["id"]: r["val"] for r in model.items.collect()}
    for row in found.collect():
        assert row[1] == pytest.approx(sum(float(np.dot(held[0][row[0]], held[1][i])) for i in range(9)))


def test_negative_samples_across_chunks(spark, monkeypatch):
    from spindrift.operators import samples as module

    monkeypatch.setattr(module, "WALK_CHUNK", 3)
    items = spark.createDataFrame([(i * 10,) for i in range(23)], "item_id long")
    seen = [(1, 0), (1, 30), (1, 30), (2, 220), (3, 999), *((4, i * 10) for i in range(20)), *((5, i * 10) for i in range(23))]
    found = module.negative_samples(spark.createDataFrame(seen, "user_id long, item_id long"), items)

    def number(text, modulus):
        return int(hashlib.md5(text.encode()).hexdigest(), 16) % modulus

    want = set()
    for user in range(1, 6):
        mine = {i for u, i in seen if u == user}
        a, b = 1 + number(f"42a{user}", 22), number(f"42b{user}", 23)
        free = [i * 10 for j in range(min(5 * len(mine), 23)) if (i := (a * j + b) % 23) * 10 not in mine]
        want |= {(user, i) for i in free[: 4 * len(mine)]}
    got = [(r["user_id"], r["item_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_training_lists_are_written_once(spark):
    from spindrift.plans import models

    rows = [(u, i, float((u * i) % 5 + 1), datetime.datetime(2024, 1, 1)) for u in range(8) for i in range(8) if (u + i) % 3]
    log = spark.createDataFrame(rows, "user_id long, item_id long, rating double, timestamp timestamp")
    content = spark.createDataFrame([(i, f"title {i % 2}", "some plain words", "drama", "a,b") for i in range(8)], "item_id long, title string, description string, genre string, tags string")
    recs, metrics = models.run_training(log, content, k=2, iterations=1, n=2)
    assert "Window" not in recs._jdf.queryExecution().optimizedPlan().toString()
    assert metrics.count() == 1
