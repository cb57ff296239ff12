"""Contexts of variable length against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.operators import contexts


def sessions_of(seed, n):
    """Half of all events are one user's. What follows depends on the last two items: a sum with noise."""
    rng = random.Random(seed)
    out = {}
    for s in range(n):
        user = 0 if rng.random() < 0.5 else rng.randint(1, 30)
        items = [rng.randint(0, 9), rng.randint(0, 9)]
        while len(items) < rng.randint(3, 14):
            items.append((items[-1] + 3 * items[-2]) % 10 if rng.random() < 0.85 else rng.randint(0, 9))
        out[user, s] = items
    return out


def frame(spark, sessions):
    rows = [(u, s, p, i) for (u, s), items in sessions.items() for p, i in enumerate(items)]
    return spark.createDataFrame(rows, "user int, session int, place int, item bigint").repartition(5)


@pytest.mark.parametrize(("depth", "least"), [(3, 5), (1, 1), (0, 40)])
def test_counts_match_brute_force(spark, depth, least):
    sessions = sessions_of(1, 120)
    want = Counter()
    for items in sessions.values():
        for p, item in enumerate(items):
            for d in range(min(depth, p) + 1):
                want[tuple(reversed(items[p - d : p])), item] += 1
    totals = Counter()
    for (context, _), n in want.items():
        totals[context] += n
    got = {(tuple(r.context), r.next_item): (r.n, r.total) for r in contexts.context_tree(frame(spark, sessions), depth, least).collect()}
    assert got == {key: (n, totals[key[0]]) for key, n in want.items() if totals[key[0]] >= least}


def test_longer_contexts_hit_more_than_the_first_order(spark):
    train, test = frame(spark, sessions_of(2, 500)), frame(spark, sessions_of(3, 200))
    rates = []
    for depth in (1, 3):
        tree = contexts.context_tree(train, depth, 5)
        rates.append(contexts.hit_rate(tree, test, depth, top=1).first())
    assert rates[0].sessions == rates[1].sessions == 200
    assert rates[1].hit_rate > 0.6 and rates[1].hit_rate > rates[0].hit_rate + 0.3


def test_prediction_backs_off(spark):
    rows = [((), 1, 9), ((), 2, 5), ((), 3, 1), ((7,), 4, 2), ((7,), 1, 1), ((7, 8), 5, 1)]
    tree = spark.createDataFrame([(list(c), i, n, 0) for c, i, n in rows], "context array<bigint>, next_item bigint, n bigint, total bigint")
    histories = spark.createDataFrame([(1, 0, [7, 8]), (2, 0, [6]), (3, 0, [])], "user int, session int, context array<bigint>")
    got = {}
    for r in contexts.predict_next(tree, histories, 4).orderBy("user", "rank").collect():
        got.setdefault(r.user, []).append((r.item, r.length))
    assert got == {1: [(5, 2), (4, 1), (1, 1), (2, 0)], 2: [(1, 0), (2, 0), (3, 0)], 3: [(1, 0), (2, 0), (3, 0)]}


def test_positions_begin_anew_in_every_session(spark):
    rows = [(1, 1, "2024-01-01 00:00", 5), (2, 1, "2024-01-01 00:10", 6), (3, 1, "2024-01-01 02:00", 7), (4, 2, "2024-01-01 00:00", 8)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, timestamp string, k int").withColumn("timestamp", F.to_timestamp("timestamp"))
    got = sorted(map(tuple, contexts.session_positions(df, "k").collect()))
    assert got == [(1, 1, 0, 5), (1, 1, 1, 6), (1, 2, 0, 7), (2, 1, 0, 8)]
