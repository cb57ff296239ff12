"""Factor models, sampling, splits, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import md5_uniform
from ..operators import evaluation, factors, neural, ranking, samples, tfidf
from ..plans import models
from ..session import cut_lineage, shared_dir
from ..sources import tables
from .bandit_queries import UNIFORM
from .base import add_view, query
from .cleaning_queries import clean
from .experiment_queries import BUCKET
from .search_queries import item_vectors, ratings

SPLIT = BUCKET.replace("10000", "100").replace("7296", "96").format(u="('42|' || user_id || '|' || item_id)")
add_view("split", f"SELECT user_id, item_id, rating, {SPLIT} < 20 AS is_test FROM ratings")


def split(spark, sf):
    return samples.train_test_split(ratings(spark, sf))


@query("train_test_split", "SELECT user_id, item_id, round(rating, 6) AS rating, is_test FROM split")
def _(spark, sf):
    return split(spark, sf)


@query(
    "rating_errors",
    """
WITH t AS (SELECT * FROM split WHERE NOT is_test),
u AS (SELECT user_id, avg(rating) AS m FROM t GROUP BY 1), i AS (SELECT item_id, avg(rating) AS m FROM t GROUP BY 1),
p AS (SELECT s.rating, u.m + i.m - (SELECT avg(rating) FROM t) AS prediction
      FROM split s JOIN u ON s.user_id = u.user_id JOIN i ON s.item_id = i.item_id WHERE s.is_test)
SELECT count(*) AS pairs, round(sqrt(avg((prediction - rating) * (prediction - rating))), 6) AS rmse,
       round(avg(abs(prediction - rating)), 6) AS mae FROM p""",
)
def _(spark, sf):
    rows = split(spark, sf)
    return evaluation.rating_errors(
        evaluation.baseline_predict(rows.filter(~F.col("is_test")), rows.filter("is_test"))
    )


add_view(
    "top_a",
    """
SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id)
         AS INTEGER) AS rank FROM list_a QUALIFY rank <= 10""",
)


@query(
    "catalog_coverage",
    """
SELECT round(count(DISTINCT item_id) / (SELECT count(*) FROM part), 6) AS catalog_coverage,
       count(DISTINCT item_id) AS total_recommended_items, (SELECT count(*) FROM part) AS total_items FROM top_a""",
)
def _(spark, sf):
    total = tables.content(spark, sf).agg(F.count(F.lit(1))).scalar()
    return evaluation.catalog_coverage(ranking.top_n_per_user(tables.scored_lists(spark, sf)[0], 10), total)


@query(
    "ranking_metrics",
    """
WITH h AS (SELECT DISTINCT user_id, item_id FROM list_b WHERE score >= 0.5),
n AS (SELECT user_id, count(*) AS relevant FROM h GROUP BY 1),
x AS (SELECT t.user_id, count(*) AS hits, sum(1 / log2(t.rank + 1)) AS dcg
      FROM top_a t JOIN h ON t.user_id = h.user_id AND t.item_id = h.item_id GROUP BY 1),
p AS (SELECT coalesce(hits, 0) / 10 AS p, coalesce(hits, 0) / relevant AS r,
             coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1)))
               AS g FROM n LEFT JOIN x ON n.user_id = x.user_id)
SELECT count(*) AS users, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(g), 6) AS ndcg FROM p""",
)
def _(spark, sf):
    first, second = tables.scored_lists(spark, sf)
    return evaluation.ranking_metrics(ranking.top_n_per_user(first, 10), second.filter("score >= 0.5"), 10)


@query(
    "binary_metrics",
    """
WITH s AS (SELECT score, CASE WHEN item_id % 3 = 0 OR score > 0.7 THEN 1 ELSE 0 END AS label FROM list_a),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s),
a AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
             / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r)
SELECT round(count(*) FILTER ((score >= 0.5) = (label = 1)) / count(*), 6) AS accuracy,
       round(count(*) FILTER (score >= 0.5 AND label = 1) / count(*) FILTER (score >= 0.5), 6) AS precision,
       round(count(*) FILTER (score >= 0.5 AND label = 1) / count(*) FILTER (label = 1), 6) AS recall,
       (SELECT round(auc, 6) FROM a) AS auc FROM s""",
)
def _(spark, sf):
    label = F.when((F.col("item_id") % 3 == 0) | (F.col("score") > 0.7), 1).otherwise(0)
    return evaluation.binary_metrics(tables.scored_lists(spark, sf)[0].select("score", label.alias("label")))


MOD_P = """((((((('0x' || substr(md5({u}), 1, 8))::BIGINT % {m}) * (4294967296 % {m})
  + ('0x' || substr(md5({u}), 9, 8))::BIGINT) % {m}) * (4294967296 % {m})
  + ('0x' || substr(md5({u}), 17, 8))::BIGINT) % {m}) * (4294967296 % {m})
  + ('0x' || substr(md5({u}), 25, 8))::BIGINT) % {m}"""
add_view(
    "prime",
    """
SELECT n, p FROM (SELECT count(*) AS n FROM part) c, LATERAL (
  SELECT min(t.q) AS p FROM (SELECT unnest(range(n, n + 1000)) AS q) t
  WHERE NOT EXISTS (SELECT 1 FROM range(2, 20000) d(f) WHERE f * f <= t.q AND t.q % f = 0)) x""",
)
add_view(
    "negatives",
    f"""
SELECT user_id, item_id FROM (
  SELECT w.user_id, i.item_id, w.wanted, row_number() OVER (PARTITION BY w.user_id ORDER BY w.j) AS rn FROM (
    SELECT user_id, 4 * np AS wanted, j, (a * j + b) % p AS item_index FROM (
      SELECT c.user_id, c.np, p, n, 1 + {MOD_P.format(u="('42a' || c.user_id)", m="(p - 1)")} AS a,
             {MOD_P.format(u="('42b' || c.user_id)", m="p")} AS b, unnest(range(0, least(5 * np + p - n, p))) AS j
      FROM (SELECT user_id, count(*) AS np FROM ratings GROUP BY user_id) c, prime)) w
  JOIN (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS item_index FROM part) i
    ON w.item_index = i.item_index
  WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = w.user_id AND r.item_id = i.item_id))
WHERE rn <= wanted""",
)


@query("negative_samples", "SELECT user_id, item_id, CAST(0 AS INTEGER) AS label FROM negatives")
def _(spark, sf):
    return samples.negative_samples(ratings(spark, sf), tables.content(spark, sf))


@query(
    "ncf_samples",
    f"""
WITH s AS (SELECT user_id, item_id, 1 AS label FROM ratings UNION ALL SELECT user_id, item_id, 0 FROM negatives)
SELECT {SPLIT} < 20 AS is_test, count(*) AS samples, round(avg(label), 6) AS positive_ratio FROM s GROUP BY 1""",
)
def _(spark, sf):
    return samples.positive_ratio(samples.labelled_samples(ratings(spark, sf), tables.content(spark, sf)))


def svd(spark, sf):
    return factors.svd_train(ratings(spark, sf))


def list_facts(recs, rated):
    """Per user what any right list must show: its length, distinct items, rated items, ranks 1.. in score order."""
    seen = rated.select("user_id", "item_id", F.lit(1).alias("seen"))
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("rank"))
    rows = recs.withColumn("falls", F.coalesce(F.col("score") <= before, F.lit(True)))
    return (
        rows.join(seen, ["user_id", "item_id"], "left")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count_distinct("item_id").alias("distinct_items"),
            F.count("seen").alias("rated_items"),
            F.bool_and("falls").alias("in_order"),
            F.max("rank").alias("last_rank"),
        )
    )


@query(
    "svd_train",
    """
SELECT item_id AS id, 50 AS rank, round(sum(rating * rating), 6) AS energy, count(*) AS ratings, true AS explained_is_a_share,
       true AS values_fall, true AS orthonormal, true AS energy_is_that_of_the_values FROM ratings GROUP BY item_id""",
)
def _(spark, sf):
    """Item factors with what makes them singular vectors: a wrong factor breaks a flag.

    The items' vectors are orthonormal, and the sum of rating times prediction is the sum of the squared values.
    """
    rated = cut_lineage(ratings(spark, sf))
    model = factors.svd_train(rated)
    values = model.singular_values
    falls = all(a >= b > 0 for a, b in zip(values, values[1:]))
    share = 0 < model.explained_variance <= 1
    gram = factors._gram(model.items.select(*[F.get("val", F.lit(j)).alias(f"v{j}") for j in range(len(values))]), [f"v{j}" for j in range(len(values))])
    orthonormal = bool(np.abs(gram - np.eye(len(values))).max() < 1e-6)
    energy = factors.predict(model, rated).agg(F.sum(F.col("rating") * F.col("prediction"))).first()[0]
    matches = abs(energy / sum(v * v for v in values) - 1) < 1e-6
    flags = {"explained_is_a_share": share, "values_fall": falls, "orthonormal": orthonormal, "energy_is_that_of_the_values": matches}
    sums = rated.groupBy(F.col("item_id").alias("id")).agg(F.sum(F.col("rating") * F.col("rating")).alias("energy"), F.count(F.lit(1)).alias("ratings"))
    return model.items.join(sums, "id").select("id", F.size("val").alias("rank"), "energy", "ratings", *[F.lit(v).alias(k) for k, v in flags.items()])


@query("collaborative_recs")
def _(spark, sf):
    return factors.factor_recs(svd(spark, sf), ratings(spark, sf))


@query(
    "collaborative_list_facts",
    """
SELECT user_id, least(10, n - count(*)) AS items, least(10, n - count(*)) AS distinct_items, 0::BIGINT AS rated_items,
       true AS in_order, CAST(least(10, n - count(*)) AS INTEGER) AS last_rank
FROM ratings, (SELECT count(DISTINCT item_id) AS n FROM ratings) GROUP BY user_id, n""",
)
def _(spark, sf):
    """Lists of the factor model: full, without repeats or rated items, in score order."""
    rated = ratings(spark, sf)
    return list_facts(factors.factor_recs(svd(spark, sf), rated), rated)


def normal_equations(model, rated, reg=0.1):
    """Per user the largest defect of the least-squares equations: sum of error times item vector less reg times n times own vector."""
    rank = len(model.users.first()["val"])
    rows = factors.predict(model, rated.select("user_id", "item_id", "rating"), vectors=True).withColumn("error", F.col("rating") - F.col("prediction"))
    sums = rows.withColumnRenamed("user_id", "id").groupBy("id").agg(
        F.count(F.lit(1)).alias("ratings"), F.array(*[F.sum(F.col("error") * F.get("_i", F.lit(j))) for j in range(rank)]).alias("pull")
    )
    both = sums.join(model.users, "id")
    defect = F.array_max(F.zip_with("pull", "val", lambda p, v: F.abs(p - v * reg * F.col("ratings"))))
    return both.select("id", F.size("val").alias("rank"), "ratings", defect.alias("defect"))


@query("als_train", "SELECT user_id AS id, 10 AS rank, count(*) AS ratings, true AS solved FROM ratings GROUP BY user_id")
def _(spark, sf):
    """User factors, each held against the equations that the last half-step solves."""
    rated = cut_lineage(ratings(spark, sf))
    found = normal_equations(factors.als_train(rated), rated)
    return found.select("id", "rank", "ratings", (F.col("defect") < 1e-3).alias("solved"))


@query("score_all_pairs")
def _(spark, sf):
    """Best ten of all users x all items by ALS factors, seen items included."""
    return factors.factor_recs(factors.als_train(cut_lineage(ratings(spark, sf))), None)


@query("hybrid_recs_models")
def _(spark, sf):
    """The blend over the two trained models instead of given lists."""
    rated = cut_lineage(ratings(spark, sf))
    collaborative = factors.factor_recs(factors.svd_train(rated), rated, 20)
    return ranking.hybrid_recs(collaborative, tfidf.content_recs(rated, item_vectors(spark, sf), 20))


@query(
    "factor_lookup",
    """
SELECT user_id AS id, 10 AS rank FROM people WHERE is_premium AND user_id IN (SELECT user_id FROM ratings)""",
)
def _(spark, sf):
    model = factors.als_train(cut_lineage(ratings(spark, sf)))
    wanted = tables.users(spark, sf).filter("is_premium").select("user_id")
    return factors.factor_lookup(model.users, wanted, "user_id").select("id", F.size("val").alias("rank"))


@query(
    "save_load_model",
    "SELECT item_id AS id, 10 AS length, '10' AS rank, true AS same FROM ratings GROUP BY item_id",
)
def _(spark, sf):
    """Item factors read back, compared with those that were saved."""
    import uuid

    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model = factors.als_train(cut_lineage(ratings(spark, sf)))
    model.items = cut_lineage(model.items)
    models.save_model(model, path, rank=10)
    loaded, config = models.load_model(spark, path)
    both = loaded.items.join(model.items.select("id", F.col("val").alias("saved")), "id", "full_outer")
    same = F.col("val").eqNullSafe(F.col("saved")).alias("same")
    return both.select("id", F.size("val").alias("length"), F.lit(config["rank"]).alias("rank"), same)


def scorer_samples(spark, sf):
    return cut_lineage(samples.labelled_samples(ratings(spark, sf), tables.content(spark, sf)))


@query("neural_scorer")
def _(spark, sf):
    """Accuracy and ranking quality on held-out samples of the embeddings trained together with their network."""
    rows = scorer_samples(spark, sf)
    model = neural.train_joint(rows.filter("not is_test"))
    return evaluation.binary_metrics(neural.score_joint(model, rows.filter("is_test")))


@query(
    "neural_scorer_facts",
    f"""
WITH s AS (SELECT user_id, item_id, 1 AS label, {SPLIT} < 20 AS is_test FROM ratings
           UNION ALL SELECT user_id, item_id, 0, {SPLIT} < 20 FROM negatives),
known AS (SELECT * FROM s WHERE is_test AND user_id IN (SELECT user_id FROM s WHERE NOT is_test)
          AND item_id IN (SELECT item_id FROM s WHERE NOT is_test))
SELECT user_id, count(*) AS scored, sum(label)::BIGINT AS positives, true AS probabilities, true AS same_as_rescored,
       32 AS width, true AS loss_falls FROM known GROUP BY user_id""",
)
def _(spark, sf):
    """Per user what any trained scorer must show; each score is computed again from the embedding rows by column functions."""
    rows = scorer_samples(spark, sf)
    model = neural.train_joint(rows.filter("not is_test"), epochs=2)
    again = neural.logit_columns(model, neural.score_joint(model, rows.filter("is_test")))
    near = F.abs(1 / (1 + F.exp(-F.col("logit"))) - F.col("score")) < 1e-9
    return again.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("scored"),
        F.sum("label").alias("positives"),
        F.bool_and(F.col("score").between(0, 1)).alias("probabilities"),
        F.bool_and(near).alias("same_as_rescored"),
        F.max("width").alias("width"),
        F.lit(model.losses[-1] < model.losses[0]).alias("loss_falls"),
    )


@query("perceptron_scorer")
def _(spark, sf):
    """The same for a perceptron over factors learnt beforehand; the factors see training positives only."""
    rows = scorer_samples(spark, sf)
    model = factors.als_train(rows.filter("not is_test and label = 1").withColumn("rating", F.lit(1.0)), rank=8, implicit=True)
    network = neural.train_scorer(rows, model, rank=8)
    return evaluation.binary_metrics(neural.score_pairs(network, rows.filter("is_test"), model))


@query("training_run")
def _(spark, sf):
    content = tables.content(spark, sf, with_text=True)
    return models.run_training(clean(spark, sf), content)[1]


def start_sql(key):
    uniform = UNIFORM.format(k=f"'{key}' || j || '|' || {key}")
    return f"SELECT {key}, j, {uniform} * 2 - 1 AS x FROM (SELECT DISTINCT {key} FROM e), (SELECT unnest(range(0, 8)) AS j)"


@query(
    "lightgcn_propagate",
    f"""
WITH e AS (SELECT DISTINCT user_id, item_id FROM clean),
w AS (SELECT user_id, item_id, 1 / sqrt(count(*) OVER (PARTITION BY user_id) * count(*) OVER (PARTITION BY item_id)) AS w FROM e),
u0 AS ({start_sql("user_id")}),
i0 AS ({start_sql("item_id")}),
u1 AS (SELECT user_id, j, sum(w * x) AS x FROM w JOIN i0 USING (item_id) GROUP BY 1, 2),
i1 AS (SELECT item_id, j, sum(w * x) AS x FROM w JOIN u0 USING (user_id) GROUP BY 1, 2),
u2 AS (SELECT user_id, j, sum(w * x) AS x FROM w JOIN i1 USING (item_id) GROUP BY 1, 2),
m AS (SELECT user_id, j, sum(x) / 3 AS x FROM (SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u2) GROUP BY 1, 2)
SELECT user_id, {", ".join(f"round(max(x) FILTER (j = {j}), 6) AS v{j}" for j in range(8))} FROM m GROUP BY user_id""",
)
def _(spark, sf):
    """Two propagation layers from hash-based start vectors of eight columns."""

    def start(df, key):
        return df.select(key, *[(md5_uniform(F.concat_ws("", F.lit(key), F.lit(str(j)), F.lit("|"), F.col(key))) * 2 - 1).alias(f"v{j}") for j in range(8)])

    edges = clean(spark, sf)
    users = start(edges.select("user_id").distinct(), "user_id")
    items = start(edges.select("item_id").distinct(), "item_id")
    return factors.lightgcn_propagate(edges, users, items)[0]
