"""Vector arithmetic and search over ``embeddings``; the queries are the label centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecweave.catalogue.base import query, r, spread, table
from vecweave.functions import vectors as V
from vecweave.operators import ann
from vecweave.operators.embedding import check_dimensions
from vecweave.operators.graph import graph_recall, knn_graph
from vecweave.operators.search import nest_matches, recall_at_k, search
from vecweave.plans.topk import unit
from vecweave.session import shared_dir


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, summed in part before the shuffle."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(ordered, lambda p: p["x"]).alias("embedding"))


SQL_INPUTS = """q AS (
  SELECT label AS query_id, list(x ORDER BY pos) AS v
  FROM (SELECT label, pos, avg(x) AS x
        FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e
        GROUP BY 1, 2) m
  GROUP BY 1),
s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"""

COSINE = "list_cosine_similarity(q.v, s.v)"
DOT = "list_inner_product(q.v, s.v)"
L2 = "list_distance(q.v, s.v)"


def sql_ranked(score: str, where: str = "TRUE") -> str:
    return f"""WITH {SQL_INPUTS},
scored AS (SELECT query_id, id, label, {score} AS score FROM q, s WHERE {where}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
"""


def sql_topk(score: str, where: str = "TRUE", after: str = "TRUE", k: int = 10) -> str:
    return (
        sql_ranked(score, where)
        + f"""SELECT query_id, rank::INT AS rank, id, label, round(score, 6) + 0.0 AS similarity_score
FROM ranked WHERE rank <= {k} AND {after}"""
    )


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "id", "label", r("similarity_score").alias("similarity_score"))


@query("cosine_topk", sql_topk(COSINE))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search(centroids(spark, sf_dir), store(spark, sf_dir).drop("metadata"), 10, "cosine"))


@query("ip_topk", sql_topk(DOT))
def ip_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search(centroids(spark, sf_dir), store(spark, sf_dir).drop("metadata"), 10, "dot_product"))


@query(
    "l2_topk",
    sql_ranked(f"-{L2}")
    + "SELECT query_id, rank::INT AS rank, id, round(-score, 6) + 0.0 AS distance FROM ranked WHERE rank <= 10",
)
def l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(centroids(spark, sf_dir), store(spark, sf_dir).drop("metadata"), 10, "euclidean")
    return found.select("query_id", "rank", "id", r("distance").alias("distance"))


@query("threshold_search", sql_topk(COSINE, where=f"{COSINE} >= 0.25", k=25))
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search(centroids(spark, sf_dir), store(spark, sf_dir).drop("metadata"), 25, threshold=0.25))


@query("prefilter_topk", sql_topk(COSINE, where="label = 3"))
def prefilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search(centroids(spark, sf_dir), store(spark, sf_dir).drop("metadata"), filters={"label": 3}))


@query("metadata_filter_topk", sql_topk(COSINE, where="label::VARCHAR = '5'"))
def metadata_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search(centroids(spark, sf_dir), store(spark, sf_dir), filters={"metadata.label": 5}))


@query("postfilter_topk", sql_topk(COSINE, after="label = 3", k=20))
def postfilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir).drop("metadata")
    return shown(search(centroids(spark, sf_dir), rows, 20, filters={"label": 3}, filter_mode="post"))


@query(
    "result_shape",
    sql_ranked(COSINE)
    + """SELECT query_id, rank::INT AS rank, id,
       CASE WHEN label % 2 = 0 THEN 'model-' || label ELSE 'unknown' END AS embedding_model,
       round((1 + score) / 2, 6) + 0.0 AS similarity_score, round(1 - score, 6) + 0.0 AS distance
FROM ranked WHERE rank <= 10""",
)
def result_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("label") % 2 == 0, F.concat(F.lit("model-"), F.col("label")))
    rows = store(spark, sf_dir).select("id", "embedding", model.alias("embedding_model"))
    found = search(centroids(spark, sf_dir), rows, score_scale="unit")
    return found.select(
        "query_id", "rank", "id", "embedding_model", r("similarity_score").alias("similarity_score"), r("distance").alias("distance")
    )


@query(
    "batch_search_nested",
    sql_ranked(COSINE)
    + """SELECT query_id, count(*) AS n_matches,
       string_agg(rank || ':' || id || ':' || label, ',' ORDER BY rank) AS matches
FROM ranked WHERE rank <= 5 GROUP BY 1""",
)
def batch_search_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(centroids(spark, sf_dir), store(spark, sf_dir).drop("metadata"), 5)
    nested = nest_matches(found, ["id", "label", "similarity_score"])
    line = lambda m: F.concat_ws(":", m["rank"], m["id"], m["label"])
    return nested.select(
        "query_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.transform("matches", line), ",").alias("matches"),
    )


@query("large_query_set_topk", sql_topk(COSINE))
def large_query_set_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with the query limit set low, so that it runs in several query blocks."""
    return shown(search(centroids(spark, sf_dir), store(spark, sf_dir).drop("metadata"), max_queries=4))


SQL_SMALL = SQL_INPUTS.replace("avg(x) AS x", "avg(x * 1e-6::DOUBLE) AS x").replace(
    "embedding::DOUBLE[] AS v", "list_transform(embedding::DOUBLE[], lambda x: x * 1e-6::DOUBLE) AS v"
)


@query(
    "small_score_topk",
    f"""WITH {SQL_SMALL},
scored AS (
  SELECT 'dot_product' AS metric, query_id, id, {DOT} AS score FROM q, s
  UNION ALL SELECT 'euclidean', query_id, id, -{L2} FROM q, s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric, query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT metric, query_id, rank::INT AS rank, id FROM ranked WHERE rank <= 10""",
)
def small_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among vectors so short that all scores are tiny."""
    small = F.transform("embedding", lambda x: x.cast("double") * 1e-6)
    rows = store(spark, sf_dir).select("id", small.alias("embedding"))
    scaled = table(spark, sf_dir, "embeddings").select("label", F.posexplode(small).alias("pos", "x"))
    means = scaled.groupBy("label", "pos").agg(F.avg("x").alias("x")).groupBy(F.col("label").alias("query_id"))
    asked = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))
    found = [search(asked, rows, 10, m).withColumn("metric", F.lit(m)) for m in ("dot_product", "euclidean")]
    return found[0].unionByName(found[1]).select("metric", "query_id", "rank", "id")


@query(
    "nonfinite_topk",
    f"""WITH {SQL_INPUTS.replace("label FROM embeddings)", "label FROM embeddings WHERE vec_id % 3 <> 0)")},
scored AS (
  SELECT 'dot_product' AS metric, query_id, id, {DOT} AS score FROM q, s
  UNION ALL SELECT 'euclidean', query_id, id, -{L2} FROM q, s
  UNION ALL SELECT 'cosine', query_id, id, {COSINE} FROM q, s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric, query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT metric, query_id, rank::INT AS rank, id FROM ranked WHERE rank <= 10""",
)
def nonfinite_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors hold a NaN or an infinite component; they have no hits."""
    bad = F.when(F.col("id") % 2 == 0, float("nan")).otherwise(float("inf"))
    broken = F.transform("embedding", lambda x, i: F.when((i == 1) & (F.col("id") % 3 == 0), bad).otherwise(x.cast("double")))
    rows = store(spark, sf_dir).select("id", broken.alias("embedding"))
    found = [
        search(centroids(spark, sf_dir), rows, 10, m, max_queries=n).withColumn("metric", F.lit(m))
        for m, n in (("dot_product", 4096), ("euclidean", 4), ("cosine", 4096))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("metric", "query_id", "rank", "id")


@query("ivf_full_probe_topk", sql_topk(COSINE))
def ivf_full_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every list probed the approximate search is exact."""
    rows = store(spark, sf_dir).drop("metadata")
    index = ann.train_ivf(rows, lists=20)
    return shown(ann.ivf_search(centroids(spark, sf_dir), ann.assign_lists(rows, index), index, nprobe=20))


# The lists of the queries below are the label centroids; a row is in the list of the nearest one, unit vectors compared.
SQL_LISTS = f"""{SQL_INPUTS},
u AS (SELECT query_id AS list_id, v FROM q),
far AS (SELECT s.id, u.list_id, list_distance(list_transform(s.v, lambda x: x / sqrt(list_inner_product(s.v, s.v))), u.v) AS d FROM s, u),
home AS (SELECT id, list_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, list_id) AS n FROM far) WHERE n = 1),
near AS (
  SELECT query_id, list_id
  FROM (SELECT query_id, list_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(list_transform(q.v, lambda x: x / sqrt(list_inner_product(q.v, q.v))), u.v), list_id) AS n FROM q, u)
  WHERE n <= 3)"""


@query(
    "ivf_topk",
    f"""WITH {SQL_LISTS},
scored AS (SELECT q.query_id, s.id, s.label, {COSINE} AS score FROM q JOIN near USING (query_id) JOIN home USING (list_id) JOIN s USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, id, label, round(score, 6) + 0.0 AS similarity_score FROM ranked WHERE rank <= 10""",
)
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that are given, written by list and read back; three of them are probed."""
    asked = centroids(spark, sf_dir)
    # One row per label.
    lists = [row["embedding"] for row in asked.orderBy("query_id").collect()]
    index = ann.IvfIndex.given(lists)
    path = shared_dir(spark, "ivf")
    ann.write_lists(ann.assign_lists(store(spark, sf_dir).drop("metadata"), index), path)
    return shown(ann.ivf_search(asked, spark.read.parquet(path), index, nprobe=3))


@query(
    "lsh_topk",
    f"""WITH {SQL_INPUTS},
axes AS (SELECT query_id AS t, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS a FROM q WHERE query_id < 4),
qb AS (SELECT query_id, t, floor(list_cosine_similarity(v, a) / 0.2) AS b FROM q, axes),
sb AS (SELECT id, t, floor(list_cosine_similarity(v, a) / 0.2) AS b FROM s, axes),
met AS (SELECT DISTINCT query_id, id FROM qb JOIN sb USING (t, b)),
scored AS (SELECT query_id, id, label, {COSINE} AS score FROM met JOIN q USING (query_id) JOIN s USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, id, label, round(score, 6) + 0.0 AS similarity_score FROM ranked WHERE rank <= 10""",
)
def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four directions that are given, the first label centroids, in place of random ones."""
    asked = centroids(spark, sf_dir)
    axes = [row["embedding"] for row in asked.filter("query_id < 4").orderBy("query_id").collect()]
    index = ann.LshIndex(unit(np.array(axes)), 0.2)
    return shown(ann.lsh_search(asked, store(spark, sf_dir).drop("metadata"), index))


@query(
    "recall_at_k",
    f"""WITH {SQL_INPUTS},
p AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS c_rank,
         row_number() OVER (PARTITION BY query_id ORDER BY d DESC, id) AS d_rank
  FROM (SELECT query_id, id, {COSINE} AS c, -{L2} AS d FROM q, s) x)
SELECT query_id, count(*) AS n_exact, count(*) FILTER (d_rank <= 10) AS n_found,
       round(count(*) FILTER (d_rank <= 10) / count(*), 6) AS recall
FROM p WHERE c_rank <= 10 GROUP BY 1""",
)
def recall_of_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten best by cosine a search by distance finds."""
    queries, rows = centroids(spark, sf_dir), store(spark, sf_dir).drop("metadata")
    found = recall_at_k(search(queries, rows, metric="euclidean"), search(queries, rows))
    return found.withColumn("recall", r("recall"))


@query(
    "ivf_recall",
    "SELECT count(DISTINCT label) AS n_queries, (10 * count(DISTINCT label))::BIGINT AS n_exact, true AS reached FROM embeddings",
)
def recall_of_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the search over trained lists, all settings as they come, find nine of ten exact results?"""
    rows = store(spark, sf_dir).drop("metadata")
    index = ann.train_ivf(rows)
    path = shared_dir(spark, "ivf")
    ann.write_lists(ann.assign_lists(rows, index), path)
    queries = centroids(spark, sf_dir)
    each = recall_at_k(ann.ivf_search(queries, spark.read.parquet(path), index), search(queries, rows))
    return each.agg(F.count("*").alias("n_queries"), F.sum("n_exact").alias("n_exact"), (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("reached"))


@query(
    "knn_graph",
    """SELECT vec_id AS id, least(10, n - 1) AS n_neighbours, least(10, n - 1) AS n_distinct, 0::BIGINT AS n_self,
       least(10, n - 1) AS n_exact_scores, true AS in_order
FROM embeddings, (SELECT count(*) AS n FROM embeddings)""",
)
def knn_graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every row of the graph: ten distinct others, best first, with the scores that the vectors have."""
    rows = store(spark, sf_dir).select("id", "embedding")
    graph = knn_graph(rows)
    mine, other = rows.withColumnRenamed("embedding", "_a"), rows.select(F.col("id").alias("neighbour"), F.col("embedding").alias("_b"))
    exact = F.abs(V.cosine_similarity(F.col("_a"), F.col("_b")) - F.col("score")) < 1e-9
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    falling = F.forall(F.zip_with(F.slice(scores, 2, 1 << 20), scores, lambda a, b: F.isnull(a) | (a <= b)), lambda ok: ok)
    return graph.join(mine, "id").join(other, "neighbour").groupBy("id").agg(
        F.count("*").alias("n_neighbours"),
        F.count_distinct("neighbour").alias("n_distinct"),
        F.count_if(F.col("id") == F.col("neighbour")).alias("n_self"),
        F.count_if(exact).alias("n_exact_scores"),
        falling.alias("in_order"),
    )


@query(
    "knn_graph_recall",
    "SELECT count(*) AS n_rows, (count(*) * least(10, count(*) - 1))::BIGINT AS n_exact, true AS reached FROM embeddings",
)
def recall_of_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the graph hold nine of ten nearest neighbours of all rows? The exact ones come from a search with every row as query."""
    rows = store(spark, sf_dir).select("id", "embedding")
    exact = search(rows.withColumnRenamed("id", "query_id"), rows, 11).filter("query_id <> id")
    others = Window.partitionBy("query_id").orderBy("rank")
    exact = exact.withColumn("n", F.row_number().over(others)).filter("n <= 10")
    exact = exact.select(F.col("query_id").alias("id"), F.col("id").alias("neighbour"), F.col("similarity_score").alias("score"))
    each = graph_recall(knn_graph(rows), exact)
    return each.agg(F.count("*").alias("n_rows"), F.sum("n_exact").alias("n_exact"), (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("reached"))


@query(
    "vec_normalize",
    """SELECT id, (pos - 1)::INT AS pos, round(x / n, 6) + 0.0 AS x
FROM (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos,
             sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) e""",
)
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", V.normalize(F.col("embedding")).alias("v"))
    return unit.select(F.col("vec_id").alias("id"), F.posexplode("v").alias("pos", "x")).withColumn("x", r("x"))


@query(
    "vec_pairwise_metrics",
    f"""WITH {SQL_INPUTS}
SELECT s.id, q.query_id, round({COSINE}, 6) + 0.0 AS cosine, round({L2}, 6) + 0.0 AS euclidean,
       round({DOT}, 6) + 0.0 AS dot, len(s.v) > 0 AS has_embedding
FROM s JOIN q ON q.query_id = s.label""",
)
def vec_pairwise_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the centroid of its label."""
    a, b = F.col("embedding"), F.col("centroid")
    middle = centroids(spark, sf_dir).withColumnRenamed("embedding", "centroid")
    pairs = spread(table(spark, sf_dir, "embeddings")).join(middle, F.col("label") == F.col("query_id"))
    return pairs.select(
        F.col("vec_id").alias("id"),
        "query_id",
        r(V.cosine_similarity(a, b)).alias("cosine"),
        r(V.euclidean_distance(a, b)).alias("euclidean"),
        r(V.dot_product(a, b)).alias("dot"),
        V.has_embedding(a).alias("has_embedding"),
    )


@query(
    "dimension_check",
    "SELECT vec_id, label, len(embedding)::INT AS dimensions FROM embeddings WHERE len(embedding) <> label + 60",
)
def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return check_dimensions(rows, F.col("label") + 60).select("vec_id", "label", "dimensions")
