"""Training: preparation with SQL to compare, models by their metrics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.ml import evaluate, prep, train
from assayworks.ml.indexer import TableIndexer
from assayworks.schemas import RUN_SUMMARY
from assayworks.session import settle, workspace
from assayworks.sources.sinks import read_json

_TICKET = "CAST(('0x' || substr(md5({key} || ':{seed}'), 1, 8)) AS BIGINT)"


@CATALOG.add(f"""
    SELECT o_orderkey, {_TICKET.format(key="o_orderkey", seed=12345)} % 10000 < 8000 AS train FROM orders
""")
def holdout_split(spark, folder):
    kept, held = prep.holdout_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")
    return kept.withColumn("train", F.lit(True)).unionByName(held.withColumn("train", F.lit(False)))


@CATALOG.add(f"""
    SELECT o_orderkey, CAST({_TICKET.format(key="o_orderkey", seed=123)} % 9 AS INTEGER) AS fold FROM orders
""")
def kfold_assign(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", prep.fold_of(F.col("o_orderkey"), train.CLASSIFIER_FOLDS, train.FOLD_SEED).alias("fold"))


def _gappy(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_totalprice", "nullif(o_orderpriority, '5-LOW') AS priority",
        "o_orderstatus AS status")


_INDEX_SQL = """
    rows AS (SELECT *, nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus AS status FROM orders),
    priorities AS (SELECT priority, row_number() OVER (ORDER BY count(*) DESC, priority) - 1 AS i FROM rows WHERE priority IS NOT NULL GROUP BY priority),
    statuses AS (SELECT status, row_number() OVER (ORDER BY count(*) DESC, status) - 1 AS i FROM rows GROUP BY status),
    indexed AS (
        SELECT o_orderkey, o_custkey, o_totalprice,
               CAST(coalesce(p.i, (SELECT count(*) FROM priorities)) AS DOUBLE) AS priority_id, CAST(s.i AS DOUBLE) AS status_id
        FROM rows LEFT JOIN priorities p USING (priority) JOIN statuses s USING (status))
"""


def _indexed(spark, folder):
    rows = _gappy(spark, folder)
    return prep.string_indexer(["priority", "status"]).fit(rows).transform(rows)


@CATALOG.add(f"WITH {_INDEX_SQL} SELECT o_orderkey, priority_id, status_id FROM indexed")
def string_index(spark, folder):
    return _indexed(spark, folder).select(
        "o_orderkey", F.col("priorityId").alias("priority_id"), F.col("statusId").alias("status_id"))


@CATALOG.add("""
    SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n,
           row_number() OVER (ORDER BY count(*) DESC, CAST(l_partkey AS VARCHAR)) - 1 AS "index"
    FROM lineitem GROUP BY l_partkey
""")
def string_index_large(spark, folder):
    items = table(spark, folder, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    return prep.frequency_index(items, "part")


@CATALOG.add("""
    WITH labels AS (
        SELECT l_partkey, row_number() OVER (ORDER BY count(*) DESC, CAST(l_partkey AS VARCHAR)) - 1 AS i FROM lineitem GROUP BY l_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(i AS DOUBLE) AS part_index FROM lineitem JOIN labels USING (l_partkey)
""")
def string_index_table(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return TableIndexer(inputCols=["l_partkey"], outputCols=["part_index"]).fit(items).transform(items)


@CATALOG.add(f"""
    WITH {_INDEX_SQL}
    SELECT o_orderkey, o_totalprice AS f0, CAST(o_custkey AS DOUBLE) AS f1, priority_id AS f2, status_id AS f3 FROM indexed
""")
def assemble_features(spark, folder):
    assembled = prep.assembler(["o_totalprice", "o_custkey", "priorityId", "statusId"]).transform(
        _indexed(spark, folder))
    values = vector_to_array("features")
    return assembled.select("o_orderkey", *[values[i].alias(f"f{i}") for i in range(4)])


# Shares rather than counts, so that the measures do not all grow with the length. What is not counted
# is removed in runs: one match for each of its characters takes three times as long.
_MEASURES = {
    "log_chars": "CAST(log1p(n_chars) AS DOUBLE)",
    "line_share": "CAST(size(split(text, '\\n')) / n_chars AS DOUBLE)",
    "digit_share": "CAST(length(regexp_replace(text, '[^0-9]+', '')) / n_chars AS DOUBLE)",
    "mark_share": "CAST(length(regexp_replace(text, '[^!-/:-@]+', '')) / n_chars AS DOUBLE)",
}


def _documents(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    measured = table(spark, folder, "documents").selectExpr(
        "doc_id", "lang", "nullif(source, 'src0') AS source",
        *[f"{measure} AS {name}" for name, measure in _MEASURES.items()])
    # Measured once: training, scoring and saving all read the measures, not the texts.
    return settle(measured.join(labels, "doc_id"), "documents")


@CATALOG.add("""
    WITH scored AS (
        SELECT l.quality, n_chars % 997 AS score FROM documents d JOIN labels l USING (doc_id)),
    pairs AS (
        SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS wins
        FROM scored p, scored n WHERE p.quality = 1 AND n.quality = 0)
    SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives,
           round(CAST((SELECT wins FROM pairs) AS DOUBLE) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc
    FROM scored
""")
def auc_exact(spark, folder):
    scored = table(spark, folder, "documents").selectExpr("doc_id", "n_chars % 997 AS score").join(
        table(spark, folder, "labels"), "doc_id")
    return evaluate.exact_auc(scored, "quality", "score").withColumn("auc", F.round("auc", 6))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@CATALOG.add("""
    WITH cells AS (
        SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS r(i)),
    sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    sums AS (SELECT label, i, sum(x) AS y FROM cells GROUP BY label, i),
    norms AS (SELECT vec_id, label, sum(x * x) AS xx FROM cells GROUP BY vec_id, label),
    spreads AS (SELECT label, sum(xx) AS psi FROM norms GROUP BY label),
    dots AS (SELECT c.vec_id, s.label AS other, sum(c.x * s.y) AS dot FROM cells c JOIN sums s USING (i) GROUP BY c.vec_id, s.label),
    distances AS (
        SELECT n.vec_id, n.label, d.other, z.n AS size, n.xx * z.n + p.psi - 2 * d.dot AS total
        FROM norms n JOIN dots d USING (vec_id) JOIN sizes z ON z.label = d.other JOIN spreads p ON p.label = d.other),
    nearest AS (
        SELECT vec_id, max(CASE WHEN other = label THEN CASE WHEN size > 1 THEN total / (size - 1) END END) AS a,
               min(CASE WHEN other <> label THEN total / size END) AS b
        FROM distances GROUP BY vec_id)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM nearest
""")
def label_separation(spark, folder):
    value = evaluate.label_separation(_vectors(spark, folder), "label")
    return spark.createDataFrame([(float(value),)], "silhouette double").withColumn(
        "silhouette", F.round("silhouette", 6))


_METRICS = "params string, fold_metric double, is_best boolean, train_metric double, test_metric double"


def _metrics(spark, trained: train.Trained):
    """One row per parameter set."""
    summary = train.run_summary(spark, trained.model)
    best = max(trained.model.avgMetrics)
    return summary.select(F.explode(F.arrays_zip("summary", "scores")).alias("s")).select(
        F.col("s.summary").alias("params"), F.col("s.scores").alias("fold_metric"),
        (F.col("s.scores") == best).alias("is_best"),
        F.lit(trained.train_metric).alias("train_metric"),
        F.lit(trained.test_metric).cast("double").alias("test_metric"))


@CATALOG.add()
def train_classifier(spark, folder):
    fit, held = prep.holdout_split(_documents(spark, folder), "doc_id")
    return _metrics(spark, train.train_classifier(
        fit, "quality", "doc_id", list(_MEASURES), ["lang", "source"], ["source"], test=held))


@CATALOG.add()
def train_kmeans(spark, folder):
    names = [f"dim_{i:02d}" for i in range(64)]
    wide = prep.widen(table(spark, folder, "embeddings"), "embedding", names)
    fit, held = prep.holdout_split(wide, "vec_id")
    return _metrics(spark, train.train_kmeans(fit, "vec_id", names, test=held))


@CATALOG.add()
def silhouette(spark, folder):
    """How well the predicted clusters of one fit part, beside the labels' own separation."""
    vectors = _vectors(spark, folder).persist()
    try:
        kmeans = train.KMeans(featuresCol="features", predictionCol="pred", k=10, seed=train.CLUSTERING_SEED)
        model = kmeans.fit(prep.laid_out(vectors, "vec_id"))
        values = (evaluate.silhouette_evaluator("pred").evaluate(model.transform(vectors)),
                  evaluate.label_separation(vectors, "label"))
    finally:
        vectors.unpersist()
    return spark.createDataFrame([tuple(map(float, values))], "silhouette double, label_separation double")


@CATALOG.add()
def cv_metrics(spark, folder):
    """Fold-averaged area under ROC of the classification job for its three parameter sets."""
    return _metrics(spark, train.train_classifier(
        _documents(spark, folder), "quality", "doc_id", list(_MEASURES), ["lang", "source"], ["source"]))


@CATALOG.add("SELECT doc_id, TRUE AS same FROM documents JOIN labels USING (doc_id)")
def model_roundtrip(spark, folder):
    """Whether a saved and loaded model predicts the same for every labelled document."""
    documents = _documents(spark, folder)
    trained = train.train_classifier(documents, "quality", "doc_id", list(_MEASURES), ["lang"])
    path = workspace(spark, "model")
    train.save_run(spark, trained.model, f"{path}/model", f"{path}/results")
    again = train.load_model(f"{path}/model")
    before = trained.model.transform(documents).select("doc_id", F.col("prediction").alias("before"))
    after = again.transform(documents).select("doc_id", F.col("prediction").alias("after"))
    return before.join(after, "doc_id").select("doc_id", F.col("before").eqNullSafe(F.col("after")).alias("same"))


@CATALOG.add("""
    SELECT TRUE AS own_app, 1 AS n_scores, TRUE AS in_range, 1 AS n_params, '' AS params,
           count(*) FILTER (embedding IS NOT NULL) AS n_predicted, 2 AS n_clusters FROM embeddings
""")
def ml_run_summary(spark, folder):
    """The shape of the run summary row, written as JSON and read back, and what the saved model predicts."""
    vectors = _vectors(spark, folder)
    trained = train.train_kmeans(vectors, "vec_id")
    path = workspace(spark, "summary")
    train.save_run(spark, trained.model, f"{path}/model", f"{path}/results")
    again = train.load_model(f"{path}/model")
    n, k = again.transform(vectors).where("pred IS NOT NULL").count(), len(again.bestModel.stages[-1].clusterCenters())
    return read_json(spark, f"{path}/results", RUN_SUMMARY).select(
        (F.col("app_id") == spark.sparkContext.applicationId).alias("own_app"), F.size("scores").alias("n_scores"),
        F.forall("scores", lambda s: s.between(-1.0, 1.0)).alias("in_range"), F.size("summary").alias("n_params"),
        F.array_join("summary", ";").alias("params"), F.lit(n).alias("n_predicted"),
        F.lit(k).alias("n_clusters"))
