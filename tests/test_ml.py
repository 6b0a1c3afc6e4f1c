"""Training: repeatable folds, metrics, saving."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from assayworks.catalog import learning
from assayworks.ml import evaluate, prep, train
from assayworks.ml.indexer import TableIndexer
from assayworks.plans import training
from assayworks.schemas import RUN_SUMMARY
from assayworks.sources.sinks import read_json


def people(spark, n=160):
    rng = random.Random(4)
    data = []
    for i in range(n):
        age = rng.uniform(1, 70)
        sex = rng.choice(["f", "m"])
        data.append((i, age, sex, rng.choice([None, "A", "B"]), 1 if age + (20 if sex == "m" else 0) + rng.gauss(0, 15) < 45 else 0))
    return spark.createDataFrame(data, "id long, age double, sex string, cabin string, label int")


def test_folds_do_not_depend_on_partitioning(spark):
    df = spark.range(5_000)
    folds = {r.id: r.fold for r in df.select("id", prep.fold_of(F.col("id"), 9, 123).alias("fold")).collect()}
    again = {r.id: r.fold for r in df.repartition(5).select("id", prep.fold_of(F.col("id"), 9, 123).alias("fold")).collect()}
    assert folds == again and set(folds.values()) == set(range(9))
    kept, held = prep.holdout_split(df, "id")
    assert kept.count() + held.count() == 5_000 and 3_800 < kept.count() < 4_200
    assert kept.join(held, "id").count() == 0


def test_same_metrics_as_sparks_validator_and_for_any_partitioning(spark):
    rows = people(spark).withColumn("_fold", prep.fold_of(F.col("id"), 3, train.FOLD_SEED))
    svc = LinearSVC(labelCol="label", featuresCol="features", maxIter=5)
    stages = [prep.string_indexer(["sex"]), prep.assembler(["age", "sexId"]), svc]
    grid = ParamGridBuilder().addGrid(svc.regParam, [0.1, 0.7]).build()
    theirs = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid,
                            evaluator=evaluate.roc_evaluator("label"), numFolds=3, foldCol="_fold").fit(rows)
    for partitions in (1, 4):
        ours = train.cross_validate(people(spark).repartition(partitions), stages, grid,
                                    evaluate.roc_evaluator("label"), "id", 3)
        assert ours.avgMetrics == pytest.approx(theirs.avgMetrics, abs=1e-6)
        assert ours.stdMetrics == pytest.approx(theirs.stdMetrics, abs=1e-6)


class RecordingSVC(LinearSVC):
    parts: list[int] = []

    def _fit(self, dataset):
        RecordingSVC.parts.append(dataset.rdd.getNumPartitions())
        return super()._fit(dataset)


def test_fits_run_on_few_parts(spark, monkeypatch):
    svc = RecordingSVC(labelCol="label", featuresCol="features", maxIter=3)
    stages = [prep.string_indexer(["sex"]), prep.assembler(["age", "sexId"]), svc]
    fit = lambda: train.cross_validate(people(spark).repartition(6), stages, [{svc.regParam: 0.1}],
                                       evaluate.roc_evaluator("label"), "id", 2)
    monkeypatch.setattr(RecordingSVC, "parts", [])
    model = fit()
    assert RecordingSVC.parts == [1, 1, 1]
    monkeypatch.setattr(prep, "PACKED_VALUES", 80)
    again = fit()
    assert RecordingSVC.parts[-1] == 4  # 160 rows of 2 values; the fit on all rows comes last
    assert again.avgMetrics == pytest.approx(model.avgMetrics, abs=1e-6)
    assert list(again.bestModel.stages[-1].coefficients) == pytest.approx(list(model.bestModel.stages[-1].coefficients), abs=1e-9)


def test_packed_keeps_all_rows_and_adds_no_parts(spark, monkeypatch):
    df = spark.range(0, 90, 1, 3).selectExpr("id", "CASE WHEN id > 0 THEN array(1D, 2D) END AS a")
    df = df.select("id", F.when(F.col("a").isNotNull(), array_to_vector("a")).alias("features"))
    assert prep.packed(df, "features").rdd.getNumPartitions() == 1
    monkeypatch.setattr(prep, "PACKED_VALUES", 1)
    assert prep.packed(df, "features").rdd.getNumPartitions() == 3
    monkeypatch.setattr(prep, "PACKED_VALUES", 100)
    few = prep.packed(df, "features")
    assert few.rdd.getNumPartitions() == 2 and sorted(r.id for r in few.collect()) == list(range(90))
    assert prep.packed(df.where("id < 0"), "features").count() == 0


def test_measures_of_documents(spark, tmp_path):
    texts = ["a1\n22 b.", "7", "--", "no mark", "\n\n", "\U0001f600 9\U0001f600!? \u0663", "x" * 500 + "1" * 500 + ";" * 3, None]
    spark.createDataFrame([(i, t, "en", "src1", len(t or "x")) for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in learning._documents(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        counts = [None] * 3 if text is None else [
            text.count("\n") + 1, sum(c in "0123456789" for c in text), sum("!" <= c <= "/" or ":" <= c <= "@" for c in text)]
        assert [found[i].line_share, found[i].digit_share, found[i].mark_share] == [
            None if n is None else n / len(text) for n in counts]


def test_classifier_saves_and_loads(spark, tmp_path):
    fit, held = prep.holdout_split(people(spark), "id")
    trained = train.train_classifier(fit, "label", "id", ["age"], ["sex", "cabin"], ["cabin"], test=held, folds=2, maxIter=5)
    assert len(trained.model.avgMetrics) == len(train.REG_PARAMS)
    assert 0.6 < trained.train_metric <= 1.0 and 0.5 < trained.test_metric <= 1.0
    train.save_run(spark, trained.model, f"{tmp_path}/model", f"{tmp_path}/results")
    train.save_run(spark, trained.model, f"{tmp_path}/model", f"{tmp_path}/results")
    summary = read_json(spark, f"{tmp_path}/results", RUN_SUMMARY).collect()
    assert len(summary) == 1 and summary[0].scores == trained.model.avgMetrics
    assert summary[0].summary == ["regParam=0.1", "regParam=0.3", "regParam=0.7"]
    loaded = train.load_model(f"{tmp_path}/model")
    scored = train.null_to_text(held, "cabin")
    predictions = lambda model: {r.id: r.prediction for r in model.transform(scored).collect()}
    assert predictions(loaded) == predictions(trained.model)


def test_classification_job_reads_the_passenger_table(spark, tmp_path):
    rng = random.Random(2)
    lines = ["PassengerId,Survived,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked"]
    for i in range(60):
        sex = rng.choice(["male", "female"])
        age = "" if i % 10 == 0 else str(rng.randint(1, 70))
        lines.append(f'{i},{int(sex == "female") if i % 7 else 1},{rng.randint(1, 3)},"N, {i}",{sex},{age},0,{i % 3},T{i},{i}.5,{"C1" if i % 4 == 0 else ""},S')
    (tmp_path / "train.csv").write_text("\n".join(lines))
    trained = training.classification(spark, str(tmp_path / "train.csv"), f"{tmp_path}/model", f"{tmp_path}/results",
                                      folds=3, reg_params=[0.1], maxIter=10)
    assert trained.train_metric > 0.8
    assert read_json(spark, f"{tmp_path}/results", RUN_SUMMARY).count() == 1


def test_kmeans_job_finds_the_blobs(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, *[rng.gauss(10 * (i % 2), 1) for _ in range(64)]) for i in range(80)]
    spark.createDataFrame(data, ["id", *training.DIGIT_COLUMNS]).write.parquet(f"{tmp_path}/digits")
    trained = training.kmeans(spark, f"{tmp_path}/digits", f"{tmp_path}/model", f"{tmp_path}/results")
    assert len(trained.model.avgMetrics) == 1
    assert trained.train_metric > 0.9 and trained.test_metric > 0.9


def test_exact_auc(spark):
    rng = random.Random(6)
    data = [(rng.randint(0, 1), rng.randint(0, 12)) for _ in range(300)]
    df = spark.createDataFrame(data, "label int, score int").repartition(5)
    positives = [s for y, s in data if y]
    negatives = [s for y, s in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    row = evaluate.exact_auc(df, "label", "score").first()
    assert (row.positives, row.negatives) == (len(positives), len(negatives))
    assert row.auc == pytest.approx(wins / len(positives) / len(negatives))
    nan = evaluate.exact_auc(spark.createDataFrame([(1, float("nan")), (0, 1.0), (1, 0.5)], "label int, score double"), "label", "score")
    assert nan.first().auc == 0.5
    assert evaluate.exact_auc(df.where("label = 1"), "label", "score").first().auc is None


def test_frequency_index_orders_like_the_indexer(spark):
    df = spark.range(400).selectExpr("concat('v', CAST(sqrt(id) AS INT) % 17) AS value")
    labels = prep.string_indexer(["value"]).fit(df).labelsArray[0]
    index = prep.frequency_index(df, "value")
    assert [r.value for r in index.orderBy("index").collect()] == list(labels)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "a array<double>")
    assert list(prep.vector_from_array(df, "a").first().features) == [1.0, 2.0]
    assert prep.widen(df, "a", ["x", "y", "z"]).first().asDict() == {"x": 1.0, "y": 2.0, "z": None}


def test_one_cluster_has_a_silhouette(spark):
    df = prep.vector_from_array(spark.createDataFrame([([float(i), 1.0], 0) for i in range(5)], "a array<double>, pred int"), "a")
    evaluator = evaluate.silhouette_evaluator("pred")
    assert evaluator.evaluate(df) == 0.0 and evaluator.evaluate(df.limit(0)) == 0.0
    two = df.withColumn("pred", (F.col("a")[0] > 2).cast("int"))
    assert evaluator.evaluate(two) == pytest.approx(evaluate.ClusteringEvaluator(predictionCol="pred").evaluate(two))


def test_layout_does_not_depend_on_partitions(spark):
    def parts(df):
        return df.select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")).orderBy("id").collect()

    df = spark.range(250_000)
    assert parts(prep.laid_out(df, "id")) == parts(prep.laid_out(df.repartition(7), "id"))
    assert prep.laid_out(df, "id").rdd.getNumPartitions() == 3


def test_a_table_of_labels_indexes_like_sparks(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "concat('v', CAST(sqrt(id) AS INT) % 17) AS a", "if(id % 9 = 0, NULL, id % 5) AS b", "'mine' AS _value")
    other = spark.createDataFrame([(1, "v3", 4, "x"), (2, "unseen", None, "y"), (3, None, 99, "z")], "id long, a string, b long, _value string")
    theirs = prep.string_indexer(["a", "b"]).fit(df.withColumn("b", F.col("b").cast("string")))
    model = TableIndexer(inputCols=["a", "b"], outputCols=["aId", "bId"]).fit(df.drop("_value"))
    PipelineModel([model]).write().overwrite().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m")
    for rows in (df.drop("_value"), other.drop("_value")):
        want = sorted(map(tuple, theirs.transform(rows.withColumn("b", F.col("b").cast("string"))).select("id", "aId", "bId").collect()))
        for one in (model, loaded, model.copy()):
            assert sorted(map(tuple, one.transform(rows).select("id", "aId", "bId").collect())) == want


def test_a_classifier_over_a_million_values(spark, tmp_path):
    df = spark.range(1_000_000).selectExpr("id", "concat('user-', id) AS name", "CAST(id % 1000 AS DOUBLE) AS x", "CAST(id % 1000 > 500 AS INT) AS label")
    df = df.withColumn("name", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("name")))
    trained = train.train_classifier(df, "label", "id", ["x"], ["name"], large=["name"], folds=2, reg_params=[0.1], maxIter=2)
    assert trained.train_metric > 0.9
    train.save_run(spark, trained.model, f"{tmp_path}/model", f"{tmp_path}/results")
    loaded = train.load_model(f"{tmp_path}/model")
    some = df.where("id % 100000 < 3")
    scores = lambda m: {r.id: (r.nameId, r.prediction) for r in m.transform(some).collect()}
    assert scores(loaded) == scores(trained.model) and scores(loaded)[0][0] == 0.0
