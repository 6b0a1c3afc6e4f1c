"""String indices whose labels are a table, for columns with too many values for the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.ml.prep import frequency_index
from assayworks.session import discard, settle


class TableIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Indices by descending frequency, ties by value, as Spark's string indexer gives them with
    ``handleInvalid="keep"``: unseen values and nulls get an index of their own. The labels of all
    columns are one written table, and never come to the driver."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCols: Sequence[str] | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TableIndexerModel:
        found = [
            frequency_index(dataset.select(F.col(c).cast("string").alias(c)), c).select(
                F.lit(c).alias("column"), "value", F.col("index").cast("double").alias("index"))
            for c in self.getInputCols()]
        labels = settle(reduce(DataFrame.unionByName, found), "labels")
        sizes = {r["column"]: r["n"] for r in labels.groupBy("column").agg(F.count("*").alias("n")).collect()}
        model = TableIndexerModel(labels)
        model._set(sizes=[sizes.get(c, 0) for c in self.getInputCols()])
        return self._copyValues(model)


class TableIndexerModel(Model, HasInputCols, HasOutputCols, MLReadable, MLWritable):
    """Looks values up in its table of labels (column, value, index).

    One join per column; the table has a row per value, so Spark broadcasts it where it is small and
    splits a frequent value's rows where it is not. Saving copies the table beside the parameters.
    """

    sizes: Param[list[int]] = Param(Params._dummy(), "sizes", "number of labels of each column", TypeConverters.toListInt)

    def __init__(self, labels: DataFrame | None = None) -> None:
        super().__init__()
        self.labels = labels

    def copy(self, extra=None) -> TableIndexerModel:
        copied = super().copy(extra)
        copied.labels = self.labels
        return copied

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = dataset.columns
        for c, output, size in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("sizes"), strict=True):
            own = self.labels.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("index").alias("_index"))
            dataset = dataset.join(own, F.col(f"`{c}`").cast("string") == F.col("_value"), "left").withColumn(
                output, F.coalesce("_index", F.lit(float(size)))).drop("_value", "_index")
            columns = [*[x for x in columns if x != output], output]
        return dataset.select(*[F.col(f"`{c}`") for c in columns])

    def discard(self) -> None:
        """Delete the labels of a model that is not used any more."""
        discard(self.labels)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TableIndexerModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.labels.write.mode("overwrite").parquet(f"{path}/labels")


class _Reader(MLReader):
    def load(self, path: str) -> TableIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TableIndexerModel(self.sparkSession.read.parquet(f"{path}/labels"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
