"""Embedding samples and their two-dimensional projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.sampling import sample_n


def embedding_sample(df: DataFrame, key: list[str], n: int | None = None, seed: int = 1337) -> DataFrame:
    """All rows, or a sample of ``n`` on request."""
    return sample_n(df, n, key, seed)


def pca_2d(df: DataFrame, vec: str = "vec", dims: int | None = None) -> DataFrame:
    """Add ``pc1`` and ``pc2`` of the centred vectors; the sign is arbitrary.

    The covariance is summed by the executors and has dims squared entries;
    below two dimensions the vectors are padded with zeros instead.
    """
    width = dims if dims is not None else df.select(F.size(vec)).first()[0]
    if width < 2:
        return df.withColumns({"pc1": F.get(vec, F.lit(0)).cast("double"), "pc2": F.lit(0.0)})
    wide = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    mean = wide.select(Summarizer.mean(F.col("_v")).alias("m")).select(
        vector_to_array("m").alias("_m")
    )
    centred = df.crossJoin(F.broadcast(mean)).withColumn(  # one row, dims numbers
        "_v", array_to_vector(F.zip_with(vec, "_m", lambda a, b: a - b))
    )
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(centred)
    out = model.transform(centred).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({"pc1": F.get("_p", F.lit(0)), "pc2": F.get("_p", F.lit(1))}).drop(
        "_v", "_m", "_p"
    )


def principal_variances(df: DataFrame, vec: str = "vec", dims: int | None = None) -> DataFrame:
    """Variance along the two components (independent of their sign)."""
    p = pca_2d(df, vec, dims)
    return p.agg(F.var_samp("pc1").alias("var1"), F.var_samp("pc2").alias("var2"))
