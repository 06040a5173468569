"""Places where a model of the caller's is put in: encoders and generators, fed in Arrow batches. The library brings no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


def encode(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "vector") -> DataFrame:
    """``df`` with unit vectors of a text column. ``load`` makes the encoder, once in each task; a null text is encoded as an empty one."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()), dtype="object")

    raw = F.pandas_udf(run, ArrayType(FloatType()))(text)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = df.withColumn("_raw", raw).withColumn("_norm", norm(F.col("_raw")))
    return out.withColumn(name, F.when(F.col("_norm") > 0, F.transform("_raw", lambda x: (x / F.col("_norm")).cast("float"))).otherwise(F.col("_raw"))).drop("_raw", "_norm")


def generate(df: DataFrame, prompt: str, load: Callable[[], Callable[[list[str]], list[str]]], name: str = "generation") -> DataFrame:
    """``df`` with a generated text for each prompt. Rows with a null prompt get a null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            asked = rows[prompt].notna()
            texts = pd.Series([None] * len(rows), index=rows.index, dtype="object")
            if asked.any():
                texts[asked] = model(rows.loc[asked, prompt].tolist())
            yield rows.assign(**{name: texts})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(name, StringType())]))
