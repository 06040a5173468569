"""From raw documents to packed training sequences: toxic documents out, one of each exact copy, one of each group of near copies, the sources mixed to their weights, and what is left packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import exact_dedup, mixing, ordinal, packing, simhash
from scriptorium.llm.common import remove, table_dir

#: Share of the tokens left after deduplication that the mixture keeps.
MIX_BUDGET_SHARE = 0.9


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't toxic (P(grade > 0) below TOXIC_FROM), by a model fitted on the labelled ones among ``docs``.

    A null, empty or blank text has no word and stays, unless most labelled documents are toxic; long texts count whole; a null id or
    source changes nothing; repeated rows stay or go together. Without labels of both kinds nothing is toxic. An empty table stays empty. Other
    columns pass through, whatever their names.
    """
    return ordinal.drop_toxic(docs, ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that of the least id, a null id being the greatest.

    A null text is no text, and its row stays; empty texts are equal to each other, but not to blank ones; long texts are
    compared whole; of repeated rows, one stays. An empty table stays empty. Other columns pass through, whatever their names.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (connected components of near pairs): that of the least id, a null id being the greatest.

    A text that is null or has no word (letters or digits) is near none, and its row stays; long texts count whole; of repeated rows,
    one stays. An empty table stays empty. Other columns pass through, whatever their names.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the least virtual finish times, as many as MIX_BUDGET_SHARE of all tokens hold.

    A null source is one of its own with the default weight; a null or empty text has no tokens and comes where the hash of its id puts it; long
    texts count whole; ties go by source, hash, id, tokens and row, so that repeated rows each have a place. An empty table stays
    empty. Other columns pass through, whatever their names.
    """
    return mixing.keep_mixture(docs, budget_share=MIX_BUDGET_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in bins: (doc_id, token_start, n_tokens, shard, bin, bin_start).

    A null, empty or blank text has no tokens and no piece; a null id stays null; a text longer than a bin fills bins of its own, and its rest is
    packed; repeated rows are packed each. An empty table gives no piece. Other columns are not read.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Toxicity, SimHash and packing can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage keeps is written to the shared folder and read again by the next one.

    Edge cases are those of the stages: nulls, empty and long texts, ties and repeated rows have a defined result in each, and an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{table_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
