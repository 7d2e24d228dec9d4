"""A training corpus from raw documents: quality, near-duplicates, contamination, mixture, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and read back as the next stage's documents.  All
but the last return the columns of ``documents``, whatever else these are named:
columns that a model would add under the same name are kept apart from it.

Odd rows: null texts count as texts without words in every stage (no quality
words, in no group, not contaminated, one end id); rows without an id stay in
every stage but can't be learnt from; repeated rows are one document to the
n-gram join and as many as they are to the other stages; empty tables give empty
tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.llm import decontaminate as contamination
from terrasample.llm import mix, ngram_join, quality, queries, tokens
from terrasample.llm._session import TEXT_ROWS, cut, discard, shared_folder

#: SQL cannot express a fitted classifier or a tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def _settings(spark: SparkSession) -> None:
    """This application's session: Arrow batches of some megabytes, as texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns but doc_id, text and source under numbers, and the way back."""
    named = {c: c if c in ("doc_id", "text", "source") else f"__column_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    return renamed, lambda out: out.select(*(F.col(n).alias(c) for c, n in named.items()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; where nothing can be learnt all stay.

    Null and empty texts are scored as texts without words; repeated rows alike.
    """
    _settings(spark)
    own, back = _apart(docs)
    model = quality.train(own, queries.table(spark, sf_dir, "labels"))
    return back(quality.score(own, model, keep_columns=True).where("predicted = 1"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id; the rest of the rows go.

    Texts without words and rows without an id are in no group and stay.  Where
    ids repeat, every row is a document of its own and of each group the first
    by id, then text, stays (equal rows are one document).
    """
    _settings(spark)
    folder = shared_folder(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = ngram_join.similar_documents(docs, folder=folder)
        dropped = cut(found.where("component_id < doc_id").select("doc_id"), shared_folder(spark), "dropped")
        discard(spark, folder)
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    own, back = _apart(docs)
    row = cut(own.withColumn("__row", F.monotonically_increasing_id()), folder, "rows")  # written once, so the numbers hold
    known = row.where("doc_id is not null")
    found = ngram_join.similar_documents(known, id_col="__row", folder=folder).select(
        F.col("doc_id").alias("__row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group")
    )
    placed = known.select("__row", "doc_id", "text").join(found, "__row")
    group = F.coalesce(F.col("group").cast("string"), F.concat_ws(":", F.lit("none"), "doc_id", "text"))
    first = placed.groupBy(group.alias("g")).agg(F.min_by("__row", F.struct("doc_id", "text", "__row")).alias("__row"))
    kept = row.join(first.select("__row"), "__row", "left_semi").unionByName(row.where("doc_id is null"))
    return back(kept)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages; texts without words stay."""
    _settings(spark)
    own, back = _apart(docs)
    return back(contamination.decontaminate(own, queries.table(spark, sf_dir, "benchmark"), keep_columns=True).where("not contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its hash say, shuffled; rows with one id alike."""
    own, back = _apart(docs)
    return back(mix.poisson_mix(own, queries.WEIGHTS, size=queries.MIX_SIZE, seed="mix-1", describe=False))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as wavelet-matrix shards, and each document's place in them; copies of an id follow each other."""
    _settings(spark)
    return tokens.token_table(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's table goes when the next one is written."""
    docs, folder = queries.table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), folder, f"stage-{k}")
        if k:
            discard(spark, folder, f"stage-{k - 1}")
    return docs
