"""A training corpus from documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molsurf.llm import language_id, mixing, packing, simhash, toxicity
from molsurf.llm.common import SMALL, checkpointed, partitions, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain holds for toxic go."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), chain).where(~toxicity.is_toxic(chain)).select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: without letters, or of a low score."""
    model = language_id.train(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    return language_id.predict(docs.select(*COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.LEAST_SCORE)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one document stays, of least doc_id; texts of one id that differ are documents of their own."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows in the order of the mixture."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.repartitionByRange(partitions(spark), "_slot", "doc_id").sortWithinPartitions("_slot", "doc_id").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences, numbered in the order of the mixture.

    The mixture's order is that of files and their rows. Where files do not tell their order, sequences have any numbers.
    """
    numbers = [re.search(r"part-(\d+)[^/]*$", f) for f in docs.inputFiles()]
    if not numbers or not all(numbers) or len({int(m[1]) for m in numbers}) < len(numbers):
        return packing.pack(docs)
    placed = docs.select(*COLUMNS, F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # rows are numbered through the files: a file's first number is the count of rows in the files before it
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))
    first = checkpointed(sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    placed = placed.join(F.broadcast(first) if len(numbers) <= SMALL else first, "_file")
    return packing.pack(placed, order=F.col("_first") + F.col("_at"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_dedup", drop_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Trained models, fingerprints and a tokenizer are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote goes once the next one has been written."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline_{uuid.uuid4().hex}"
    written = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{top}/{k}_{name}")
        docs = spark.read.parquet(path)
        if written:
            gone = spark._jvm.org.apache.hadoop.fs.Path(written)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        written = path
    return docs
