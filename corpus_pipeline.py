"""A corpus pipeline of five stages over ``documents``.

Each stage works on all its predecessor kept and is written as Parquet before the next reads
it. The first four return the columns of ``documents``; the last returns token ids.

Ids may be null or repeat: stages that look rows up by id work on a key of their own (``_keyed``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomtide import ship
from loomtide.llm import bpe, mixing, setsketch, suffixes, toxicity
from loomtide.llm.storage import cut, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, which no two rows share: the id, where only one row has it.

    Rows whose id is null or repeated have a hash of all columns and of their number among equal
    rows, in 64 bits, and are written once with the rest; where there are none, nothing is written.
    Rows equal in all columns are numbered in one task.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is null or rows > 1")
    if ids.isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    ids = cut(ids.select("doc_id"), "ids")
    plain = docs.join(ids, "doc_id", "left_anti").where("doc_id is not null").withColumn("row_key", F.col("doc_id").cast("long"))
    odd = docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
    # A hash skips nulls, so it takes their places too.
    nulls = F.array(*(F.col(c).isNull() for c in docs.columns))
    odd = odd.withColumn("_h", F.xxhash64(F.lit(53), nulls, *docs.columns))
    number = F.row_number().over(Window.partitionBy("_h").orderBy("_h"))
    odd = odd.withColumn("row_key", F.when(number == 1, F.col("_h")).otherwise(F.xxhash64(F.lit(59), "_h", number))).drop("_h")
    return cut(plain.select(*docs.columns, "row_key").unionByName(odd.select(*docs.columns, "row_key")), "keyed")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic by the threshold of their language, also those without an id."""
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(~F.col("toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, where ids are whole.

    Rows with a null or repeated id stand by their key. Of equal rows one is kept at most, also of those without words.
    """
    ship(spark)
    rows = _keyed(docs)
    kept = setsketch.near_duplicates(rows, id_col="row_key").where("kept").select(F.col("doc_id").alias("row_key"))
    left = rows.join(kept, "row_key", "left_semi").select(*COLUMNS)
    return left.dropDuplicates() if "_cut_path" in vars(rows) else left


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 bytes or more that a smaller document has too.

    Documents are in order of their ids; rows with a null or repeated id are in the order of their keys.
    """
    ship(spark)
    rows = _keyed(docs)
    left = suffixes.remove_repeats(rows, id_col="row_key", as_text=True).select(F.col("doc_id").alias("row_key"), F.col("kept").alias("text"))
    out = rows.drop("text", "n_chars").join(left, "row_key")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in the order of shards and turns within them.

    Rows with a null or repeated id are documents of their own, each taken as often as the mix says.
    """
    ship(spark)
    rows = _keyed(docs)
    stream, _ = mixing.mix(rows, id_col="row_key")
    taken = stream.select(F.col("doc_id").alias("row_key"), "shard", "turn", "copy")
    return rows.join(taken, "row_key").repartition("shard").sortWithinPartitions("shard", "turn", "row_key").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, also of null and repeated ids, and whether decoding them gives the text back."""
    import public_tokenizers

    ship(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), path, pattern, verify=True)
    return rows.select("doc_id", "lang", "source", F.size("token_ids").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The toxicity stage is a trained classifier, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/loomtide/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
