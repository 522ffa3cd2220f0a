"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet into the shared folder and hands the reread table to the next.
All but the last keep the columns of ``documents``; texts are whole, however
long. Toxicity and secrets are judged row by row, contamination by (id, text).
Near-duplicates are told by id: rows with a null id come after all others, known
by their text; of rows equal in id and text one stays, and if one of several
texts of an id is a copy, all of that id go. Null and empty texts are copies of
each other. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe, decontam, secrets, simhash, toxicity
from turnlake.llm.queries import word_vocabulary
from turnlake.llm.shared import shared_folder, stored


#: Columns that stages add for themselves.
_KEY, _SUM = "_pipeline_key", "_pipeline_sum"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the regression rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose five-word shingles are 0.8 or more the same as those of one that stays, of a lesser id."""
    # a null id is replaced by a number beyond all ids in use
    late = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = docs.withColumn(_KEY, F.coalesce(F.col("doc_id").cast("long"), late)).withColumn(_SUM, F.xxhash64("text"))
    extra = simhash.copies(keyed.select(F.col(_KEY).alias("doc_id"), "text")).select(F.col("doc_id").alias(_KEY)).distinct()
    kept = keyed.join(extra, _KEY, "left_anti")
    repeated = stored(keyed.groupBy(_KEY, _SUM).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_KEY, _SUM))
    if not repeated.isEmpty():
        once = kept.join(repeated, [_KEY, _SUM], "left_semi").dropDuplicates([_KEY, _SUM])
        kept = kept.join(repeated, [_KEY, _SUM], "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn(_KEY, F.xxhash64("doc_id", "text"))
    leaked = decontam.decontaminate(keyed, benchmark, id_col=_KEY).filter("contaminated").select(_KEY).distinct()
    return keyed.join(leaked, _KEY, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked; n_chars follows the new text."""
    blank = secrets.redact(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        blank = blank.withColumn("n_chars", length)
    return blank.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    coded = bpe.round_trip(docs, word_vocabulary())
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_redaction", redact_secrets),
    ("bpe_tokens", tokenize),
]

#: The stages use a learned model, a connected component search and a tokenizer.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a stage's table once the next one is written."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the last stage's table stays in the shared folder."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _remove(spark, before)
        before = f"{base}/{name}"
    return docs
