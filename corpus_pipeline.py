"""The corpus cleaning pipeline: five stages over documents, each written as Parquet and read again.

1. toxicity: documents scored 0.5 or more by the positive-unlabelled classifier go.
2. near duplicates: of each component of documents whose five-word shingle sets are 0.8 similar or more, the
   one with the least doc_id stays; rows that repeat a doc_id or have none count each for itself.
3. decontamination: documents with benchmark windows over a twentieth or more of their words go.
4. secrets: found secret values are replaced by a mark; n_chars follows the text.
5. packing: texts are tokenised and packed into sequences of 1024 tokens.

The last stage gives a row per piece, the others the columns of documents. An empty table passes
through all of them; null texts count as empty, rows that repeat a doc_id are judged each by its own text, and other
columns are carried along. ORACLE_SQL is None: classifiers, the random field and the packer are not
expressible in SQL; the tests compare the near-duplicate stage and the packer with brute force, and of the others columns and row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, jaccard_join, packing, secrets, toxicity
from plumbline.llm.saved import saved

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, "toxic_score").where("toxic_score < 0.5").select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row_id, a number of each row's own: in the order of doc_id (null last), then of the hashes of the text and the other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.asc_nulls_last("doc_id"), F.sha2("text", 256).asc_nulls_last(), *([F.xxhash64(*others)] if others else []), "row_id"]
    placed = docs.withColumn("row_id", F.monotonically_increasing_id()).orderBy(*order)
    return saved(placed.withColumn("row_id", F.monotonically_increasing_id()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the least by doc_id (null last), then by the hash of the text, then by those of
    the other columns; rows equal in all of them are numbered. Each row counts for itself, whatever rows share its id or have none;
    a text without words is near to nothing and stays."""
    unsure = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count() > 0
    rows, key = (_numbered(docs), "row_id") if unsure else (docs, "doc_id")
    found = saved(jaccard_join.join_components(rows.select(F.col(key).alias("doc_id"), "text"), 5, 80, 100))
    gone = jaccard_join.few(found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact(secrets.scan(docs, secrets.train(docs)))
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
