"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import common, decontaminate, jaccard, langid, packing, pii

#: Texts whose best language has less than this share of their words are rejected, as are those without letters.
LEAST_SCORE = 0.3


#: Columns that stages read or bring up to date; all others only pass through.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def passes_others(stage):
    """A stage that never sees columns beyond OWN under their names, so that they can't clash with an operator's."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in OWN]
        out = stage(spark, docs.withColumnsRenamed({c: f"other column {i}" for i, c in enumerate(others)}), sf_dir)
        return out.withColumnsRenamed({f"other column {i}": c for i, c in enumerate(others)})

    return run


@passes_others
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; a null lang becomes the predicted one."""
    seen = langid.identify(docs, langid.train(docs))
    kept = seen.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@passes_others
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the smallest doc_id."""
    return jaccard.one_of_each(docs)


@passes_others
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; documents of which nothing is left go."""
    clean = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), mode="spans")
    return _counted(clean).filter(F.col("text").isNull() | F.col("text").rlike(r"\S"))


@passes_others
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact personal data in the texts; every document stays."""
    seen = common.stash(pii.scan(docs), "pii-seen")
    return _counted(pii.redact_seen(seen, pii.learn(seen)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    placed = packing.pack_documents(docs, with_ids=False)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language id", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("best-fit packing", pack),
]

#: Learned models and packing are beyond SQL. A test runs the stages one by one, each on what the one before kept:
#: near-duplicates and benchmark passages against brute force, packing by its places and lengths, language and personal
#: data by what they must keep and must not leave.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
