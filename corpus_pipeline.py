"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Every stage takes nulls in any column, empty texts and texts of any length, repeated rows, an empty table (which gives
an empty one) and columns beyond those of documents, whatever their names; all but the last return the columns they
were given. What a stage does with such rows beyond that is in its own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm import toxicity
from karst.llm.common import Workspace, table
from karst.llm.mixing import mixed_documents
from karst.llm.near_dups import near_duplicates
from karst.llm.packing import pack
from karst.llm.pii import personal_data, sanitised

#: Stages change, drop and repeat documents by learnt models and hashes, which SQL can't express.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold. Null and empty texts stay; repeated rows go or stay together."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id. Rows without an id stay; of rows
    that share an id one stays; texts without words are like nothing and stay."""
    work = Workspace(spark, "pipeline-dedup")
    found = work.keep(near_duplicates(work, docs), "found")
    copies = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    left = docs.join(copies, "doc_id", "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        left = left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and terms that disclose it replaced; n_chars is that of the new text. Null
    texts become empty; repeated rows stay as often as they are there."""
    clean = sanitised(personal_data(Workspace(spark, "pipeline-pii"), docs))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as drawn, the last time perhaps in part. Repeated rows are drawn each by
    itself, documents without words stay once, a null source is a source."""
    return mixed_documents(Workspace(spark, "pipeline-mix"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences, with their ids. Null and empty texts are their end id alone; repeated rows are packed
    as often as they are there."""
    import public_tokenizers

    return pack(Workspace(spark, "pipeline-pack"), docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last stage's rows."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, work.keep(stage(spark, docs, sf_dir), name)
        work.drop(before)
    return docs
