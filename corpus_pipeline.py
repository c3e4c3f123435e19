"""A corpus pipeline of five stages: each takes the documents that the stage before it left, written and read again.

Toxic documents go, one document of each group of near-duplicates stays, personal data gets pseudonyms, sources are
mixed to their target weights and the result is tokenised. Null texts, empty texts and repeated rows are treated as
the operators' docstrings say; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.llm import bpe, mixing, neardup, pii, toxicity
from sagitta.llm.common import counted, cut, fresh, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the scorer, learned from the labels that may be learned from, calls clean.

    A document is judged by its own text, also if others have its id. Only ids and hashes of texts come back.
    """
    model = toxicity.learn(spark, docs, sf_dir)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return without(docs, toxicity.scored(keyed, model, extra=["key"]).where("score >= 0.5").select("doc_id", "key").distinct())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row: of the smallest id, null only if there is no other, and of that id's texts one.

    Documents without words are in no group; of their rows that are equal in id and text one stays as well. Only ids and hashes
    of texts move between tasks: what is to go goes to the documents if it is few rows enough, and only rows that repeat are
    compared by their texts.
    """
    found, _, most = counted(neardup.survivors(docs), "survivors", F.max(F.expr("if(kept, rows, 0)")))
    out = without(docs, found.where("not kept"))
    if (most or 0) < 2:
        return out
    repeated = found.where("kept and rows > 1")
    return without(out, repeated).unionByName(without(out, found.where("rows = 1 or not kept")).dropDuplicates(["doc_id", "text"]))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows of those pairs of doc_id, null being one, and key, the text's hash.

    What is gone goes to all executors if it is few rows, else the documents are dealt by id and key.
    """
    id_, key = fresh(docs, "gone_id", "gone_key")
    gone, n = counted(gone.select(F.col("doc_id").alias(id_), F.col("key").alias(key)), "gone")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    return docs.join(neardup.sent(gone, n), same, "left_anti")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts and n_chars to match."""
    out = pii.pseudonymised(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document its number of tokens, its ids and the digests of the ids and of the bytes that they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: Scoring toxicity is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents on; each result but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
