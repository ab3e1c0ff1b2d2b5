"""A training-text pipeline of the operators in ``fablens.llm``.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablens.llm import decontaminate, encode, langid, pii, setjoin
from fablens.llm.common import checkpoint_folder, table

#: Near duplicates: five-word shingles, a Jaccard similarity of at least 0.8. (op9 has its own: three words and 0.9.)
NEAR_K, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no language: a null text, an empty one, or one without a letter.

    Learned from the rows whose id isn't held out and whose text and lang aren't null; with none of these, no document has a
    language. Every row is judged by its own text: repeated rows and null ids stay or go alike; of equal likelihoods the
    first language by name counts, which drops nothing. Whole texts are read; other columns pass as they are.
    """
    langs, probs = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    return langid.keep_known(docs, langs, probs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles connect, only the one of smallest id.

    Rows with equal id and text are one document, of which one row stays. Documents without an id or with equal ids and
    different texts take part too, after those with an id of their own. Texts that are null or have no word are in no group.
    Whole texts are read; other columns pass as they are, whatever their names.
    """
    return setjoin.first_of_groups(docs, k=NEAR_K, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the benchmark contaminates.

    A null or empty text is never contaminated. Repeated rows, equal ids and null ids are judged by their own texts. An empty
    benchmark drops nothing. Whole texts are read; other columns pass as they are, whatever their names.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars is that of the text as it is now.

    Every row stays. A null text stays null, with its n_chars. Repeated rows, equal ids and null ids are changed by their own
    texts. Of overlapping spans the first names the kind; equal scores of patterns go to the first kind by name. Whole texts
    are read, in time in proportion to their length; other columns pass as they are, whatever their names.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each document.

    A null text has no tokens; repeated rows and null ids stay; an empty table gives an empty one; only doc_id and text are
    read.
    """
    return encode.encode_digests(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can express neither the mixture inference nor the bootstrapping; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
