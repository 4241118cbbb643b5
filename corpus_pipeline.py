"""From raw documents to packed sequences, in stages that each apply one operator of ashlar.llm.

Every stage takes all rows that the stage before kept, as written and reread Parquet, and its decisions take effect:

1. ``quality``: rows that the base rules or their group's fences reject go. Null and wordless texts fail the base rules;
   null ``lang`` and ``source`` are groups of their own; equal rows stay or go together.
2. ``near_duplicates``: of each class of linked documents the row of the least id stays, and of rows equal in id and text
   one. Rows of null id stay (one for each text); a null or wordless text is linked with nothing and stays.
3. ``repeated_substrings``: strings of 200 bytes that start twice or more are taken out of the texts, whole characters
   only; ``n_chars`` is counted again (null becomes a number), and documents of which nothing but white space is left go,
   so null and empty texts go.
4. ``decontamination``: documents that benchmark windows cover to a twentieth or more go; null texts and null ids stay.
5. ``packing``: the token ids of what is left, cut into sequences; a row for each piece. A null text is the end id alone.

Texts of any length are taken whole. All stages but the last return the columns of their input, more columns than those
of ``documents`` and of any names included. A stage without rows gives none; equal rows are each packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import decontaminate, packing, quality, shingle_join, substrings, tokens
from ashlar.llm.common import discard, made, shared_dir, ship, stored, sweep, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return shingle_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    left = substrings.remove(docs).withColumn("n_chars", F.length("text").cast("long"))
    return left.filter(F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]"))).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.op5(docs, tokens.vocabulary("byte_bpe_50k.json"), lean=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the shingle components, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and reread. What a stage has written besides goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    at = shared_dir(spark)
    before = None
    for name, stage in STAGES[:-1]:
        since = made()
        docs = stored(stage(spark, docs, sf_dir), f"{at}/{name}")
        sweep(spark, since)
        if before:
            discard(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
