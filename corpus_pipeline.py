"""Corpus preparation: five stages over the documents table, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix_documents
from tessera.llm.packing import pack
from tessera.llm.quality import quality_rules
from tessera.llm.queries import tokenizer_file
from tessera.plans.scratch import Scratch
from tessera.llm.substrings import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts that do.

    Null and empty texts fail; a null source is a host of its own; each repeated row is judged; an empty table stays empty.
    """
    return quality_rules(docs).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of similarity 0.8 or more; of repeated rows, one.

    Documents without a doc_id take a hash of their text beyond all ids in its place, so copies of them go too.
    """
    key = F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(2**61 - 1) + 2**62)
    keyed = docs.select(*COLUMNS, key.alias("row_key"))
    kept = near_duplicates(keyed, id_col="row_key", percent=80).where("kept").groupBy(F.col("doc_id").alias("row_key")).agg(F.count("*").alias("times"))
    # Only texts of repeated ids are told apart by their contents.
    content = F.when(F.col("times") > 1, F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise("")
    return keyed.join(kept, "row_key").withColumn("content", content).dropDuplicates(["row_key", "content"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that occur earlier; texts of which nothing is left, null ones too, go.

    Rows without a doc_id, and all but one of unequal texts that share one, stand behind all documents in a fixed order, so
    what they repeat goes from them. Repeated rows are one document. An empty table stays empty.
    """
    left = remove_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return left.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; each round over a source gives its documents anew.

    A null source is a source of its own; texts without words are in no mix; repeated rows are documents of their own; an
    empty table stays empty.
    """
    return mix_documents(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 4096; each row of its own, with its doc_id or without."""
    return pack(docs, tokenizer_file=tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed),
]

#: Permutations and packing have no equivalent in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents in sf_dir; no rows of an empty table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs
