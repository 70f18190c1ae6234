"""Training-data pipeline over documents: toxicity, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before
the next one reads it. All but the last return the columns of documents, whatever they are called. Null and empty
texts are clean, free of secrets and of benchmark words, and copies of each other; keys may be null or repeated: rows
are judged one by one. Very long texts are read whole; an empty table stays empty through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orospark.llm.common import discard, new_path, scratch, table
from orospark.llm.decontaminate import find_contamination
from orospark.llm.packing import WORD_BPE, pack_documents
from orospark.llm.secrets import fit_on, mask
from orospark.llm.simhash import deduplicate
from orospark.llm.tokens import tokenizer_path
from orospark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labels, or with those of held-out documents only, all stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, of the least doc_id; ties and repeated rows as in deduplicate()."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in benchmark windows go. Benchmark rows without a text
    have no windows, those without an id have; an empty benchmark lets all stay."""
    names = [f"_orospark_{k}" for k in range(len(docs.columns))]  # so no column of docs clashes with the operator's
    found = find_contamination(docs.toDF(*names), table(spark, sf_dir, "benchmark"), text=names[docs.columns.index("text")], only_clean=True)
    return found.select(*names).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays, null texts null."""
    return mask(docs, fit_on(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null or empty text is one piece, its end id."""
    return pack_documents(docs, tokenizer_path(WORD_BPE))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontamination), ("secret_scans", secret_scan), ("packing", packing)]

#: Fitted models and tokenizers: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output, and its steps, are deleted once the next one is written; what the result is
    read from stays (see scratch())."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        discard(docs)
        docs = spark.read.schema(kept.schema).parquet(path)
        docs._orospark_path = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
