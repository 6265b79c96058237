"""A training corpus from ``documents``, in five stages.

Each stage is one operator of ``loamcube.llm`` on all that its predecessor kept; ``run`` writes a stage's
rows as Parquet to the shared folder and reads them again for the next. All stages but the last return the
columns of ``documents``, whatever others a table has. Whole texts are read, however long; an empty table comes out
empty, with empty ``labels`` nothing is toxic, with an empty ``benchmark`` nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamcube.llm import decontam, mixing, simhash, suffix_dedup, toxicity
from loamcube.llm._shared import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels of those here, doesn't call toxic.

    Null and empty texts and those without a label are scored like any other; repeated rows stay or go together.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8) the document of smallest id.

    Null, empty and wordless texts are one group, so one of them stays. Null ids come last; rows of equal id and text
    count as one document.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that stand elsewhere too; those with nothing left go.

    ``n_chars`` counts what is left. Texts that nothing was cut from stay as they are, null and empty ones too;
    rows of equal text, of 200 bytes or more, are each other's copies.
    """
    out = suffix_dedup.remove_repeats(docs)
    changed = F.col("sd_n_removed") > 0
    out = out.where(~changed | (F.length(F.trim("sd_text")) > 0))
    out = out.withColumns({"n_chars": F.when(changed, F.length("sd_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")), "text": F.when(changed, F.col("sd_text")).otherwise(F.col("text"))})
    return out.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words of a benchmark item in a row (or all of a shorter one).

    Null and empty texts hold none and stay; repeated rows stay or go together.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with ``size``, their source's ``target``, and the words ``taken``.

    A document is one row with its whole text, also where the mix takes part of it or repeats it: ``taken`` says how
    many words, up to three times its ``size``. Documents without words go; a null source is a source of its own; rows of
    equal id and text get the most that any of them takes.
    """
    mixed = mixing.mix(docs).groupBy("row_key").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("taken").alias("taken"))
    keyed = docs.withColumn("row_key", F.xxhash64(F.col("doc_id"), F.xxhash64("text")))
    return keyed.join(mixed.where("taken > 0"), "row_key").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]
#: No SQL fits a classifier; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
