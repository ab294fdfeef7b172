"""The corpus pipeline: language, quality, lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept,
and returns the columns of documents (the last one the packed pieces).  ``run`` writes
every stage's rows to the shared folder and reads them again.  The models are trained on
the rows that the stage gets, by the rules of the operators.

Defined results of every stage: an empty table gives an empty one; further columns pass
through whatever their names, also names that the operators use themselves; rows without
an id are judged by their text like others.  A null or empty text has no language, so the
first stage drops it; later stages treat it as a text without characters, which the lines
stage returns as it came.  Equal rows: the first two stages keep all or none of them, the
lines stage leaves only the first its lines, the near-duplicate stage keeps one row of a
group (the smallest doc_id, then the smallest text; rows without an id only if no row of
the group has one), and packing packs each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, linededup, packing, quality, simhash
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.runtime import keyed, stored

LEAST_LANGUAGE_SCORE = 0.3


def _carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row): what an operator reads, and the whole row out of reach of its names."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a known language stay; those without letters or like none of them go."""
    scored = language.predict(_carried(docs), language.train(docs))
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier takes for good ones stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(_carried(docs), model).where("predicted = 1").select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the lines that stand earlier in the corpus: copies of any
    length, and lines of 10 characters or more within two edits of an earlier one."""
    kept = linededup.dedup(docs, counts=False)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, a null being the
    largest, and of rows with equal ids the one whose columns' hash is the smallest."""
    prints = stored(simhash.fingerprints(keyed(docs).select("doc_id", "text", "r1", "r2"), ["r1", "r2"]), "prints")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    first = prints.join(simhash.groups(prints), "fp").groupBy("group").agg(F.min(name).alias("name"))
    kept = first.select("name.r1", "name.r2")
    # Rows that are equal in every column are one here, so one of them stays.
    rows = keyed(docs).groupBy("r1", "r2").agg(F.first("row").alias("row"))
    return rows.join(kept, ["r1", "r2"], "left_semi").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Models and tokenizers aren't SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
