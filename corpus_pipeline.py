"""The corpus pipeline: stages over documents, each writing what it keeps for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm import chosenpath, decontam, linededup, packing, quality
from treeline.llm.common import unused, written
from treeline.llm.queries import tokenizer_path


def carried(docs: DataFrame, names: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a step makes of ``docs``, with their columns; those of names that the step gives to its own columns are put by."""
    away = {c: unused(docs, f"_{c}") for c in docs.columns if c.lower() in names}
    out = step(docs.withColumnsRenamed(away))
    return out.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows with a null id or without words are scored like any other."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return carried(docs, ("quality_score", "quality_predicted"), lambda rows: quality.score(rows, model).where(F.col("quality_predicted") == 1))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; every row stays with the text that is left, rows with a null id or text too."""
    left = carried(docs, ("lines", "removed_lines"), linededup.dedup)
    return left.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal or similar texts one row stays: that with the least doc_id (null ids last), then the least MD5 of its text.

    Rows are told apart by id and text, so a row goes only for its own text,
    whatever other rows have its id. Of rows that share both, the one whose
    other columns come first (written as JSON) stays. A text without words is
    similar to no other and goes for no other row's sake.
    """
    key, gone_id, gone_key, place = (unused(docs, c) for c in ("_key", "_gone", "_text", "_place"))
    rows = docs.withColumn(key, F.md5("text"))
    classes = written(chosenpath.join(docs))
    own = lambda where: classes.where(where).select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key))
    same = F.col(f"`{key}`").eqNullSafe(F.col(f"`{gone_key}`")) & F.col("doc_id").eqNullSafe(F.col(f"`{gone_id}`"))
    left = rows.join(own("NOT kept").distinct(), same, "left_anti")
    # Few inputs hold the same row twice; only then its rows, not the others, are brought together.
    twice = own("kept").groupBy(gone_id, gone_key).count().where("count > 1").drop("count")
    if not twice.isEmpty():
        order = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
        first = Window.partitionBy("doc_id", F.col(f"`{key}`")).orderBy(order)
        repeated = left.join(twice, same, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(f"`{place}`") == 1).drop(place)
        left = left.join(twice, same, "left_anti").unionByName(repeated)
    return left.drop(key)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; each row is judged by its own text, whatever its id."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of what is left, with its sequence; ids may be null or repeat, each row is packed by itself."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The trained stages and the packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
