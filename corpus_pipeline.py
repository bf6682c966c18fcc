"""A corpus pipeline over ``documents``: the stages in order, and ``run`` that applies them all."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.frames import packed, quoted, shared_table, text_key, unpacked
from viewforge.llm.lines import drop_boilerplate
from viewforge.llm.near_copies import keep_one
from viewforge.llm.packing import pack_along_curve
from viewforge.llm.postings import decontaminate
from viewforge.llm.rule_ensemble import score_quality

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts are scored like all others; repeated rows are scored alike and stay or go together.
    Columns come back as they were, whatever their names; an empty table stays empty.
    """
    columns = {f"kept_{i}": quoted(c) for i, c in enumerate(docs.columns)}
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), **columns)
    return scored.where("predicted = 1").select(*(F.col(k).alias(c) for k, c in zip(columns, docs.columns, strict=True)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that their source repeats on more than a tenth of its pages; ``n_chars`` follows the text.

    Rows without a text or a source stay as they are; repeated rows are pages of their own. Other columns come back as
    they were, whatever their names, and ``n_chars`` need not be there; an empty table stays empty.
    """
    cut = drop_boilerplate(packed(docs, text=quoted("text"), source=quoted("source")), host="source", ratio=0.1, min_pages=3)
    own = lambda c: F.col("row").getField(c)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(own("n_chars")).cast("long")
    return cut.select(*(changed.get(c, own(c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    Empty texts are copies of one another, and so are repeated rows; columns come back as they were.
    """
    return keep_one(docs, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten consecutive benchmark words.

    Null and empty texts have no words and stay; equal texts stay or go together. Columns come back as they were, whatever
    their names; an empty table stays empty, and without benchmark items all rows stay.
    """
    keyed = docs.select(text_key(quoted("text")).alias("key"), quoted("text").alias("text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(keyed, items, window=10, carry=["key"]).where("contaminated").select("key").distinct()
    dirty = shared_table(found, "contaminated")
    return unpacked(packed(docs, key=text_key(quoted("text"))).join(dirty, "key", "left_anti"), docs.columns, [])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, neighbours on the curve side by side.

    Null texts count as empty and give the end token alone; repeated rows are packed each; an empty table gives no pieces.
    """
    return pack_along_curve(docs.select("doc_id", "text"), TOKENIZER, end_id=2, length=4096, by_word=True).drop("ids")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pack", pack)]

#: Tokenising cannot be written in SQL; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = shared_table(docs, f"pipeline-{name}")
    return docs
