"""The corpus pipeline: five stages from raw documents to token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, line_dedup, quality_gam, simhash
from tablewright.llm.common import full_text, packed, written
from tablewright.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores 0.3 or more; NULL text counts as empty. Columns may have any names."""
    return quality_gam.keep_good(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later repeats of runs of lines; n_chars, where it is a column, is that of the new text."""
    edited = line_dedup.edited(docs)

    def column(name: str):
        own = F.col("row").getField(name)
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(own).alias(name)
        return own.alias(name)

    return edited.select(*map(column, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of smallest (doc_id, hash of the text), NULL ids last.

    Rows are told apart by a number written with them, not by their id; of equal rows one stays. Columns may have any
    names.
    """
    numbered = written(docs.select(packed(docs).alias("row"), F.monotonically_increasing_id().alias("number")))
    doc_id, text = F.col("row").getField("doc_id"), F.col("row").getField("text")
    place = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.xxhash64(full_text(text)).alias("body"),
                     F.xxhash64("row").alias("whole"), "number")
    groups = simhash.simhash_groups(numbered.select(place.alias("place"), text.alias("text")), id_col="place")
    first = groups.filter(F.col("doc_id.number") == F.col("component_id.number")).select("doc_id.number")
    return numbered.join(first, "number", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without text hold none. Columns may have any names."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of byte-level BPE ids), decoded_sha256 of the bytes that the ids decode to.

    NULL text counts as empty and has no ids; other columns are left out.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [("quality", _shipped(quality)), ("line dedup", _shipped(lines)), ("near copies", _shipped(near_copies)),
          ("decontamination", _shipped(leaks)), ("token ids", _shipped(token_ids))]

#: The model, the component search and the merges are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
