"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of
documents. SQL can't express the near-duplicate components, the sampling or the packing,
so there is no ORACLE_SQL; tests/llm hold the stages against brute force instead. A stage's
table is removed once the next one's is written, so ``run`` leaves the last alone.

Odd rows, by stage (the modules say more):

* null and empty texts have no words, so the quality rules reject them, and no later stage
  sees any but those that lose all their lines. Those stay as empty texts, link with
  nothing, and the mix, for which they have no words, takes them as often as whole copies of
  their source are taken; packed, they are an end id alone;
* a null source is a source of its own (a site to the lines, the last to the mix); a null
  doc_id is carried through, and its documents are no one's near copies;
* very long texts are read whole everywhere and packed in as many pieces as they need;
* repeated rows count as rows: the near-duplicate stage keeps one of those that agree in id
  and text, with a null id all;
* ties: the document of the least id stays of a group of copies; where the mix ends within
  rows that tie in all that it reads, it takes as many of them as it needs;
* an empty table passes all stages and gives no pieces; columns of any other names are
  carried up to packing, which keeps doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard_join, line_dedup, packing, quality_rules, source_mix
from millrace.llm.common import chained


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rule cascade."""
    return quality_rules.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    return line_dedup.drop_boilerplate(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences, with their ids."""
    return packing.pack(docs)


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_lines), ("jaccard_join", drop_copies), ("source_mix", mix_sources), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return chained(docs, [(name, lambda rows, stage=stage: stage(spark, rows, sf_dir)) for name, stage in STAGES])
