"""The corpus pipeline: quality rules, line dedup, near-duplicate dedup, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes and rereads as the
next stage's ``docs``. All but the last return the columns of ``documents``, the mixing stage's rows in the order of its
block permutation; the last returns token counts and digests, one row for each row the mix shows.

Defined results: the quality stage rejects texts of fewer than 20 words, null and empty ones with them; a null source is
a source; a null doc_id goes through and is a copy of nothing; texts of any length are read whole in every stage; of
documents linked as near copies the smallest doc_id stays; fully repeated rows are judged alike, stay together where their
group's smallest id is theirs, and are shown each; ties in the mix are settled by id and text; an empty table gives
an empty result; columns besides those of ``documents``, of any name, go along untouched up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trigrid.llm import bpe, linededup, mixing, neardup, quality
from trigrid.llm.common import Workspace, table

#: Similarity in hundredths from which the stage links.
NEARDUP_THRESHOLD = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean_documents(docs, Workspace(spark))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_representatives(docs, Workspace(spark), NEARDUP_THRESHOLD)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, Workspace(spark))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("neardup", neardup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Rolling-hash verdicts, minhash components, hash permutations and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
