"""From raw documents to token ids: five stages, each over everything its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``. ``run`` writes each
stage's result to the shared folder and reads it back, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import bpe, classifier, decontamination, lines, simhash
from feedloom.llm.common import set_aside, table
from feedloom.llm.queries import quality_model
from feedloom.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at one half or more.

    Null and empty texts have the model's prior as score; repeated rows are judged alike. An empty table stays empty, and without labels for the texts
    at hand everything stays.
    """
    docs, restore = set_aside(docs, "_llm_score")
    scored = classifier.score(docs, quality_model(spark, docs, sf_dir), score_col="_llm_score")
    return restore(scored.where("_llm_score >= 0.5").drop("_llm_score"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of line runs of 50 words or more; ``n_chars`` follows the text.

    Every row stays, with a text that may become empty; null texts stay null. The copy of the smallest doc_id is the first one, null ids come last.
    """
    return lines.drop_repeated_lines(docs, count_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    Texts without words, null ones included, are one group. Rows that repeat id and text leave one; a row without id stays only where its group has no id.
    """
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay; repeated rows are judged alike. Without items everything stays.
    """
    docs, restore = set_aside(docs, *decontamination.OUT)
    marked = decontamination.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return restore(marked.where("n_hit = 0").select(*[f"`{c}`" for c in docs.columns]))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with digests of the ids and of what they decode to.

    One row per row, in the columns of ``bpe.encode_texts``; other columns end here. Null texts count as empty and have no ids.
    """
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenise", tokenise)]
#: Training and greedy merging are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
