"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import completion, fim, packing, runs, urlfilter, warc
from ragloom.llm.chat import parsed_conversations
from ragloom.llm.common import table
from ragloom.llm.decontamination import contaminated
from ragloom.llm.langid import language_report
from ragloom.llm.quality import quality_rules
from ragloom.llm.secrets import secret_report
from ragloom.llm.simhash import near_duplicates
from ragloom.llm.toxicity import toxicity_scores


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_conversations(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(table(spark, sf_dir, "documents"))


def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completion.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_url_filters, op4_warc, op5_simhash, op6_secret_scans, op7_language_id, op8_quality_rules, op9_decontamination, op10_chat_formatting, op11_periodic_runs, op12_fill_in_middle, op13_bin_completion)}


ORACLE_SQL: dict[str, str] = {"op3_url_filters": urlfilter.oracle_sql(), "op11_periodic_runs": runs.ORACLE_SQL, "op12_fill_in_middle": fim.ORACLE_SQL}
