"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import dual_tree, filter_audit, mixing, spotsigs, url_rules
from .common import table
from .gru_lm import score_documents
from .language_cnn import identify_languages
from .ngram_join import join_ngrams
from .quality import quality_rules
from .rans import ids_round_trip
from .secret_scan import scan_secrets
from .tier_packing import pack_documents
from .vp_trees import join_simhash

TOKENIZERS = "/opt/tokenizers"  # folder of the public vocabularies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by base rules and the fitted model."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files and read back."""
    return ids_round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


@query("op3_url_filters", url_rules.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL held against the rules."""
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), url_rules.rule_frame(spark, url_rules.RULES))


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole document."""
    return score_documents(table(spark, sf_dir, "documents"))


@query("op5_fingerprints", spotsigs.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot signatures of every text and of its edited form."""
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents."""
    return join_ngrams(table(spark, sf_dir, "documents"))


@query("op8_mixing", mixing.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the source weights."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op9_secret_scans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text."""
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    return identify_languages(table(spark, sf_dir, "documents"))


@query("op11_filter_audit", filter_audit.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, under every order."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_ranked_search", dual_tree.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return dual_tree.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_simhash_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups of near ones."""
    return join_simhash(table(spark, sf_dir, "documents"))
