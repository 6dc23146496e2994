"""The operators over their whole tables, each registered with the SQL that says the same where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import (
    decontaminate, html_text, langid, line_dedup, ngram_model, oracles, pieces, pii, quality, resampling,
    secret_scan, sharding, simhash, whitening,
)
from tracewright.session import app_dir

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Runner) -> Runner:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_virtual_slots")
def _(spark, sf_dir):
    return sharding.assigned(_table(spark, sf_dir, "documents"))


@query("op2_ngram_trie")
def _(spark, sf_dir):
    return ngram_model.document_scores(_table(spark, sf_dir, "documents"))


@query("op3_pseudonyms")
def _(spark, sf_dir):
    return pii.pseudonymized(_table(spark, sf_dir, "documents"))


@query("op4_quality_rules", oracles.quality_sql())
def _(spark, sf_dir):
    return quality.verdicts(_table(spark, sf_dir, "documents"))


@query("op5_sentencepiece")
def _(spark, sf_dir):
    return pieces.round_trips(_table(spark, sf_dir, "documents"))


@query("op6_language")
def _(spark, sf_dir):
    return langid.identified(_table(spark, sf_dir, "documents"))


@query("op7_secrets", oracles.secrets_sql())
def _(spark, sf_dir):
    # A new ledger: this run meets every content for the first time.
    folder = f"{app_dir(spark)}/ledger-{uuid.uuid4().hex}"
    return secret_scan.found_secrets(_table(spark, sf_dir, "documents"), folder)


@query("op8_main_text")
def _(spark, sf_dir):
    return html_text.extracted(_table(spark, sf_dir, "pages"))


@query("op9_simhash")
def _(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", simhash.as_hex("fingerprint"))


@query("op10_decontamination")
def _(spark, sf_dir):
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op11_line_bitmaps", oracles.lines_sql())
def _(spark, sf_dir):
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


@query("op12_whitening")
def _(spark, sf_dir):
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


@query("op13_importance_resampling", oracles.resampling_sql())
def _(spark, sf_dir):
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
