"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import (
    divergence,
    exact_dedup,
    host_rules,
    html_render,
    language_id,
    line_dedup,
    minhash_forest,
    mixing,
    packing,
    pii,
    token_counts,
    va_file,
    vector_graph,
)
from lodegraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(exact_dedup.SQL)
def op8_exact_dedup(spark, base):
    return exact_dedup.groups(table(spark, base, "documents"))


@query()
def op10_language_id(spark, base):
    return language_id.identify(table(spark, base, "documents"))


@query()
def op5_token_counts(spark, base):
    return token_counts.token_counts(table(spark, base, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op7_mixture_packing(spark, base):
    return packing.pack(table(spark, base, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(line_dedup.SQL)
def op1_line_dedup(spark, base):
    return line_dedup.line_dedup(table(spark, base, "documents"))


@query()
def op9_personal_data(spark, base):
    return pii.personal_data(table(spark, base, "documents"))


@query()
def op4_minhash_forest(spark, base):
    return minhash_forest.near_copies(table(spark, base, "documents"))


@query(mixing.SQL)
def op2_source_mixing(spark, base):
    return mixing.sampled(table(spark, base, "documents")).withColumn("probability", F.round("probability", 9))


@query()
def op3_vector_graph(spark, base):
    return vector_graph.near_vectors(table(spark, base, "embeddings"))


@query()
def op6_html_rendering(spark, base):
    return html_render.extract(table(spark, base, "pages"))


@query(host_rules.SQL)
def op11_host_rules(spark, base):
    return host_rules.document_rules(table(spark, base, "documents"))


@query(va_file.SQL)
def op12_va_file(spark, base):
    return va_file.clusters(table(spark, base, "embeddings"))


@query(divergence.SQL)
def op13_source_divergence(spark, base):
    return divergence.divergence(table(spark, base, "documents"))
