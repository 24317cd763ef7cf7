"""Graph views over a relational star schema with text tables.

Lets the graph operations run on tables that were never modelled as a graph:
orders act as documents, parts as materials, supplier nations as processes,
and so on. `records` is the order graph, `texts` the document graph and
`dialogues` the conversation graph.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.chunking import chunk_single_units
from lodegraph.graph import Frames, Graph


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def _text(name: str) -> F.Column:
    return F.col(name).cast("string")


def line_source() -> F.Column:
    return F.concat_ws(":", _text("l_orderkey"), _text("l_linenumber"))


def records(spark: SparkSession, base: str) -> Graph:
    t = cache(lambda name: table(spark, base, name))

    def mention(df: DataFrame, label: str, target: str) -> DataFrame:
        # keys are grouped in their stored type and become text afterwards
        grouped = df.groupBy("l_orderkey", target).agg(
            F.count(F.lit(1)).alias("count"), F.max("l_linenumber").alias("l_linenumber"))
        return grouped.select(
            _text("l_orderkey").alias("src_id"), F.lit(label).alias("dst_label"), _text(target).alias("dst_id"),
            "count", line_source().alias("source"))

    @cache
    def nations() -> DataFrame:
        return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name")

    @cache
    def by_part() -> DataFrame:
        part = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
        return t("lineitem").join(part, "l_partkey")

    def mentions() -> DataFrame:
        lines = t("lineitem")
        return (
            mention(lines, "Material", "l_partkey")
            .unionByName(mention(lines.join(nations(), "l_suppkey"), "Process", "n_name"))
            .unionByName(mention(by_part(), "Equipment", "p_brand"))
            .unionByName(mention(lines.join(nations(), "l_suppkey"), "Facility", "s_name"))
        )

    @cache
    def measurements() -> DataFrame:
        return t("lineitem").select("*", "_metadata.row_index").select(
            F.concat(line_source(), F.lit(":M"), _text("row_index")).alias("id"),
            _text("l_orderkey").alias("doc_id"),
            F.concat(F.lit("quantity "), "l_returnflag").alias("property"),
            F.col("l_quantity").alias("value"),
            (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("value_max"),
            F.col("l_linestatus").alias("unit"),
            F.lit(None).cast("string").alias("conditions"),
            line_source().alias("source"),
            F.concat(F.lit("line "), _text("l_linenumber")).alias("place"),
        )

    def materials() -> DataFrame:
        flags = t("labels").select(F.col("doc_id").alias("p_partkey"), (F.col("quality") == 0).alias("needs_review"))
        return t("part").join(flags, "p_partkey", "left").select(
            _text("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("grade"),
            F.col("p_type").alias("kind"), "needs_review")

    def about() -> DataFrame:
        owners = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("user_id"), "n_name")
        return t("events").join(owners, "user_id").select(
            _text("event_id").alias("src_id"), F.lit("Process").alias("dst_label"), F.col("n_name").alias("dst_id"))

    return Graph(
        nodes=Frames({
            "Document": lambda: t("orders").select(
                _text("o_orderkey").alias("id"), F.concat(F.lit("Order "), _text("o_orderkey")).alias("title"),
                F.col("o_orderpriority").alias("category"), F.year("o_orderdate").alias("year"),
                F.col("o_orderstatus").alias("language")),
            "Material": materials,
            "Process": lambda: nations().select(
                F.col("n_name").alias("id"), F.col("n_name").alias("name"),
                F.lit(None).cast("boolean").alias("needs_review")).distinct(),
            "Equipment": lambda: t("part").select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct(),
            "Facility": lambda: nations().select(F.col("s_name").alias("name"), F.col("n_name").alias("country")),
            "Person": lambda: t("customer").select(
                _text("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("lab")),
            "TopicTag": lambda: t("part").select(F.col("p_type").alias("name")).distinct(),
            "Property": lambda: t("lineitem").select(F.concat(F.lit("quantity "), "l_returnflag").alias("name")).distinct(),
            "Measurement": measurements,
            "Conclusion": lambda: t("events").select(
                _text("event_id").alias("id"), F.col("event_type").alias("text"), F.col("value").alias("confidence"),
                F.get_json_object("props", "$.k").alias("geography"), F.to_date("ts").alias("date"),
                (F.col("value") < 0.6).alias("needs_review"), F.lit(1).alias("version"), F.col("ts").alias("updated_at")),
        }),
        edges=Frames({
            "MENTIONS": mentions,
            "REPORTS": lambda: measurements().select(F.col("doc_id").alias("src_id"), F.col("id").alias("dst_id"), "source"),
            "OF_PROPERTY": lambda: measurements().select(F.col("id").alias("src_id"), F.col("property").alias("dst_id")),
            "TAGGED": lambda: by_part().select(_text("l_orderkey").alias("src_id"), F.col("p_type").alias("dst_id")).distinct(),
            "AUTHORED_BY": lambda: t("orders").select(_text("o_orderkey").alias("src_id"), _text("o_custkey").alias("dst_id")),
            "DESCRIBED_IN": lambda: t("events").select(
                _text("event_id").alias("src_id"), _text("event_id").alias("dst_id"),
                F.concat(F.lit("event "), _text("event_id")).alias("fragment")),
            "ABOUT": about,
        }),
    )


def text_documents(spark: SparkSession, base: str) -> DataFrame:
    """Dealt by id: the work on texts spreads over all tasks however few files hold them."""
    docs = table(spark, base, "documents").select(_text("doc_id").alias("doc_id"), "text", "lang", "source", "n_chars")
    return docs.repartition("doc_id")


def text_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Embeddings as those of each document's first chunk."""
    return table(spark, base, "embeddings").select(F.concat(_text("vec_id"), F.lit(":1")).alias("id"), "embedding")


def text_measurements(spark: SparkSession, base: str) -> DataFrame:
    labels = table(spark, base, "labels")
    one = lambda name: labels.select(
        F.concat(_text("doc_id"), F.lit(":1")).alias("source"), F.lit(name).alias("property"),
        F.col(name).cast("double").alias("value"), F.lit(None).cast("double").alias("value_max"),
        F.lit(None).cast("string").alias("unit"))
    return one("quality").unionByName(one("toxic"))


def texts(spark: SparkSession, base: str) -> Graph:
    docs = text_documents(spark, base)
    first = F.concat("doc_id", F.lit(":1")).alias("source")

    def mention(label: str, column: str, count: F.Column) -> DataFrame:
        return docs.select(F.col("doc_id").alias("src_id"), F.lit(label).alias("dst_label"),
                           F.col(column).alias("dst_id"), count.cast("long").alias("count"), first)

    return Graph(
        nodes={
            "Document": lambda: docs.select(
                F.col("doc_id").alias("id"), F.concat(F.lit("Document "), "doc_id").alias("title"),
                F.col("source").alias("category"), F.col("lang").alias("language"),
                F.col("source").alias("journal"), F.lit(None).cast("int").alias("year")),
            "Chunk": lambda: chunk_single_units(docs),
            "Material": lambda: docs.select(F.col("source").alias("id"), F.col("source").alias("name")).distinct(),
            "Process": lambda: docs.select(F.col("lang").alias("id"), F.col("lang").alias("name")).distinct(),
        },
        edges={
            "MENTIONS": lambda: mention("Material", "source", F.col("n_chars")).unionByName(mention("Process", "lang", F.lit(1))),
        },
    )


def dialogues(spark: SparkSession, base: str) -> Graph:
    turns = table(spark, base, "conversations")
    return Graph(
        nodes={
            "Document": lambda: turns.select(
                _text("conv_id").alias("id"), F.concat(F.lit("Conversation "), _text("conv_id")).alias("title"),
                F.lit("dialogue").alias("category")).distinct(),
            "Chunk": lambda: turns.select(
                F.concat_ws(":", _text("conv_id"), _text("turn")).alias("id"), _text("conv_id").alias("doc_id"),
                F.col("turn").alias("seq"), F.col("role").alias("unit_kind"), F.col("turn").alias("unit_no"), "text"),
        },
    )
