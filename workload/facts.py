"""Measurements, versions and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.extraction.schema import read_answers
from lodegraph.functions.numeric import parse_numeric
from lodegraph.operators.measurements import measurement_candidates
from lodegraph.operators.sampling import stride_sample
from lodegraph.operators.versioning import apply_batch, replay
from lodegraph.sinks import review, upsert
from lodegraph.sources.roles import dialogues, line_source, records, table, text_documents
from workload.registry import query

CONSTRAINTS = [
    {"property": "Quantity A", "op": "<=", "value": 10.0},
    {"property": "quantity R", "op": "range", "value": 20.0, "value_max": 30.0, "unit": "F"},
    {"property": "quantity N", "op": "=", "value": 40.0, "unit": "O"},
]


@query("""
WITH m AS (SELECT l_orderkey || ':' || l_linenumber AS chunk_id, l_returnflag AS p, l_quantity AS lo,
                  l_quantity * (1 + l_discount) AS hi, l_linestatus AS unit FROM lineitem),
h AS (SELECT chunk_id, (p = 'A' AND lo <= 10)::INT + (p = 'R' AND unit = 'F' AND lo <= 30 AND hi >= 20)::INT
             + (p = 'N' AND unit = 'O' AND lo <= 44 AND hi >= 36)::INT AS hit FROM m),
s AS (SELECT chunk_id, sum(hit)::BIGINT AS hits FROM h WHERE hit > 0 GROUP BY 1)
SELECT *, (row_number() OVER (ORDER BY hits DESC, chunk_id))::INT AS rank FROM s QUALIFY rank <= 40""", name="measurement_candidates")
def measurement_channel(spark, base):
    return measurement_candidates(records(spark, base).node("Measurement"), CONSTRAINTS, 40)


@query("""
WITH w AS (SELECT event_id, l_quantity AS q FROM events JOIN lineitem ON l_orderkey = event_id)
SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber AS line, l_quantity AS value, l_quantity + 5 AS value_max,
       l_linestatus || '/t' AS unit FROM lineitem""")
def parse_numeric_ranges(spark, base):
    q = F.col("l_quantity")
    written = F.concat(F.regexp_replace(q.cast("string"), r"\.", ","), F.lit("–"), (q + 5).cast("string"),
                       F.lit(" "), F.col("l_linestatus"), F.lit("/t "))
    return table(spark, base, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("line"),
        parse_numeric(written).alias("n")).select("doc_id", "line", "n.*")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE -value END AS value, NULL::DOUBLE AS value_max,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS unit FROM events""", name="parse_numeric")
def parse_numeric_values(spark, base):
    written = F.when(F.col("event_type") == "error", F.lit("none")).otherwise(
        F.concat(F.lit(" −"), F.col("value").cast("string"), F.lit(" "), F.col("event_type"), F.lit(".")))
    return table(spark, base, "events").select("event_id", parse_numeric(written).alias("n")).select("event_id", "n.*")


@query("""
SELECT event_id, (props->>'$.k')::DOUBLE AS value, 'k' AS parameter, '=' AS op FROM events""")
def conditions_json(spark, base):
    doc = F.from_json("props", "map<string,double>")
    item = F.transform(F.map_entries(doc), lambda e: F.struct(
        e["key"].alias("parameter"), F.lit("=").alias("op"), e["value"].alias("value")))
    kept = F.filter(item, lambda c: c["value"].isNotNull())
    return table(spark, base, "events").select("event_id", F.explode(kept).alias("c")).select(
        "event_id", "c.value", "c.parameter", "c.op")


# model answers with fences, ranges, numbers as text, unreadable numbers and, every seventh line, a missing end
@query("""
SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber AS line, k = 7 AS failed, CASE WHEN k <> 7 THEN 'm' || l_partkey END AS material,
       CASE WHEN k % 4 <> 2 AND k <> 7 THEN l_quantity END AS value, CASE WHEN k % 4 = 0 THEN l_quantity + 5 END AS value_max,
       CASE WHEN k = 7 THEN NULL WHEN k % 4 = 3 THEN 'kg' WHEN k % 4 <> 2 THEN l_linestatus END AS unit,
       CASE WHEN k = 7 THEN NULL WHEN k % 4 = 0 THEN 'range' WHEN k % 4 = 3 THEN '<=' END AS op,
       CASE WHEN k % 4 = 0 THEN l_discount END AS low, CASE WHEN k % 4 = 0 THEN l_discount + 1 END AS high,
       CASE WHEN k % 4 = 3 AND k <> 7 THEN 'warm' END AS raw,
       CASE WHEN k = 7 THEN NULL WHEN k % 2 = 0 THEN 0.7 ELSE 0.5 END::DOUBLE AS sure
FROM (SELECT *, l_linenumber AS k FROM lineitem)""")
def answers_lenient(spark, base):
    k, text = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    measured = (
        F.when(k % 4 == 0, F.concat(F.lit('"value": "'), text("l_quantity"), F.lit("–"), (F.col("l_quantity") + 5).cast("string"), F.lit(" "), "l_linestatus",
                                    F.lit('", "conditions": [{"parameter": "d", "value": "'), text("l_discount"), F.lit("-"), (F.col("l_discount") + 1).cast("string"), F.lit('"}]')))
        .when(k % 4 == 1, F.concat(F.lit('"value": '), text("l_quantity"), F.lit(', "conditions": null, "unit": "'), "l_linestatus", F.lit('"')))
        .when(k % 4 == 2, F.lit('"value": "not measured"'))
        .otherwise(F.concat(F.lit('"value": "'), text("l_quantity"), F.lit(' kg.", "value_max": null, "unit": "", "conditions": [{"parameter": "d", "op": "<=", "value": "warm"}]')))
    )
    name = F.concat(F.lit("m"), text("l_partkey"))
    material = F.when(k % 2 == 0, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.concat(F.lit('{"name": " '), name, F.lit(' "}')))
    conclusion = F.when(k % 2 == 0, F.lit('"it works"')).otherwise(F.lit('{"text": "it works", "confidence": "0.5"}'))
    raw = F.concat(F.lit('As asked:\n```json\n{"materials": ['), material, F.lit('], "measurements": [{"property": "p", '), measured,
                   F.lit('}], "conclusions": ['), conclusion, F.when(k == 7, F.lit("]")).otherwise(F.lit("]}\n```")))
    read = read_answers(table(spark, base, "lineitem").select(text("l_orderkey").alias("doc_id"), k.alias("line"), raw.alias("raw")))
    one = F.get(F.col("measurements"), F.lit(0))
    held = F.get(one["conditions"], F.lit(0))
    return read.select(
        "doc_id", "line", F.col("problem").isNotNull().alias("failed"), F.get(F.col("materials"), F.lit(0))["name"].alias("material"),
        one["value"].alias("value"), one["value_max"].alias("value_max"), one["unit"].alias("unit"), held["op"].alias("op"),
        held["value"].alias("low"), held["value_max"].alias("high"), held["raw"].alias("raw"), F.get(F.col("conclusions"), F.lit(0))["confidence"].alias("sure"))


# --- versions -----------------------------------------------------------------

VERSIONED = """
logged AS (SELECT user_id, ts, event_id, event_type AS text, value AS confidence, props->>'$.k' AS geography FROM events),
prev AS (SELECT *, lag(text) OVER w AS pt, lag(confidence) OVER w AS pc, lag(geography) OVER w AS pg,
                row_number() OVER w AS rn FROM logged WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ch AS (SELECT *, rn > 1 AND (coalesce(text <> pt, false) OR coalesce(confidence <> pc, false)
              OR coalesce(geography, '') <> coalesce(pg, '')) AS c FROM prev),
versioned AS (SELECT *, 1 + sum(c::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM ch)
"""


def _log(spark, base):
    return table(spark, base, "events").select(
        "user_id", "ts", "event_id", F.col("event_type").alias("text"), F.col("value").alias("confidence"),
        F.get_json_object("props", "$.k").alias("geography"))


def _replayed(spark, base):
    return replay(_log(spark, base), "user_id", ["ts", "event_id"], F.date_trunc("day", "ts"))


@query(f"""WITH {VERSIONED}
SELECT user_id, event_id, text, confidence, geography, version::BIGINT AS version,
       CASE WHEN rn > 1 THEN c::VARCHAR ELSE 'first' END AS changed FROM versioned""")
def conclusion_versions(spark, base):
    return _replayed(spark, base).select("user_id", "event_id", "text", "confidence", "geography", "version",
                                         F.coalesce(F.col("changed").cast("string"), F.lit("first")).alias("changed"))


@query(f"""WITH {VERSIONED}
SELECT user_id, event_id, text, confidence, geography, version::BIGINT AS version FROM versioned
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def conclusion_current(spark, base):
    rows = _replayed(spark, base)
    last = F.max_by(F.struct("event_id", "text", "confidence", "geography", "version"), F.struct("ts", "event_id"))
    return rows.groupBy("user_id").agg(last.alias("r")).select("user_id", "r.*")


def _conclusion_batch(spark, base):
    """Orders as stored conclusions, their first events as a second extraction."""
    now = F.lit("2024-02-01").cast("timestamp")
    current = table(spark, base, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("text"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("geography"),
        F.to_date("o_orderdate").alias("date"), F.lit(False).alias("needs_review"), F.lit(1).alias("version"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    incoming = table(spark, base, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "click", F.lit("P")).otherwise(F.lit("F")).alias("text"),
        F.lit(0.5).alias("confidence"), F.lit("").alias("geography"), F.to_date("ts").alias("date"),
        (F.col("value") < 0.6).alias("needs_review"), now.alias("now"), F.lit("second").alias("model"))
    return apply_batch(current, incoming)


@query("""
WITH n AS (SELECT event_id::VARCHAR AS id, CASE WHEN event_type = 'click' THEN 'P' ELSE 'F' END AS text,
                  value < 0.6 AS nr FROM events)
SELECT o_orderkey::VARCHAR AS id, coalesce(n.text, o_orderstatus) AS text,
       CASE WHEN n.text IS NOT NULL AND n.text <> o_orderstatus THEN n.nr ELSE false END AS needs_review,
       CASE WHEN n.text IS NOT NULL AND n.text <> o_orderstatus THEN 2 ELSE 1 END AS version
FROM orders LEFT JOIN n ON n.id = o_orderkey::VARCHAR""")
def conclusion_batch_current(spark, base):
    return _conclusion_batch(spark, base)[0].select("id", "text", "needs_review", "version")


@query("""
SELECT o_orderkey::VARCHAR AS conclusion_id, 1 AS version, o_orderstatus AS text, 'second' AS archived_by_model
FROM orders JOIN events ON event_id = o_orderkey
WHERE o_orderstatus <> CASE WHEN event_type = 'click' THEN 'P' ELSE 'F' END""")
def conclusion_batch_archived(spark, base):
    return _conclusion_batch(spark, base)[1].select("conclusion_id", "version", "text", "archived_by_model")


# --- keyed writes ---------------------------------------------------------------


@query("""
SELECT l_orderkey::VARCHAR AS src_id, 'Material' AS dst_label, l_partkey::VARCHAR AS dst_id, count(*) AS count,
       l_orderkey || ':' || coalesce(max(l_linenumber) FILTER (l_linestatus = 'F'), max(l_linenumber)) AS source
FROM lineitem GROUP BY l_orderkey, l_partkey""")
def mention_upsert_counts(spark, base):
    lines = table(spark, base, "lineitem")
    old = lines.where("l_linestatus = 'O'").groupBy("l_orderkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("count"), F.max("l_linenumber").alias("l_linenumber"))
    keys = [F.col("l_orderkey").cast("string").alias("src_id"), F.lit("Material").alias("dst_label"),
            F.col("l_partkey").cast("string").alias("dst_id")]
    stored = old.select(*keys, "count", line_source().alias("source"))
    batch = lines.where("l_linestatus = 'F'").select(*keys, line_source().alias("source"), F.col("l_linenumber").alias("seq"))
    return upsert.counted_edges(stored, batch)


def _people(spark, base):
    existing = table(spark, base, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("lab"),
        F.lit(None).cast("double").alias("weight"))
    incoming = table(spark, base, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("weight"))
    return existing, incoming


@query("""
SELECT coalesce(c_custkey, o_orderkey) AS id, coalesce(o_orderpriority, c_name) AS name, c_mktsegment AS lab, o_totalprice AS weight
FROM customer FULL JOIN orders ON c_custkey = o_orderkey""")
def upsert_overwrite(spark, base):
    return upsert.overwrite(*_people(spark, base), ["id"])


@query("""
SELECT coalesce(c_custkey, o_orderkey) AS id, coalesce(c_name, o_orderpriority) AS name, c_mktsegment AS lab, o_totalprice AS weight
FROM customer FULL JOIN orders ON c_custkey = o_orderkey""")
def upsert_on_create(spark, base):
    return upsert.create_only(*_people(spark, base), ["id"], fill=["weight"])


@query("""
WITH b AS (SELECT l_orderkey, l_suppkey, max(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS src_id, l_suppkey AS dst_id, line::INT AS line FROM b
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
  AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def edge_upsert_endpoints(spark, base):
    lines = table(spark, base, "lineitem").select(
        F.col("l_orderkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"), F.col("l_linenumber").alias("line"),
        F.col("l_linenumber").alias("seq"))
    none = lines.drop("seq").limit(0)
    orders = table(spark, base, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    suppliers = table(spark, base, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return upsert.edges(none, lines, orders, suppliers, order="seq")


@query("""
SELECT doc_id::VARCHAR AS id, md5(coalesce(b.text, d.text)) AS text_md5,
       vec_id IS NOT NULL AND coalesce(b.text = d.text, true) AS embedded
FROM documents d LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN benchmark b ON item_id = doc_id""")
def embedding_invalidation(spark, base):
    vectors = table(spark, base, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    stored = text_documents(spark, base).select(F.col("doc_id").alias("id"), "text").join(vectors, "id", "left")
    batch = table(spark, base, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text").join(
        text_documents(spark, base).select(F.col("doc_id").alias("id")), "id", "left_semi")
    return upsert.chunks(stored, batch).select(
        "id", F.md5("text").alias("text_md5"), F.col("embedding").isNotNull().alias("embedded"))


@query("""
SELECT p_partkey::VARCHAR AS id, p_name AS name, 'false' AS needs_review, 'approve' AS review_status FROM part JOIN labels ON doc_id = p_partkey
WHERE quality = 0
UNION ALL
SELECT p_partkey::VARCHAR, p_name, CASE WHEN quality IS NULL THEN 'unknown' ELSE 'false' END, NULL FROM part LEFT JOIN labels ON doc_id = p_partkey
WHERE quality IS NULL OR quality = 1""")
def review_approve_queue(spark, base):
    material = records(spark, base).node("Material")
    waiting = material.where("needs_review").select("id")
    return review.approve(material, waiting, by="expert", now="2024-02-01T00:00:00+00:00").select(
        "id", "name", F.coalesce(F.col("needs_review").cast("string"), F.lit("unknown")).alias("needs_review"), "review_status")


@query("""
WITH r AS (SELECT p_partkey FROM part JOIN labels ON doc_id = p_partkey WHERE quality = 0)
SELECT l_orderkey::VARCHAR AS src_id, l_partkey::VARCHAR AS dst_id, count(*) AS count FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM r) GROUP BY l_orderkey, l_partkey""")
def review_reject_detach(spark, base):
    g = records(spark, base)
    rejected = g.node("Material").where("needs_review").select("id")
    _, edges = review.reject(g, "Material", rejected)
    return edges["MENTIONS"].where("dst_label = 'Material'").select("src_id", "dst_id", "count")


# --- even sampling --------------------------------------------------------------


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id || ':' || turn AS id FROM r
WHERE n <= 3 OR i IN (0, round_even((n - 1) / 2.0, 0)::BIGINT, n - 1)""", name="stride_sample")
def stride_sample_turns(spark, base):
    chunks = dialogues(spark, base).node("Chunk")
    return stride_sample(chunks, 3, F.floor(F.col("seq") / 1000)).select("id")
