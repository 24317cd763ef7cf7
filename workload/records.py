"""Graph analytics over the order graph."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.access import User, visible_documents
from lodegraph.graph import Graph
from lodegraph.operators.traversal import covering_documents, document_entities, graph_candidates
from lodegraph.plans import analytics as A
from lodegraph.plans.kept import Kept
from lodegraph.session import checkpoint_dir
from lodegraph.sources.roles import records, table
from workload.registry import query

# the role views, in SQL
MENTIONS = """
mat AS (SELECT l_orderkey::VARCHAR AS doc, l_partkey::VARCHAR AS key, count(*) AS cnt,
               l_orderkey || ':' || max(l_linenumber) AS source
        FROM lineitem GROUP BY l_orderkey, l_partkey),
proc AS (SELECT l_orderkey::VARCHAR AS doc, n_name AS key, count(*) AS cnt,
                l_orderkey || ':' || max(l_linenumber) AS source
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
         GROUP BY l_orderkey, n_name),
equip AS (SELECT l_orderkey::VARCHAR AS doc, p_brand AS key, count(*) AS cnt,
                 l_orderkey || ':' || max(l_linenumber) AS source
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand),
facil AS (SELECT l_orderkey::VARCHAR AS doc, s_name AS key, count(*) AS cnt,
                 l_orderkey || ':' || max(l_linenumber) AS source
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, s_name),
mentions AS (SELECT 'Material' AS label, * FROM mat UNION ALL SELECT 'Process', * FROM proc
             UNION ALL SELECT 'Equipment', * FROM equip UNION ALL SELECT 'Facility', * FROM facil)
"""
VERIFIED = """
vmat AS (SELECT p_partkey::VARCHAR AS key, p_name AS name FROM part LEFT JOIN labels ON doc_id = p_partkey
         WHERE coalesce(quality, 1) <> 0),
vproc AS (SELECT DISTINCT n_name AS key, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""
PAIRS = f"""{MENTIONS}, {VERIFIED},
pairs AS (SELECT m.key AS mk, p.key AS pk, count(*) AS docs
          FROM mat m JOIN proc p ON m.doc = p.doc
          WHERE m.key IN (SELECT key FROM vmat) AND p.key IN (SELECT key FROM vproc) GROUP BY 1, 2)
"""
TAGGED = "tagged AS (SELECT DISTINCT l_orderkey AS doc, p_type AS topic FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {PAIRS}
SELECT m.key AS material_key, m.name AS material, p.key AS process_key, p.name AS process,
       coalesce(docs, 0)::BIGINT AS docs
FROM vmat m CROSS JOIN vproc p LEFT JOIN pairs ON mk = m.key AND pk = p.key""")
def gap_matrix(spark, base):
    return A.gap_matrix(records(spark, base))


@query(f"""WITH {PAIRS}
SELECT m.key AS material_key, m.name AS material, p.key AS process_key, p.name AS process
FROM vmat m CROSS JOIN vproc p
WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE mk = m.key AND pk = p.key)""")
def gap_pairs_not_exists(spark, base):
    return A.knowledge_gaps(records(spark, base))


@query(f"""WITH {PAIRS},
mt AS (SELECT key, name, coalesce(sum(docs), 0) AS total FROM vmat LEFT JOIN pairs ON mk = key GROUP BY 1, 2),
pt AS (SELECT key, name, coalesce(sum(docs), 0) AS total FROM vproc LEFT JOIN pairs ON pk = key GROUP BY 1, 2),
mtop AS (SELECT *, row_number() OVER (ORDER BY total DESC, key) AS r FROM mt QUALIFY r <= 20),
ptop AS (SELECT *, row_number() OVER (ORDER BY total DESC, key) AS r FROM pt QUALIFY r <= 20)
SELECT m.r::INT AS row_no, m.key AS material_key, m.name AS material,
       string_agg(p.name, '|' ORDER BY p.r) AS processes,
       string_agg(coalesce(docs, 0)::VARCHAR, '|' ORDER BY p.r) AS cells
FROM mtop m CROSS JOIN ptop p LEFT JOIN pairs ON mk = m.key AND pk = p.key GROUP BY 1, 2, 3""")
def gap_pivot_topn(spark, base):
    return A.gap_pivot(records(spark, base)).select(
        "row_no", "material_key", "material", F.array_join("processes", "|").alias("processes"),
        F.array_join(F.transform("cells", lambda c: c.cast("string")), "|").alias("cells"))


@query(f"""WITH {PAIRS}
SELECT m.key AS material_key, m.name AS material, p.key AS process_key, p.name AS process, docs
FROM pairs JOIN vmat m ON mk = m.key JOIN vproc p ON pk = p.key
WHERE docs <= 3 ORDER BY docs, material, material_key, process_key LIMIT 24""")
def risk_pairs(spark, base):
    return A.risk_pairs(records(spark, base))


@query(f"""WITH {MENTIONS},
both_sides AS (
  SELECT doc FROM mat JOIN part ON key = p_partkey::VARCHAR WHERE p_name = 'red widget'
  INTERSECT SELECT doc FROM proc WHERE key = 'NATION_3')
SELECT doc AS id, 'Order ' || doc AS title, o_orderpriority AS category, year(o_orderdate)::INT AS year,
       o_orderstatus AS language,
       coalesce(string_agg(DISTINCT e.key, '|' ORDER BY e.key), '') AS equipment
FROM both_sides JOIN orders ON o_orderkey::VARCHAR = doc LEFT JOIN equip e USING (doc)
GROUP BY 1, 2, 3, 4, 5""")
def co_mention_docs(spark, base):
    found = A.comention_documents(records(spark, base), "red widget", "NATION_3")
    return found.withColumn("equipment", F.array_join("equipment", "|"))


@query("""
SELECT n_name AS process, event_id::VARCHAR AS id, event_type AS text, value AS confidence,
       json_extract_string(props, '$.k') AS geography, 'Order ' || o_orderkey AS title,
       'event ' || event_id AS fragment
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN orders ON o_orderkey = event_id
WHERE n_name IN ('NATION_1', 'NATION_3', 'NATION_7')
  AND n_name IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def conclusions_by_process(spark, base):
    return A.conclusions_about(records(spark, base), ["NATION_1", "NATION_3", "NATION_7"])


@query("""
SELECT l_orderkey::VARCHAR AS doc_id, 'quantity ' || l_returnflag AS property, l_quantity AS value,
       round(l_quantity * (1 + l_discount), 6) AS value_max, l_linestatus AS unit,
       'line ' || l_linenumber AS place, 'Order ' || l_orderkey AS title
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def measurements_report(spark, base):
    return A.measurement_report(records(spark, base)).drop("conditions").withColumn("value_max", F.round("value_max", 6))


@query("""
SELECT o_orderpriority AS category, count(*) AS docs, min(year(o_orderdate))::INT AS year_from,
       max(year(o_orderdate))::INT AS year_to, count(*) FILTER (o_orderstatus = 'F') AS in_language
FROM orders GROUP BY 1""")
def corpus_by_category(spark, base):
    return A.corpus_overview(records(spark, base), language="F")


@query("""
SELECT o_orderpriority AS category, count(*) AS n, min(year(o_orderdate))::INT AS year_min,
       max(year(o_orderdate))::INT AS year_max FROM orders GROUP BY 1""")
def documents_by_category(spark, base):
    return A.documents_by_category(records(spark, base))


REVIEW = """
review AS (
  SELECT 'Material' AS label, p_partkey::VARCHAR AS key, p_name AS name, NULL::DOUBLE AS confidence
  FROM part JOIN labels ON doc_id = p_partkey WHERE quality = 0
  UNION ALL
  SELECT 'Conclusion', event_id::VARCHAR, event_type, value FROM events WHERE value < 0.6)
"""


@query(f"WITH {REVIEW} SELECT * FROM review ORDER BY label, name, key LIMIT 200")
def review_queue(spark, base):
    return A.review_queue(records(spark, base), 200)


@query(f"WITH {REVIEW} SELECT label, count(*) AS n FROM review GROUP BY 1")
def review_by_label(spark, base):
    return A.review_by_label(records(spark, base))


NODE_COUNTS = """
node_counts AS (
  SELECT 'Document' AS label, count(*) AS n FROM orders
  UNION ALL SELECT 'Material', count(*) FROM part
  UNION ALL SELECT 'Process', count(DISTINCT s_nationkey) FROM supplier
  UNION ALL SELECT 'Equipment', count(DISTINCT p_brand) FROM part
  UNION ALL SELECT 'Facility', count(*) FROM supplier
  UNION ALL SELECT 'Person', count(*) FROM customer
  UNION ALL SELECT 'TopicTag', count(DISTINCT p_type) FROM part
  UNION ALL SELECT 'Property', count(DISTINCT l_returnflag) FROM lineitem
  UNION ALL SELECT 'Measurement', count(*) FROM lineitem
  UNION ALL SELECT 'Conclusion', count(*) FROM events)
"""


@query(f"WITH {NODE_COUNTS} SELECT * FROM node_counts")
def graph_stats_nodes(spark, base):
    return A.node_counts(records(spark, base))


@query(f"""WITH {MENTIONS}, {TAGGED}
SELECT 'MENTIONS' AS type, count(*) AS n FROM mentions
UNION ALL SELECT 'REPORTS', count(*) FROM lineitem
UNION ALL SELECT 'OF_PROPERTY', count(*) FROM lineitem
UNION ALL SELECT 'TAGGED', count(*) FROM tagged
UNION ALL SELECT 'AUTHORED_BY', count(*) FROM orders
UNION ALL SELECT 'DESCRIBED_IN', count(*) FROM events
UNION ALL SELECT 'ABOUT', count(*) FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def graph_stats_edges(spark, base):
    return A.edge_counts(records(spark, base))


@query(f"""WITH {NODE_COUNTS}, {REVIEW}
SELECT sum(n) FILTER (label = 'Document')::BIGINT AS documents, sum(n) FILTER (label = 'Conclusion')::BIGINT AS conclusions,
       sum(n) FILTER (label = 'Measurement')::BIGINT AS measurements,
       sum(n) FILTER (label IN ('Material', 'Process', 'Equipment', 'Facility'))::BIGINT AS entities,
       (SELECT count(*) FROM review) AS needs_review, 0::BIGINT AS reviewed FROM node_counts""")
def dashboard_totals(spark, base):
    return A.totals(records(spark, base))


@query(f"""WITH {REVIEW}
SELECT 0::BIGINT AS reviewed, count(*) AS needs_review, 0.0::DOUBLE AS progress FROM review""")
def verification_progress(spark, base):
    return A.verification_progress(records(spark, base))


@query(f"""WITH {TAGGED},
con AS (SELECT event_id AS doc, count(*) AS c FROM events GROUP BY 1),
rep AS (SELECT l_orderkey AS doc, count(*) AS m FROM lineitem GROUP BY 1)
SELECT topic, count(*) AS docs, coalesce(sum(c), 0)::BIGINT AS conclusions, coalesce(sum(m), 0)::BIGINT AS measurements
FROM tagged LEFT JOIN con USING (doc) LEFT JOIN rep USING (doc) GROUP BY 1""")
def dashboard_coverage(spark, base):
    return A.topic_coverage(records(spark, base))


def _kept(spark, base):
    """Aggregates kept over a part of the orders, then brought up to date by two batches.

    The first load lacks every third order, takes all materials as verified
    and still has conclusions of orders that go; the batches put that right.
    """
    whole, held = records(spark, base), Kept(spark, f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}", 50_000)
    third = lambda c: F.pmod(F.col(c).cast("long"), F.lit(3)) == 0
    of = {"MENTIONS": "src_id", "REPORTS": "src_id", "TAGGED": "src_id", "AUTHORED_BY": "src_id"}
    first = Graph(
        nodes=whole.nodes.with_tables(
            Document=whole.node("Document").where(~third("id")),
            Material=whole.node("Material").withColumn("needs_review", F.lit(None).cast("boolean"))),
        edges=whole.edges.with_tables(**{kind: whole.edge(kind).where(~third(column)) for kind, column in of.items()}))
    held.rebuild(first)
    flagged = whole.node("Material").where("needs_review").select(F.lit("Material").alias("label"), F.col("id").alias("key"))
    none = whole.node("Document").where(F.lit(False))
    between = Graph(nodes=first.nodes.with_tables(Material=whole.node("Material")), edges=first.edges)
    held.update(first, between, none.select("id"), flagged, "flags")
    new = whole.node("Document").where(third("id"))
    for _ in range(2):  # a repeated batch changes nothing
        held.update(between, whole, new.select("id"), new.select(F.lit("Document").alias("label"), F.col("id").alias("key")), "rest")
    return held


@query(f"""WITH {PAIRS}, {TAGGED}, {NODE_COUNTS}, {REVIEW},
con AS (SELECT event_id AS doc, count(*) AS c FROM events GROUP BY 1),
rep AS (SELECT l_orderkey AS doc, count(*) AS m FROM lineitem GROUP BY 1),
risks AS (SELECT m.name || ':' || m.key AS left_key, p.key AS right_key, docs FROM pairs JOIN vmat m ON mk = m.key JOIN vproc p ON pk = p.key
          WHERE docs <= 3 ORDER BY docs, m.name, m.key, p.key LIMIT 24),
best AS (SELECT c_name AS name, count(DISTINCT o_orderkey) AS docs FROM orders JOIN customer ON o_custkey = c_custkey
         GROUP BY 1 ORDER BY docs DESC, name LIMIT 12)
SELECT 'coverage' AS part, topic AS left_key, '' AS right_key, count(*) AS a, coalesce(sum(c), 0)::BIGINT AS b, coalesce(sum(m), 0)::BIGINT AS c
FROM tagged LEFT JOIN con USING (doc) LEFT JOIN rep USING (doc) GROUP BY ALL
UNION ALL SELECT 'risk', left_key, right_key, docs, 0, 0 FROM risks
UNION ALL SELECT 'expert', name, '', docs, 0, 0 FROM best
UNION ALL SELECT 'review', label, '', count(*), 0, 0 FROM review GROUP BY ALL
UNION ALL SELECT 'documents', '', '', sum(n) FILTER (label = 'Document')::BIGINT, sum(n) FILTER (label = 'Conclusion')::BIGINT,
       sum(n) FILTER (label = 'Measurement')::BIGINT FROM node_counts
UNION ALL SELECT 'entities', '', '', sum(n) FILTER (label IN ('Material', 'Process', 'Equipment', 'Facility'))::BIGINT,
       (SELECT count(*) FROM review), 0 FROM node_counts""")
def kept_dashboard(spark, base):
    shown = _kept(spark, base).dashboard(1000)
    row = lambda df, part, left, right, *values: df.select(
        F.lit(part).alias("part"), left.alias("left_key"), right.alias("right_key"),
        *[v.cast("long").alias(n) for v, n in zip([*values, F.lit(0), F.lit(0)], "abc")])
    empty, col = F.lit(""), F.col
    parts = [
        row(shown["coverage"], "coverage", col("topic"), empty, col("docs"), col("conclusions"), col("measurements")),
        row(shown["risk_pairs"], "risk", F.concat("material", F.lit(":"), "material_key"), col("process_key"), col("docs")),
        row(shown["experts"], "expert", col("name"), empty, col("docs")), row(shown["review_by_label"], "review", col("label"), empty, col("n")),
        row(shown["totals"], "documents", empty, empty, col("documents"), col("conclusions"), col("measurements")),
        row(shown["totals"], "entities", empty, empty, col("entities"), col("needs_review"), col("reviewed")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {REVIEW} SELECT label, CASE label WHEN 'Conclusion' THEN key ELSE name END AS name, NULL::VARCHAR AS created_at
FROM review ORDER BY label, 2, key LIMIT 150""")
def newly_met(spark, base):
    return A.newly_met(records(spark, base), 150)


@query("""
SELECT c_name AS name, count(DISTINCT o_orderkey) AS docs FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1 ORDER BY docs DESC, name LIMIT 12""")
def experts_top(spark, base):
    return A.top_experts(records(spark, base))


@query(f"""WITH {MENTIONS},
written AS (SELECT o_custkey, o_orderkey, 'Order ' || o_orderkey AS title FROM orders
            WHERE o_orderkey::VARCHAR IN (SELECT doc FROM proc WHERE key = 'NATION_3')),
ranked AS (SELECT o_custkey, title, row_number() OVER (PARTITION BY o_custkey ORDER BY title) AS r FROM written)
SELECT c_name AS author, (SELECT count(*) FROM written w WHERE w.o_custkey = c_custkey) AS docs,
       (SELECT string_agg(title, '|' ORDER BY title) FROM ranked k WHERE k.o_custkey = c_custkey AND r <= 5) AS titles
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM written)""")
def experts_by_process(spark, base):
    return A.experts_by_process(records(spark, base), "NATION_3").withColumn("titles", F.array_join("titles", "|"))


@query(f"""WITH {MENTIONS},
best AS (SELECT doc, cnt, row_number() OVER (ORDER BY cnt DESC, doc) AS rank FROM facil
         WHERE key = 'Supplier#000000003' QUALIFY rank <= 25)
SELECT doc AS id, 'Order ' || doc AS title, o_orderpriority AS category, year(o_orderdate)::INT AS year,
       cnt AS mentions, rank::INT AS rank FROM best JOIN orders ON o_orderkey::VARCHAR = doc""")
def entity_card_docs(spark, base):
    return A.entity_documents(records(spark, base), "Facility", "Supplier#000000003")


@query("""
SELECT DISTINCT event_type AS text, value AS confidence, json_extract_string(props, '$.k') AS geography,
       'Order ' || o_orderkey AS doc
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_orderkey = event_id WHERE n_name = 'NATION_3'
ORDER BY confidence DESC, text, doc NULLS LAST LIMIT 25""")
def entity_card_conclusions(spark, base):
    return A.entity_conclusions(records(spark, base), "Process", "NATION_3")


NAMES = """
names AS (SELECT 'Material' AS label, p_partkey::VARCHAR AS key, p_name AS name FROM part
          UNION ALL SELECT DISTINCT 'Process', n_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
          UNION ALL SELECT DISTINCT 'Equipment', p_brand, p_brand FROM part
          UNION ALL SELECT 'Facility', s_name, s_name FROM supplier)
"""


@query(f"""WITH {MENTIONS}, {NAMES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY cnt DESC, label, key) AS rank FROM mentions
           QUALIFY rank <= 12)
SELECT label, key, doc AS doc_id, cnt AS mentions, rank::INT AS rank, name FROM ranked JOIN names USING (label, key)""")
def doc_top_entities(spark, base):
    g = records(spark, base)
    return document_entities(g.mentions(), g.entities()).withColumn("mentions", F.col("mentions").cast("long"))


@query(f"""WITH {MENTIONS},
best AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, label, key) AS r FROM mentions WHERE doc = '7' QUALIFY r <= 30)
SELECT 'Document:7' AS from_id, label || ':' || key AS to_id, 'MENTIONS' AS type, cnt AS weight FROM best
UNION ALL SELECT 'Conclusion:' || event_id, 'Document:7', 'DESCRIBED_IN', 1 FROM events WHERE event_id = 7""")
def graph_around_doc(spark, base):
    return A.edges_around_document(records(spark, base), "7")


@query(f"""WITH {MENTIONS},
best AS (SELECT doc, row_number() OVER (ORDER BY cnt DESC, doc) AS r FROM proc WHERE key = 'NATION_3' QUALIFY r <= 15),
others AS (SELECT m.*, row_number() OVER (PARTITION BY m.doc ORDER BY cnt DESC, label, key) AS place
           FROM mentions m JOIN best ON m.doc = best.doc
           WHERE NOT (label = 'Process' AND key = 'NATION_3') QUALIFY place <= 8)
SELECT 'Document:' || doc AS from_id, 'Process:NATION_3' AS to_id, 'MENTIONS' AS type, 1::BIGINT AS weight FROM best
UNION ALL SELECT 'Document:' || doc, label || ':' || key, 'MENTIONS', cnt FROM others""")
def graph_around_entity(spark, base):
    return A.edges_around_entity(records(spark, base), "Process", "NATION_3")


@query(f"""WITH {MENTIONS}, {NAMES},
best AS (SELECT doc, row_number() OVER (ORDER BY cnt DESC, doc) AS r FROM proc WHERE key = 'NATION_3' QUALIFY r <= 15),
others AS (SELECT m.*, row_number() OVER (PARTITION BY m.doc ORDER BY cnt DESC, label, key) AS place
           FROM mentions m JOIN best ON m.doc = best.doc
           WHERE NOT (label = 'Process' AND key = 'NATION_3') QUALIFY place <= 8),
ids AS (SELECT DISTINCT label, key FROM others UNION SELECT 'Process', 'NATION_3')
SELECT label || ':' || key AS node_id, label, name,
       coalesce(label = 'Material' AND key IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 0), false) AS needs_review
FROM ids JOIN names USING (label, key)
UNION ALL SELECT 'Document:' || doc, 'Document', 'Order ' || doc, false FROM best""")
def graph_nodes_around_entity(spark, base):
    g = records(spark, base)
    return A.graph_view(g, A.edges_around_entity(g, "Process", "NATION_3"))[0]


def covering_sql(n: int) -> str:
    return f"""WITH {MENTIONS},
hit AS (SELECT doc, count(DISTINCT key) AS matched, sum(cnt)::BIGINT AS weight, list(DISTINCT source) AS sources
        FROM mentions WHERE label IN ('Material', 'Process', 'Equipment')
          AND key IN ('NATION_3', 'Brand#7', '17') GROUP BY doc HAVING count(DISTINCT key) >= 2),
docs AS (SELECT *, row_number() OVER (ORDER BY matched DESC, weight DESC, doc) AS doc_rank FROM hit QUALIFY doc_rank <= {n})
"""
KEYS = ["NATION_3", "Brand#7", "17"]


@query(covering_sql(15) + "SELECT doc AS doc_id, matched, weight, doc_rank::INT AS doc_rank FROM docs")
def covering_docs(spark, base):
    g = records(spark, base)
    return covering_documents(g.mentions("Material", "Process", "Equipment"), KEYS, 15).drop("sources")


@query(covering_sql(50) + """,
listed AS (SELECT source AS chunk_id, min(doc_rank) AS doc_rank FROM (SELECT unnest(sources) AS source, doc_rank FROM docs) GROUP BY 1)
SELECT chunk_id, (row_number() OVER (ORDER BY doc_rank, chunk_id))::INT AS rank FROM listed
QUALIFY rank <= 50""", name="graph_candidates")
def graph_candidate_chunks(spark, base):
    g = records(spark, base)
    return graph_candidates(g.mentions("Material", "Process", "Equipment"), KEYS, 50)


@query("""
SELECT o_orderkey::VARCHAR AS id, 'Order ' || o_orderkey AS title, o_orderpriority AS category,
       year(o_orderdate)::INT AS year, o_orderstatus AS language
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def rbac_documents(spark, base):
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    partner = User("partner", "external", priorities, ("4-NOT SPECIFIED", "5-LOW"))
    return visible_documents(records(spark, base).node("Document"), partner)


@query("""
SELECT '7' AS id, event_type AS text, value AS confidence, 1 AS version,
       coalesce((SELECT string_agg(event_id || ':' || event_type || ':' || round(value, 6), '|' ORDER BY event_id) FROM events WHERE user_id = 7), '') AS history
FROM events WHERE event_id = 7""")
def conclusion_history(spark, base):
    g = records(spark, base)
    g.nodes["ConclusionVersion"] = table(spark, base, "events").select(
        F.col("user_id").cast("string").alias("conclusion_id"), F.col("event_id").alias("version"), F.col("event_type").alias("text"),
        F.col("value").alias("confidence"), F.lit(None).cast("string").alias("geography"), F.lit("t").alias("archived_at"),
        F.lit("m").alias("archived_by_model"))
    shown = F.transform("history", lambda h: F.concat_ws(":", h["version"], h["text"], F.round(h["confidence"], 6)))
    return A.conclusion_history(g, "7").select("id", "text", "confidence", "version", F.array_join(shown, "|").alias("history"))
