"""Search channels, fusion and the hybrid search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodegraph.operators.fulltext import delete_from_index, search_index, search_texts, update_index, write_index
from lodegraph.operators.fusion import channel, fuse
from lodegraph.operators.measurements import measurement_candidates
from lodegraph.operators.similarity import nearest
from lodegraph.operators.traversal import graph_candidates
from lodegraph.operators.vector_index import VectorIndex
from lodegraph.plans.search import hybrid_search as run_hybrid
from lodegraph.plans.search import fulltext_fragments as fragments_of
from lodegraph.plans.search import experts_for_topic, semantic_search, with_entities
from lodegraph.session import checkpoint_dir, freed
from lodegraph.sources.roles import table, text_measurements, text_vectors, texts
from workload.registry import query
from workload.texts import CHUNKS, WHOLE, stem_sql, tokens_sql

QUESTION = "the tion leaux: (onnd her) enden"
WORDS = ["the", "tion", "leaux", "onnd", "her", "enden"]
KEYS = ["src3", "de"]
CONSTRAINTS = [{"property": "toxic", "op": ">=", "value": 1}]


def query_vector(spark, base):
    """The stored vector asked for neighbours: that of vec_id 0."""
    return list(table(spark, base, "embeddings").where("vec_id = 0").first()["embedding"])


VECTORS = """
q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
sims AS MATERIALIZED (SELECT vec_id, list_dot_product(embedding::DOUBLE[], qe::DOUBLE[])
                / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[]))) AS sim
         FROM embeddings, q)
"""
STEMS = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
# BM25 over the chunks; words first, so that each is stemmed once
BM25 = f"""
terms AS (SELECT DISTINCT {stem_sql('w')} AS term FROM (SELECT unnest({STEMS}) AS w)),
toks AS (SELECT doc_id || ':' || seq AS id, unnest({tokens_sql('text')}) AS w FROM chunk),
lens AS (SELECT doc_id || ':' || seq AS id, len({tokens_sql('text')}) AS dl FROM chunk),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, {stem_sql('w')} AS term FROM toks) JOIN terms USING (term) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
bm AS MATERIALIZED (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM tf JOIN dfs USING (term) JOIN lens USING (id), tot GROUP BY 1)
"""


@query(f"""WITH {VECTORS}
SELECT vec_id || ':1' AS chunk_id, round(sim, 6) AS score, (row_number() OVER (ORDER BY round(sim, 9) DESC, vec_id || ':1'))::INT AS rank
FROM sims QUALIFY rank <= 20""")
def vector_topk(spark, base):
    return nearest(text_vectors(spark, base), query_vector(spark, base), 20).withColumn("score", F.round("score", 6))


@query(f"""WITH {VECTORS}
SELECT vec_id || ':1' AS chunk_id, round(sim, 6) AS score, (row_number() OVER (ORDER BY round(sim, 9) DESC, vec_id || ':1'))::INT AS rank
FROM sims QUALIFY rank <= 20""")
def vector_index_topk(spark, base):
    """The same from the stored index, after a load with wrong, missing and surplus vectors, a batch and a deletion."""
    vectors = text_vectors(spark, base)
    index = VectorIndex(spark, f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}", rows_a_band=32)
    part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3))
    ghosts = vectors.where(part == 0).select(F.concat(F.lit("ghost-"), "id").alias("id"), "embedding")
    index.build(vectors.where(part == 0).unionByName(vectors.where(part == 1).withColumn("embedding", F.reverse("embedding"))).unionByName(ghosts))
    index.update(vectors.where(part != 0))
    index.delete(ghosts.select("id"))
    return index.search(query_vector(spark, base), 20).withColumn("score", F.round("score", 6))


@query(f"""WITH {VECTORS},
top AS (SELECT vec_id, sim, row_number() OVER (ORDER BY round(sim, 9) DESC, vec_id || ':1') AS r FROM sims
        WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY r <= 8)
SELECT vec_id || ':1' AS chunk_id, round(sim, 6) AS score, lang AS language, source AS category
FROM top JOIN documents ON doc_id = vec_id""")
def semantic_search_filtered(spark, base):
    g = texts(spark, base)
    g.nodes["Chunk"] = g.nodes["Chunk"].join(text_vectors(spark, base), "id", "left")
    return semantic_search(g, query_vector(spark, base), 8, language="en").select(
        "chunk_id", F.round("score", 6).alias("score"), "language", "category")


@query(f"""WITH {VECTORS}
SELECT vec_id || ':1' AS chunk_id, round(sim, 6) AS score, lang AS language, source AS category
FROM sims JOIN documents ON doc_id = vec_id WHERE source IN ('src3', 'src11')
QUALIFY row_number() OVER (ORDER BY round(sim, 9) DESC, vec_id || ':1') <= 8""")
def semantic_search_restricted(spark, base):
    g = texts(spark, base)
    g.nodes["Chunk"] = g.nodes["Chunk"].join(text_vectors(spark, base), "id", "left")
    return semantic_search(g, query_vector(spark, base), 8, allowed_categories=["src3", "src11"]).select(
        "chunk_id", F.round("score", 6).alias("score"), "language", "category")


@query(f"""WITH {CHUNKS}, {BM25}
SELECT id AS chunk_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, id))::INT AS rank
FROM bm QUALIFY rank <= 40""")
def bm25_topk(spark, base):
    return search_texts(texts(spark, base).node("Chunk"), QUESTION, 40).withColumn("score", F.round("score", 6))


def _stored(spark, base):
    """A text index and a chunk table built from the documents, as a store keeps them."""
    folder = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    g = texts(spark, base)
    g.node("Chunk").write.options(**{"parquet.bloom.filter.enabled#id": "true", "compression": "zstd"}).parquet(f"{folder}/chunks")
    freed(spark)
    g.nodes["Chunk"] = spark.read.parquet(f"{folder}/chunks")
    half = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(2)) == 0
    # in three steps: a first load with texts that do not stay as they are, a batch that brings the rest and the
    # changed ones, and a deletion
    chunks = g.node("Chunk")
    first = chunks.where(half).withColumn("text", F.when(F.col("seq") == 1, F.reverse("text")).otherwise(F.col("text")))
    ghosts = chunks.where(half & (F.col("seq") == 2)).withColumn("id", F.concat(F.lit("ghost-"), "id"))
    write_index(first.unionByName(ghosts), f"{folder}/index")
    update_index(chunks.where(~half | (F.col("seq") == 1)), f"{folder}/index")
    delete_from_index(ghosts.select("id"), f"{folder}/index")
    return g, f"{folder}/index"


@query(f"""WITH {CHUNKS}, {BM25}
SELECT id AS chunk_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, id))::INT AS rank
FROM bm QUALIFY rank <= 40""")
def bm25_index_topk(spark, base):
    return search_index(spark, _stored(spark, base)[1], QUESTION, 40).withColumn("score", F.round("score", 6))


@query(f"""WITH {CHUNKS}, {BM25}
SELECT 'Document ' || doc_id AS title, 'page 1' AS place, left(text, 200) AS fragment, round(score, 6) AS score,
       (row_number() OVER (ORDER BY round(score, 9) DESC, id))::INT AS rank
FROM bm JOIN chunk ON id = doc_id || ':' || seq QUALIFY rank <= 10""")
def fulltext_fragments(spark, base):
    return fragments_of(texts(spark, base), QUESTION).withColumn("score", F.round("score", 6))


# the same ranking over short node texts: names, brands and kinds of materials
MATERIAL_QUERY = "red widgets, economy Brand#7"
MATERIAL_STEMS = "['red', 'widgets', 'economy', 'brand', '7']"


@query(f"""
WITH chunk AS (SELECT p_partkey AS doc_id, 0 AS seq, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part),
{BM25.replace(STEMS, MATERIAL_STEMS)}
SELECT split_part(id, ':', 1)::BIGINT AS chunk_id, round(score, 6) AS score,
       (row_number() OVER (ORDER BY round(score, 9) DESC, split_part(id, ':', 1)::BIGINT))::INT AS rank
FROM bm QUALIFY rank <= 25""")
def fulltext_materials(spark, base):
    nodes = table(spark, base, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("shown"))
    return search_texts(nodes, MATERIAL_QUERY, 25, "p_partkey", "shown").withColumn("score", F.round("score", 6))


# one index over nodes of several labels: names, grades and texts are fields with weights
NODES = """
fields AS (SELECT 'M' || p_partkey AS id, 'name' AS field, p_name AS text FROM part
           UNION ALL SELECT 'M' || p_partkey, 'grade', p_brand || ' ' || p_type FROM part
           UNION ALL SELECT 'C' || event_id, 'text', 'the red ' || event_type || ' of ' || props FROM events
           UNION ALL SELECT 'D' || o_orderkey, 'name', 'Order ' || o_orderpriority FROM orders)
"""
NODE_QUERY = "red widgets of economy Brand#7: urgent clicks"
FIELD_WEIGHTS = {"name": 2.0, "grade": 1.0, "text": 0.25}


@query(f"""WITH {NODES},
terms AS (SELECT DISTINCT {stem_sql('w')} AS term FROM (SELECT unnest({tokens_sql(f"'{NODE_QUERY}'")}) AS w)),
words AS (SELECT id, field, unnest({tokens_sql('text')}) AS w FROM fields),
lens AS (SELECT id, field, len({tokens_sql('text')}) AS dl FROM fields),
tf AS (SELECT id, field, term, count(*) AS tf FROM (SELECT id, field, {stem_sql('w')} AS term FROM words) JOIN terms USING (term) GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
tot AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY 1),
scored AS (SELECT id, sum(CASE field WHEN 'name' THEN 2.0 WHEN 'grade' THEN 1.0 ELSE 0.25 END
                * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM tf JOIN dfs USING (field, term) JOIN lens USING (id, field) JOIN tot USING (field) GROUP BY 1)
SELECT id AS chunk_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, id))::INT AS rank FROM scored QUALIFY rank <= 30""")
def fulltext_fields(spark, base):
    text = lambda column: F.col(column).cast("string")
    nodes = table(spark, base, "part").select(
        F.concat(F.lit("M"), text("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("grade"))
    nodes = nodes.unionByName(table(spark, base, "events").select(
        F.concat(F.lit("C"), text("event_id")).alias("id"), F.concat(F.lit("the red "), "event_type", F.lit(" of "), "props").alias("text")), allowMissingColumns=True)
    nodes = nodes.unionByName(table(spark, base, "orders").select(
        F.concat(F.lit("D"), text("o_orderkey")).alias("id"), F.concat(F.lit("Order "), "o_orderpriority").alias("name")), allowMissingColumns=True)
    path = f"{checkpoint_dir(spark)}/nodes-{uuid.uuid4().hex}"
    fields = {f: f for f in FIELD_WEIGHTS}
    half = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(2)) == 0
    # a first load with names and texts changed about, then a batch that puts them right and brings the rest
    write_index(nodes.where(half).select("id", F.col("text").alias("name"), "grade", F.col("name").alias("text")), path, "id", fields)
    update_index(nodes, path, "id", fields)
    return search_index(spark, path, NODE_QUERY, 30, weights=FIELD_WEIGHTS).withColumn("score", F.round("score", 6))


# the four channels, then fusion; ranks count from 1
def fused_sql(languages: str | None = None, size: int = 50, text_only: bool = False) -> str:
    """`languages`: those of the documents a reader may see; hidden ones leave before every channel's cut."""
    hidden = f"WHERE lang IN ({languages})" if languages else ""
    where = "WHERE id IN (SELECT id FROM visible)" if languages else ""
    gwhere = "WHERE doc IN (SELECT doc FROM visible)" if languages else ""
    return f"""{CHUNKS}, {BM25}, {VECTORS},
visible AS MATERIALIZED (SELECT c.doc_id || ':' || c.seq AS id, c.doc_id AS doc FROM chunk c JOIN documents d ON d.doc_id::VARCHAR = c.doc_id {hidden}),
ment AS (SELECT doc_id::VARCHAR AS doc, source AS key, n_chars AS cnt FROM documents
         UNION ALL SELECT doc_id::VARCHAR, lang, 1 FROM documents),
cover AS (SELECT doc, count(DISTINCT key) AS matched, sum(cnt) AS weight FROM ment WHERE key IN ('src3', 'de')
          GROUP BY 1 HAVING count(DISTINCT key) >= 2),
gdocs AS (SELECT doc, row_number() OVER (ORDER BY matched DESC, weight DESC, doc) AS r FROM cover {gwhere} QUALIFY r <= 50),
hits AS (SELECT doc_id || ':1' AS id, count(*) AS hits FROM labels WHERE toxic >= 1 GROUP BY 1),
vis AS (SELECT vec_id || ':1' AS id, sim FROM sims),
chan AS (
  SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, 1 AS ch FROM bm {where} QUALIFY rank <= {size}
  {"),unused AS (" if text_only else "UNION ALL"}
  SELECT id, row_number() OVER (ORDER BY round(sim, 9) DESC, id) AS rank, 0 AS ch FROM vis {where} QUALIFY rank <= 50
  UNION ALL SELECT doc || ':1', row_number() OVER (ORDER BY r, doc || ':1') AS rank, 2 FROM gdocs QUALIFY rank <= 50
  UNION ALL SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS rank, 3 FROM hits {where} QUALIFY rank <= 50),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((ch, rank)) AS first_seen,
                 bool_or(ch = 2) AS via_graph, bool_or(ch = 3) AS via_measure FROM chan GROUP BY 1),
ranked AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY round(score, 12) DESC, first_seen, id))::INT AS position FROM fused)
"""


FUSED = fused_sql()


def _measured(spark, base, size=50, within=None):
    return measurement_candidates(text_measurements(spark, base), CONSTRAINTS, size, within)


@query(f"""WITH {FUSED}
SELECT id AS chunk_id, round(score, 6) AS rrf_score, via_graph, via_measure, position FROM ranked""")
def rrf_fusion(spark, base):
    g = texts(spark, base)
    found = [
        channel(nearest(text_vectors(spark, base), query_vector(spark, base), 50), "vector"),
        channel(search_texts(g.node("Chunk"), QUESTION, 50), "fulltext"),
        channel(graph_candidates(g.mentions(), KEYS, 50), "graph"),
        channel(_measured(spark, base), "measure"),
    ]
    return fuse(found).withColumn("rrf_score", F.round("rrf_score", 6))


# the diversity pass as a walk along the positions
def greedy_sql(languages: str, k: int = 10, text_only: bool = False) -> str:
    return f"""WITH {fused_sql(languages, max(5 * k, 40), text_only)},
sig AS (SELECT doc_id || ':' || seq AS id, doc_id AS doc, {WHOLE} AS s FROM chunk),
cand AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY position))::INT AS i, id, doc, s, score, via_graph, via_measure
         FROM ranked JOIN sig USING (id) JOIN documents d ON d.doc_id::VARCHAR = doc WHERE lang IN ({languages})),
greedy AS (
  SELECT 0 AS i, []::VARCHAR[] AS kept, []::VARCHAR[] AS docs, []::VARCHAR[] AS seen
  UNION ALL
  SELECT c.i, CASE WHEN t THEN list_append(kept, c.id) ELSE kept END, CASE WHEN t THEN list_append(docs, c.doc) ELSE docs END,
         CASE WHEN t THEN list_append(seen, c.s) ELSE seen END
  FROM (SELECT kept, docs, seen, c.*, len(kept) < {k} AND (s = '' OR NOT list_contains(seen, s))
               AND len(list_filter(docs, lambda d: d = c.doc)) < 2 AS t
        FROM greedy g JOIN cand c ON c.i = g.i + 1) c),
final AS (SELECT unnest(kept) AS id, unnest(range(1, len(kept) + 1)) AS place FROM (SELECT kept FROM greedy ORDER BY i DESC LIMIT 1))
"""


GREEDY = greedy_sql("'en', 'de', 'fr'")


def _hybrid(spark, base, languages=("en", "de", "fr"), g=None, **more):
    g = g or texts(spark, base)
    # what the reader may not see is told apart by language here, taken for the category
    g.nodes["Document"] = g.nodes["Document"].withColumn("category", F.col("language"))
    return run_hybrid(g, QUESTION, query_vector(spark, base), k=10, entity_keys=KEYS, measured=lambda n, within: _measured(spark, base, n, within),
                      allowed_categories=list(languages), vectors=text_vectors(spark, base), **more), g


@query(f"""{GREEDY}
SELECT place::INT AS place, id AS chunk_id, doc AS doc_id, round(score, 5) AS rrf_score, via_graph, via_measure,
       'Document ' || doc AS display_title, text
FROM final JOIN cand USING (id) JOIN (SELECT doc_id || ':' || seq AS id, text FROM chunk) USING (id)""")
def hybrid_search(spark, base):
    hits, _ = _hybrid(spark, base)
    return hits.select("place", "chunk_id", "doc_id", "rrf_score", "via_graph", "via_measure", "display_title", "text")


@query(f"""{GREEDY}
SELECT place::INT AS place, id AS chunk_id, doc AS doc_id, round(score, 5) AS rrf_score, via_graph, via_measure,
       'Document ' || doc AS display_title, text
FROM final JOIN cand USING (id) JOIN (SELECT doc_id || ':' || seq AS id, text FROM chunk) USING (id)""")
def hybrid_search_stored(spark, base):
    g, index = _stored(spark, base)
    hits, _ = _hybrid(spark, base, g=g, lookup=True, fulltext=lambda n, within: search_index(spark, index, QUESTION, n, within))
    return hits.select("place", "chunk_id", "doc_id", "rrf_score", "via_graph", "via_measure", "display_title", "text")


# most of the best hits of all texts are hidden from this reader, who gets k of the rest
@query(f"""{greedy_sql("'es'")}
SELECT place::INT AS place, id AS chunk_id, doc AS doc_id, round(score, 5) AS rrf_score FROM final JOIN cand USING (id)""")
def hybrid_search_restricted(spark, base):
    hits, _ = _hybrid(spark, base, ["es"])
    return hits.select("place", "chunk_id", "doc_id", "rrf_score")


@query(f"""{GREEDY}
SELECT place::INT AS place, id AS chunk_id, 'Material:' || source || ':' || n_chars || '|Process:' || lang || ':1' AS entities
FROM final JOIN cand USING (id) JOIN documents d ON d.doc_id::VARCHAR = doc""")
def search_with_entities(spark, base):
    hits, g = _hybrid(spark, base)
    shown = F.transform("entities", lambda e: F.concat_ws(":", e["label"], e["name"], e["mentions"].cast("string")))
    return with_entities(g, hits).select("place", "chunk_id", F.array_join(shown, "|").alias("entities"))


@query(f"""{greedy_sql("'en', 'de', 'fr', 'es'", 25, True)}
SELECT source AS name, 'lab ' || length(source) AS lab, count(DISTINCT doc) AS docs,
       array_to_string(list_sort(list(DISTINCT 'Document ' || doc))[1:5], '|') AS titles
FROM final JOIN cand USING (id) JOIN documents d ON d.doc_id::VARCHAR = doc GROUP BY ALL
ORDER BY docs DESC, name LIMIT 15""")
def experts_by_topic(spark, base):
    g = texts(spark, base)
    docs = table(spark, base, "documents")
    g.edges["AUTHORED_BY"] = docs.select(F.col("doc_id").cast("string").alias("src_id"), F.col("source").alias("dst_id"))
    g.nodes["Person"] = docs.select(F.col("source").alias("id"), F.col("source").alias("name"), F.concat(F.lit("lab "), F.length("source")).alias("lab")).distinct()
    return experts_for_topic(g, QUESTION).withColumn("titles", F.array_join("titles", "|"))
