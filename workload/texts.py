"""Text functions over whole tables, chunking, entity recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.functions.ids import document_id, entity_id
from lodegraph.operators.resolve import resolve_mentions, resolve_texts, variant_lookup
from lodegraph.operators.topn import first_per_group
from lodegraph.plans.analytics import chunk_context as context_of
from lodegraph.plans.analytics import document_sizes as sizes_of
from lodegraph.sources.roles import dialogues, table, text_documents, texts
from workload.registry import query

WS = T.SPACE


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def norm_sql(x: str) -> str:
    return f"replace({fold_sql(f'''regexp_replace({x}, '[{WS}_/-]+', '', 'g')''')}, 'ё', 'е')"


def tokens_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), '[а-яёa-z0-9]+'), lambda w: replace(w, 'ё', 'е'))"


def stem_sql(w: str) -> str:
    return (f"CASE WHEN length({w}) >= 6 THEN left({w}, length({w}) - 2) "
            f"WHEN length({w}) >= 4 THEN left({w}, length({w}) - 1) ELSE {w} END")


@query(f"SELECT doc_id::VARCHAR AS doc_id, md5({norm_sql('text')}) AS norm_md5 FROM documents")
def normalize_name(spark, base):
    return text_documents(spark, base).select("doc_id", F.md5(T.normalize_name("text")).alias("norm_md5"))


@query("""
SELECT doc_id::VARCHAR AS doc_id, md5(trim(translate(text, '+-&|!(){}[]^"~*?:\\/', repeat(' ', 19)), ' ' || chr(10))) AS escaped_md5
FROM documents""")
def lucene_escape(spark, base):
    return text_documents(spark, base).select("doc_id", F.md5(T.escape_query("text")).alias("escaped_md5"))


FLAT = f"trim({fold_sql(f'''regexp_replace(text, '[{WS}]+', ' ', 'g')''')})"
# a text's identity: all of it, or by request its first 420 characters
WHOLE = f"CASE WHEN {FLAT} = '' THEN '' ELSE md5({FLAT}) END"
BEGINNING = f"left({FLAT}, 420)"


@query(f"SELECT doc_id::VARCHAR AS doc_id, {WHOLE} AS signature, {BEGINNING} AS beginning FROM documents")
def text_signature(spark, base):
    return text_documents(spark, base).select(
        "doc_id", T.signature("text").alias("signature"), T.signature("text", T.SIGNATURE_CHARS).alias("beginning"))


@query(f"SELECT {WHOLE} AS signature, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_per_signature(spark, base):
    docs = table(spark, base, "documents").select(T.signature("text").alias("signature"), "doc_id")
    return first_per_group(docs.withColumn("o", F.col("doc_id")), ["signature"], [F.col("o")]).drop("o")


@query(f"SELECT {BEGINNING} AS signature, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_per_beginning(spark, base):
    docs = table(spark, base, "documents").select(T.signature("text", T.SIGNATURE_CHARS).alias("signature"), "doc_id")
    return first_per_group(docs.withColumn("o", F.col("doc_id")), ["signature"], [F.col("o")]).drop("o")


@query(r"""
SELECT doc_id::VARCHAR AS doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
       CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 THEN 'unknown'
            WHEN length(regexp_replace(text, '[^а-яА-ЯёЁ]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0.4
            THEN 'ru' ELSE 'en' END AS language FROM documents""")
def detect_language(spark, base):
    return text_documents(spark, base).select(
        "doc_id", F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("long").alias("letters"),
        T.detect_language("text").alias("language"))


@query(r"""
SELECT p_partkey, CASE WHEN regexp_matches(p_name || '.qxd', '(?i)\.(qxd|indd|pmd|p65|cdr|fm)$|^[A-Za-z]{2,4}[_-]?[0-9]')
            AND p_type <> 'SMALL' THEN p_type || CASE WHEN p_size > 25 THEN ', ' || (1950 + p_size) ELSE '' END
       ELSE p_name || CASE WHEN p_type = 'SMALL' THEN '.qxd' ELSE '' END END AS title FROM part""")
def display_title(spark, base):
    journal = F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type"))
    return table(spark, base, "part").select("p_partkey", T.display_title(
        F.concat("p_name", F.lit(".qxd")), journal, F.when(F.col("p_size") > 25, F.col("p_size") + 1950)).alias("title"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'мг/л' WHEN 'R' THEN 'а*ч/м3' ELSE '' END || lower(l_linestatus) AS unit
FROM lineitem""")
def unit_normalize(spark, base):
    written = F.when(F.col("l_returnflag") == "A", "мг / дм³").when(F.col("l_returnflag") == "R", "А·ч/м³")
    return table(spark, base, "lineitem").select(
        "l_orderkey", "l_linenumber", T.normalize_unit(F.concat(F.coalesce(written, F.lit("")), F.col("l_linestatus"))).alias("unit"))


@query(r"""
SELECT page_id, coalesce(nullif(regexp_extract(url, '(19[5-9][0-9]|20[0-2][0-9])', 1), ''),
                         nullif(regexp_extract(html, '(19[5-9][0-9]|20[0-2][0-9])', 1), '')) AS year FROM pages""")
def find_year(spark, base):
    return table(spark, base, "pages").select("page_id", T.find_year("url", "html").cast("string").alias("year"))


@query("SELECT page_id, 'D' || left(sha1(url), 12) AS doc_id FROM pages")
def document_ids(spark, base):
    return table(spark, base, "pages").select("page_id", document_id("url").alias("doc_id"))


@query(f"SELECT p_partkey, 'M:' || {norm_sql('p_name')} AS key FROM part")
def entity_ids(spark, base):
    return table(spark, base, "part").select("p_partkey", entity_id("Material", "p_name").alias("key"))


@query(f"""
SELECT doc_id::VARCHAR AS doc_id, len({tokens_sql('text')}) AS words,
       md5(array_to_string(list_transform({tokens_sql('text')}, lambda w: {stem_sql('w')}), ' ')) AS stems_md5 FROM documents""")
def token_stems(spark, base):
    words = T.tokens("text")
    return text_documents(spark, base).select(
        "doc_id", F.size(words).cast("long").alias("words"),
        F.md5(F.array_join(F.transform(words, T.stem), " ")).alias("stems_md5"))


# --- entity recognition --------------------------------------------------------


def _dictionary(spark, base):
    part = table(spark, base, "part")
    return part.select(
        F.lit("Material").alias("label"), F.col("p_name").alias("key"), F.col("p_name").alias("name"),
        F.array("p_name", F.concat("p_type", F.lit(" "), "p_brand")).alias("variants"))


def _questions(spark, base):
    """One question per page: its address and markup words, against part names; and one per part."""
    return table(spark, base, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("Which "), "p_name", F.lit("s compare with "), F.lower("p_type"), F.lit(" items, "), "p_brand").alias("text"))


@query(f"""
WITH q AS (SELECT p_partkey AS id, {tokens_sql("'Which ' || p_name || 's compare with ' || lower(p_type) || ' items, ' || p_brand")} AS words FROM part),
v AS (SELECT DISTINCT p_name AS name, list_distinct(list_transform({tokens_sql('v')}, lambda w: {stem_sql('w')})) AS stems
      FROM (SELECT p_name, unnest([p_name, p_type || ' ' || p_brand]) AS v FROM part))
SELECT DISTINCT id, 'Material' AS label, name AS key, name FROM q, v
WHERE len(list_filter(stems, lambda st: len(list_filter(words, lambda w: starts_with(w, st) AND length(w) <= length(st) + 3)) > 0)) = len(stems)""")
def entity_resolver(spark, base):
    return resolve_texts(_dictionary(spark, base).distinct(), _questions(spark, base))


# whole documents against the openings of the benchmark's passages, some of which they contain
OPENING = "array_to_string(string_split(text, ' ')[1:4], ' ')"


@query(f"""
WITH q AS (SELECT doc_id AS id, list_distinct({tokens_sql('text')}) AS words FROM documents),
v AS (SELECT item_id::VARCHAR AS key, {OPENING} AS name,
             list_distinct(list_transform({tokens_sql(OPENING)}, lambda w: {stem_sql('w')})) AS stems FROM benchmark)
SELECT id, 'Process' AS label, key, name FROM q, v
WHERE len(stems) > 0 AND len(list_filter(stems, lambda st: len(list_filter(words, lambda w: starts_with(w, st) AND length(w) <= length(st) + 3)) > 0)) = len(stems)""")
def entity_resolver_documents(spark, base):
    opening = F.array_join(F.slice(F.split("text", " ", -1), 1, 4), " ")
    dictionary = table(spark, base, "benchmark").select(
        F.lit("Process").alias("label"), F.col("item_id").cast("string").alias("key"), opening.alias("name"), F.array(opening).alias("variants"))
    return resolve_texts(dictionary, table(spark, base, "documents"), "doc_id")


@query(f"""
WITH entries AS (SELECT p_partkey::VARCHAR AS key, unnest([p_name, p_brand]) AS v FROM part),
lookup AS (SELECT {norm_sql('v')} AS variant, max(key) AS key FROM entries GROUP BY 1)
SELECT p_partkey, coalesce(n.key, e.key) AS key FROM part
LEFT JOIN lookup n ON n.variant = {norm_sql("CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE 'no ' || p_type END")}
LEFT JOIN lookup e ON e.variant = {norm_sql("replace(p_brand, '#', '# ')")}""")
def mention_resolution(spark, base):
    part = table(spark, base, "part")
    entries = part.select(F.lit("Material").alias("label"), F.col("p_partkey").cast("string").alias("key"), F.array("p_name", "p_brand").alias("variants"))
    mentions = part.select(
        "p_partkey", F.lit("Material").alias("label"),
        F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("no "), "p_type")).alias("name"),
        F.replace("p_brand", F.lit("#"), F.lit("# ")).alias("name_en"))
    return resolve_mentions(mentions, variant_lookup(entries)).select("p_partkey", "key")


@query(f"""
SELECT 'Material' AS label, {norm_sql('v')} AS variant, max(key) AS key
FROM (SELECT p_partkey::VARCHAR AS key, unnest([p_name, p_brand]) AS v FROM part) GROUP BY 2""")
def variant_keys(spark, base):
    entries = table(spark, base, "part").select(
        F.lit("Material").alias("label"), F.col("p_partkey").cast("string").alias("key"), F.array("p_name", "p_brand").alias("variants"))
    return variant_lookup(entries)


# --- chunks ---------------------------------------------------------------------

CHUNKS = """
RECURSIVE walk AS (
  SELECT doc_id, text, length(text) AS n, 0 AS pos, 0 AS nxt, ''::VARCHAR AS piece FROM documents
  UNION ALL
  SELECT doc_id, text, n, pos + 1, CASE WHEN e >= n THEN n + 1 ELSE greatest(e - 150, nxt + 1) END,
         CASE WHEN n <= 1200 THEN text ELSE trim(substring(text, nxt + 1, e - nxt), ' ' || chr(10)) END
  FROM (SELECT *, CASE WHEN w >= n THEN n WHEN cut >= 0 THEN nxt + 600 + cut + 1 ELSE w END AS e
        FROM (SELECT *, least(nxt + 1200, n) AS w,
                     greatest(CASE WHEN contains(half, chr(10)) THEN length(regexp_extract(half, '(?s)^(.*)\\n', 1)) ELSE -1 END,
                              CASE WHEN contains(half, '. ') THEN length(regexp_extract(half, '(?s)^(.*)\\. ', 1)) ELSE -1 END) AS cut
              FROM (SELECT *, substring(text, nxt + 601, 600) AS half FROM walk WHERE nxt <= n AND NOT (pos > 0 AND nxt = n + 1)))
       )
),
chunk AS MATERIALIZED (SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INT AS seq, piece AS text
          FROM walk WHERE pos > 0 AND piece <> '')
"""


@query(f"WITH {CHUNKS} SELECT doc_id || ':' || seq AS id, doc_id, seq, text FROM chunk")
def chunk_documents(spark, base):
    return texts(spark, base).node("Chunk").select("id", "doc_id", "seq", "text")


@query("""
SELECT f.conv_id || ':' || f.turn AS focus_id, n.turn AS seq, n.text, 'Conversation ' || f.conv_id AS title
FROM conversations f JOIN conversations n ON f.conv_id = n.conv_id AND n.turn BETWEEN f.turn - 2 AND f.turn + 2""")
def chunk_context(spark, base):
    return context_of(dialogues(spark, base)).select("focus_id", "seq", "text", "title")


@query("SELECT conv_id::VARCHAR AS doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def document_sizes(spark, base):
    return sizes_of(dialogues(spark, base))
