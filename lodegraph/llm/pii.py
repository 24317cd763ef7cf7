"""Personal data by information-theoretic sanitisation, in DataFrame operations only.

Base spans (e-mail, IP, card, phone) are found by pattern and checked. Each
distinct value is a protected entity. The corpus then tells which other words
give an entity away: for every word in a document with the entity, the pointwise
mutual information of word and entity, counted over all documents, is set
against the information content of the entity itself,

    PMI = log2(N * n(word and entity) / (n(word) * n(entity)))
    IC  = log2(N / n(entity)),     disclosure = PMI / IC,

where n counts documents; it is 1 when the word occurs with that entity only.
Words at or above the `remove` threshold are removed, words at or above
`generalise` are replaced by a placeholder, wherever any text has them, with
the entity beside them or without. A word needs `support` different contexts
of the entity (what stands within `reach` characters of it) in as many
documents, so that one sentence copied many times and one document that
repeats itself are no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import texts
from lodegraph.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
REACH, SUPPORT, GENERALISE, REMOVE = 120, 3, 0.7, 0.9

# The base patterns, written so that a search is linear: a run is tried at its
# beginning only (or where the match before ended), and nothing is given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# a whole run of digits with single separators, if it has 14 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# what a text must contain for a pattern to be worth a search
HINTS = (r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9]")
# what parts words: blanks and the punctuation around them; tried where a word ends only, so that a search is linear
BETWEEN = r"(?<![^\p{L}\p{M}\p{N}])[^\s\p{Z}\p{L}\p{M}\p{N}]*+[\s\p{Z}][^\p{L}\p{M}\p{N}]*+"
# put around the terms of a text to find their places; a text's own are read as the second character
SIGN, OWN_SIGN = "\x01", "\x02"
# terms up to which they are broadcast
BROADCAST_ROWS = 100_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def weight(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + weight(i)) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    byte = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    count = F.length(_digits(value))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, value.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(kind == 2, count.between(14, 19) & _luhn(value))
        .otherwise(count.between(10, 15))
    )


def _found(text: Column, pattern: str, hint: str, kind: int, reach: int) -> Column:
    """Structs (kind, no, gap, value, before, after) of a pattern's matches; gap counts the characters since the last one."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(matches, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("no"), F.length(gaps[i]).alias("gap"), m.alias("value"),
        F.substring(gaps[i], -reach, reach).alias("before"), F.substring(gaps[i + 1], 1, reach).alias("after"),
        (F.length(gaps[i + 1]) > reach).alias("cut"),
    ))
    return F.when(text.rlike(hint), found)


def base_spans(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, th, kind, value, start, end, before, after, cut) of every valid base span.

    rows: doc_id, th (a hash of the text), text. Rows with one id and text give one set of spans.
    """
    text = F.col("text")
    found = [F.coalesce(_found(text, p, h, k, reach), F.array()) for k, (p, h) in enumerate(zip((EMAIL, IP, CARD, PHONE), HINTS))]
    each = (
        rows.where(text.rlike("|".join(HINTS)))
        .select("doc_id", "th", F.concat(*found).alias("found")).where(F.size("found") > 0)
        .dropDuplicates(["doc_id", "th"])
        .select("doc_id", "th", F.explode("found").alias("f")).select("doc_id", "th", "f.*")
    )
    order = Window.partitionBy("doc_id", "th", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).where(
        _valid(F.col("kind"), F.col("value"))
    ).select("doc_id", "th", "kind", "value", "start", "end", "before", "after", "cut")


def _framed(text: Column) -> Column:
    """The text with a blank around it, so that its first and last word end like others."""
    return F.concat(F.lit(" "), F.translate(text, SIGN, OWN_SIGN), F.lit(" "))


def _words(text: Column) -> Column:
    """The distinct words of a text in lower case: from the first to the last letter or digit between two blanks.

    Hyphens, apostrophes and digits belong to a word; what has an address sign within is an address and no word.
    """
    every = F.transform(F.split(_framed(text), BETWEEN, -1), F.lower)
    return F.array_distinct(F.filter(every, lambda w: (w != "") & ~F.contains(w, F.lit("@"))))


def _few(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms


def _entity() -> Column:
    return F.concat_ws(":", F.col("kind"), F.lower("value"))


def disclosing(rows: DataFrame, spans: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(entity, word, disclosure) of the words that give an entity away, and (doc_id, th, word) of all texts that hold one of them."""
    mentions = cut_lineage(spans.select("doc_id", "th", _entity().alias("entity"), F.xxhash64("before", "after").alias("context")).distinct())
    # no pair can have more documents or contexts than its entity
    entities = cut_lineage(
        mentions.groupBy("entity")
        .agg(F.count_distinct(F.struct("doc_id", "th")).alias("n_entity"), F.count_distinct("context").alias("contexts"))
        .where((F.col("n_entity") >= support) & (F.col("contexts") >= support)).drop("contexts")
    )
    held = mentions.join(entities, "entity").groupBy("doc_id", "th").agg(F.collect_set("entity").alias("entities"))
    # repeated rows count here, so that no text is shuffled for them: n_both is too large at most, and counted anew below
    holders = _same(rows.where(F.col("text").rlike("|".join(HINTS))), held, "inner").select("entities", _words(F.col("text")).alias("words"))
    pairs = cut_lineage(
        holders.select(F.explode("entities").alias("entity"), "words").select("entity", F.explode("words").alias("word"))
        .groupBy("entity", "word").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support)
    )
    every = rows.select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_word"))
    n_all = F.lit(rows.count())
    content = F.log2(n_all / F.col("n_entity"))
    mutual = F.log2(n_all * F.col("n_both") / (F.greatest("n_word", "n_both") * F.col("n_entity")))
    disclosure = F.when(content > 0, mutual / content).otherwise(F.lit(0.0))
    likely = cut_lineage(pairs.join(every, "word").join(entities, "entity").where(disclosure >= generalise).drop("n_both"))
    asked = cut_lineage(likely.select("word").distinct())
    holding = cut_lineage(
        rows.select("doc_id", "th", F.explode(_words(F.col("text"))).alias("word")).join(_few(asked), "word").distinct()
    )
    seen = holding.join(likely, "word").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("entity").alias("__entity"), "word", "n_word", "n_entity")
    met = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")) & (F.col("entity") == F.col("__entity"))
    proven = mentions.join(seen, met).groupBy("entity", "word", "n_word", "n_entity").agg(
        F.count_distinct("context").alias("contexts"), F.count_distinct(F.struct("doc_id", "th")).alias("n_both")
    ).where((F.col("contexts") >= support) & (F.col("n_both") >= support))
    return cut_lineage(proven.select("entity", "word", disclosure.alias("disclosure")).where(F.col("disclosure") >= generalise)), holding


def occurrences(rows: DataFrame, holding: DataFrame) -> DataFrame:
    """(doc_id, th, word, start, end) of every occurrence in `rows` of the words (doc_id, th, word) that they hold."""
    asked = holding.groupBy("doc_id", "th").agg(F.collect_set("word").alias("asked"))
    framed = _framed(F.col("text"))
    cut = _same(rows, asked, "inner").select(
        "doc_id", "th", "asked", F.split(framed, BETWEEN, -1).alias("words"), F.regexp_extract_all(framed, F.lit(BETWEEN), F.lit(0)).alias("between")
    )
    signed = F.transform("words", lambda w: F.when(F.array_contains("asked", F.lower(w)), F.concat(F.lit(SIGN), w, F.lit(SIGN))).otherwise(w))
    # gap, word, gap, word, ..., gap
    parts = F.split(F.array_join(F.zip_with(signed, "between", lambda w, b: F.concat(w, F.coalesce(b, F.lit("")))), ""), SIGN, -1)
    each = cut.select("doc_id", "th", parts.alias("parts")).select("doc_id", "th", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2)), lambda i: F.struct(F.length(F.col("parts")[i - 1]).alias("gap"), F.col("parts")[i].alias("word")))
    ).alias("no", "o")).select("doc_id", "th", "no", "o.*").distinct()  # repeated rows once
    order = Window.partitionBy("doc_id", "th").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("word")).over(order) - 1  # less the blank of the frame
    return each.withColumn("end", end).select("doc_id", "th", F.lower("word").alias("word"), (F.col("end") - F.length("word")).alias("start"), "end")


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH, support: int = SUPPORT,
               generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, th, text) and their spans (doc_id, th, kind, start, end, disclosure)."""
    rows = texts(docs, doc_id=doc_id, text=text).withColumn("th", F.xxhash64("text"))
    spans = cut_lineage(base_spans(rows, reach))
    given_away, holding = disclosing(rows, spans, support, generalise)
    words = cut_lineage(given_away.groupBy("word").agg(F.max("disclosure").alias("disclosure")))
    terms = occurrences(rows, holding.join(_few(words.select("word")), "word")).join(_few(words), "word")
    number = F.lit(len(KINDS))
    both = spans.select("doc_id", "th", "kind", "start", "end", F.lit(1.0).alias("disclosure")).union(
        terms.select("doc_id", "th", number.alias("kind"), "start", "end", "disclosure")
    )
    # a word within a base span (the parts of a card number) is no term of its own
    order = Window.partitionBy("doc_id", "th").orderBy("start", "kind", "end")
    base = F.col("kind") < number
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("doc_id", "th").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    covered = ~base & (F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    return rows, cut_lineage(both.withColumn("covered", covered).where("not covered").drop("covered"))


def _named(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.concat_ws(":", names[s["kind"]], s["start"], s["end"])


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on (doc_id, th) in which null ids meet too."""
    own = right.withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    return left.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), how).drop("__id", "__th")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Positions are code points, ends exclusive; spans are ordered by start,
    then kind (e-mail, IP, card, phone, term).

    * null or empty text, text without personal data: zero counts, no spans;
    * null doc_id, repeated rows, rows with one id and several texts: a row
      each, with the spans of its own text;
    * very long texts are searched whole; an empty table has no rows;
    * ties: a word at a threshold exceeds it; further columns are ignored.

    Options: see find_spans.
    """
    rows, spans = find_spans(docs, **options)
    one = F.struct("start", "kind", "end")
    per = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(one)).alias("all"))
    joined = _same(rows.select("doc_id", "th"), per, "left")
    found = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    joined = joined.select("doc_id", found.alias("all"))
    base = F.filter("all", lambda s: s["kind"] < len(KINDS))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(F.array_join(F.transform(base, _named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all", _named), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, remove: float = REMOVE, **options) -> DataFrame:
    """(doc_id, text) with base spans as [EMAIL] and so on, disclosing words removed or as [TERM].

    Overlapping spans are replaced together, under the name of the first. Rows as in personal_data.
    """
    rows, spans = find_spans(docs, **options)
    order = Window.partitionBy("doc_id", "th").orderBy("start", "kind", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)])
    word = F.when((F.col("kind") == len(KINDS)) & (F.col("disclosure") >= remove), F.lit("")).otherwise(names[F.col("kind")])
    merged = (
        spans.withColumn("put", word).withColumn("reach", reach)
        .withColumn("no", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order))
        .groupBy("doc_id", "th", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("put", F.struct("start", "kind", "end")).alias("put"))
        .groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("cuts"))
    )
    joined = _same(rows, merged, "left")
    last = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["end"]))
    parts = F.zip_with(last, "cuts", lambda b, c: F.concat(
        F.substring(F.col("text"), (b + 1).cast("int"), (F.coalesce(c["start"], F.length("text").cast("long")) - b).cast("int")),
        F.coalesce(c["put"], F.lit("")),
    ))
    return joined.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(parts, "")).alias("text"))
