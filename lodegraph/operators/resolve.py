"""Recognising dictionary entities in free text, and mentions in a dictionary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import contains_stems, name_stems, normalize_name, reachable_stems, tokens
from lodegraph.operators.components import connected
from lodegraph.operators.topn import first_per_group
from lodegraph.session import cut_lineage


def resolve_question(dictionary: DataFrame, question: str) -> DataFrame:
    """Entities one of whose variants occurs in the question.

    One question is a literal, so this is a filter over the dictionary.
    """
    words = tokens(F.lit(question))
    hit = F.exists("variants", lambda v: contains_stems(words, name_stems(v)))
    return dictionary.where(hit).select("label", "key", "name")


def resolve_texts(dictionary: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, label, key, name): every entity found in every text.

    All stems of a spelling have to occur, so it is enough to look where its
    rarest one does: that stem meets the texts in an equality join, and for
    the pairs found the spelling's stems are counted in the text by another.
    Rows are pairs of ids and stems throughout; no list of words travels.
    Those rows are many more than their texts, whose size is all that is known
    of them, so both of their joins are merges: neither may become a broadcast.
    """
    written = (
        dictionary.select("label", "key", "name", F.explode("variants").alias("variant"))
        .select("label", "key", "name", F.array_distinct(F.sort_array(name_stems("variant"))).alias("stems"))
        .where(F.size("stems") > 0)
        .select("label", "key", "name", "stems", F.md5(F.array_join("stems", "\n")).alias("spelling"))
    )
    # many entities may share a spelling: texts are matched per spelling
    spelled = written.groupBy("spelling").agg(F.any_value("stems").alias("stems"))
    spelled = spelled.select("spelling", F.size("stems").alias("n_stems"), F.explode("stems").alias("st"))
    words = F.array_distinct(tokens(text_col))
    reach = texts.select(
        F.col(id_col).alias("id"), F.explode(F.array_distinct(F.flatten(F.transform(words, reachable_stems)))).alias("st")
    ).join(spelled.select("st").distinct(), "st", "left_semi")
    reach = cut_lineage(reach).hint("merge")
    rarity = reach.groupBy("st").agg(F.count(F.lit(1)).alias("n"))
    anchored = first_per_group(
        spelled.join(rarity, "st", "left").select("spelling", F.coalesce("n", F.lit(0)).alias("n"), "st"),
        ["spelling"], [F.col("n"), F.col("st")],
    ).where(F.col("n") > 0)
    asked = reach.join(anchored.select("st", "spelling"), "st").select("id", "spelling").distinct()
    matched = (
        asked.join(spelled, "spelling").join(reach, ["id", "st"], "left_semi")
        .groupBy("id", "spelling", "n_stems").agg(F.count(F.lit(1)).alias("met")).where("met = n_stems")
    )
    return matched.join(written, "spelling").select("id", "label", "key", "name").distinct()


def variant_lookup(dictionary: DataFrame) -> DataFrame:
    """(label, variant, key) with one key per normalised variant.

    When several nodes claim a variant, the largest key wins on every run.
    """
    exploded = dictionary.select("label", "key", F.explode("variants").alias("v"))
    return (
        exploded.select("label", normalize_name("v").alias("variant"), "key")
        .where(F.col("variant") != "")
        .groupBy("label", "variant").agg(F.max("key").alias("key"))
    )


def resolve_mentions(mentions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds `key`, null where neither name is in the lookup.

    Needs (label, name, name_en, …). The name is tried before the English name.
    """
    by_name = lookup.select("label", F.col("variant").alias("_n"), F.col("key").alias("_by_name"))
    by_english = lookup.select("label", F.col("variant").alias("_e"), F.col("key").alias("_by_english"))
    keyed = mentions.withColumn("_n", normalize_name("name")).withColumn("_e", normalize_name("name_en"))
    return (
        keyed.join(by_name, ["label", "_n"], "left")
        .join(by_english, ["label", "_e"], "left")
        .withColumn("key", F.coalesce("_by_name", "_by_english"))
        .drop("_n", "_e", "_by_name", "_by_english")
    )


# rounds in which names nobody else can claim are settled at once, before the rest is walked group by group
ROUNDS = 3


def new_entities(unknown: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(label, variant, key, name, name_en): the nodes a run has to create.

    Mentions are taken in order: the first to bring an unseen name creates a
    node and reserves its name and its English name; a later mention with
    either of them belongs to that node and reserves nothing. One row per
    reserved variant. Needs (label, name, name_en, position), position being
    total; mentions without any name create nothing.

    A round settles all mentions that no unsettled earlier one can claim.
    Long chains, where each name waits for the one before, would take a round
    a link, so after a fixed number of rounds what is left is grouped by the
    names that hang together (see `connected`) and each group is walked in
    order by one task, which holds the reserved names of one group.
    """
    names = first_per_group(
        unknown.select("label", F.coalesce(normalize_name("name"), F.lit("")).alias("n"),
                       F.coalesce(normalize_name("name_en"), F.lit("")).alias("e"), "name", "name_en", "position"),
        ["label", "n", "e"], [F.col("position")],
    )
    open_names = cut_lineage(names.where("n <> '' or e <> ''"))
    settled = _reserved(open_names.limit(0))
    for _ in range(rounds):
        if open_names.isEmpty():
            return settled
        variants = open_names.select("label", "position", F.explode(F.array_distinct(F.array("n", "e"))).alias("variant")) \
            .where(F.col("variant") != "")
        firsts = variants.groupBy("label", "variant").agg(F.min("position").alias("first"))
        mine = variants.join(firsts, ["label", "variant"])
        leading = mine.groupBy("label", "position").agg(F.bool_and(F.col("first") == F.col("position")).alias("lead"))
        reserved = cut_lineage(_reserved(open_names.join(leading.where("lead").drop("lead"), ["label", "position"])))
        settled = settled.unionByName(reserved)
        taken = reserved.select("label", "variant")
        open_names = cut_lineage(
            open_names.join(taken.withColumnRenamed("variant", "n"), ["label", "n"], "left_anti")
            .join(taken.withColumnRenamed("variant", "e"), ["label", "e"], "left_anti")
        )
    return settled if open_names.isEmpty() else settled.unionByName(cut_lineage(_reserved(_walked(open_names))))


def _reserved(fresh: DataFrame) -> DataFrame:
    key = F.concat(F.substring("label", 1, 1), F.lit(":"), F.coalesce(F.nullif("n", F.lit("")), "e"))
    return fresh.select(
        "label", F.explode(F.array_distinct(F.array("n", "e"))).alias("variant"), key.alias("key"), "name", "name_en", "position",
    ).where(F.col("variant") != "")


def _walked(names: DataFrame) -> DataFrame:
    """Those of `names` that create a node, by the plain rule inside each connected group.

    Two variants whose hashes collide only put their groups together.
    """
    both = names.withColumn("_a", F.xxhash64("label", F.when(F.col("n") == "", F.col("e")).otherwise(F.col("n")))) \
        .withColumn("_b", F.when(F.col("e") == "", F.col("_a")).otherwise(F.xxhash64("label", "e")))
    roots = connected(both.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    grouped = both.join(roots.toDF("_a", "_root"), "_a").drop("_a", "_b")

    def walk(batches):
        group, taken = None, set()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_root", "label", "n", "e")]
            fresh = []
            for root, label, *forms in zip(*columns):
                if root != group:
                    group, taken = root, set()
                own = {(label, form) for form in forms if form}
                fresh.append(taken.isdisjoint(own))
                if fresh[-1]:
                    taken |= own
            yield batch.filter(pa.array(fresh, pa.bool_()))

    ordered = grouped.repartition("_root").sortWithinPartitions("_root", "position")
    return ordered.mapInArrow(walk, grouped.schema).drop("_root")
