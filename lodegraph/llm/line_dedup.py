"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Of every window of `run` consecutive line hashes the least is a fingerprint.
Equal windows have equal fingerprints, so a repeated run of `run` lines or
more is guaranteed to share one. Fingerprints that occur once in the corpus
settle most of every document without looking at its runs. Around the others
matches are extended both ways: all windows that contain the fingerprint are
looked up, the first occurrence of each is found by a grouped minimum, and the
later ones are joined to maximal runs and deleted. No pair of occurrences is
ever formed, so a line that stands in a third of all documents costs one row
per occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import texts
from lodegraph.session import cut_lineage

RUN, LONG_LINE = 2, 50


def _windows(run: int, long_line: int) -> Column:
    """Structs (at, n, least, key, key2) from the columns lines, hashes and sizes: every
    window of `run` lines, and every line of `long_line` words."""
    last = F.size("hashes") - run

    def window(at: Column, n: int) -> Column:
        own, sizes = F.slice("hashes", at + 1, n), F.slice("sizes", at + 1, n)
        return F.struct(
            at.alias("at"), F.lit(n).alias("n"), F.array_min(own).alias("least"),
            F.xxhash64(own, sizes).alias("key"), F.hash(sizes, own).alias("key2"),
        )

    runs = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda at: window(at, run))).otherwise(F.array())
    words = lambda line: F.size(F.split(F.trim(line), r"\s+"))
    long_lines = F.filter(
        F.transform("lines", lambda line, at: F.when((F.length(line) >= 2 * long_line - 1) & (words(line) >= long_line), window(at, 1))),
        lambda w: w.isNotNull(),
    )
    return F.concat(runs, long_lines)


def line_dedup(
    docs: DataFrame, run: int = RUN, long_line: int = LONG_LINE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text without later repeated runs.

    A line goes if it lies in a run of `run` consecutive lines, or is a line
    of `long_line` words or more, that occurs earlier: in a document of
    smaller id, or further up in the same one. Lines are compared as they are;
    the remaining lines are joined again by line breaks.

    * null or empty text: one empty line, text empty, nothing removed, as
      from any document shorter than `run` lines without a long line;
    * null doc_id: neither removed from nor counted as an earlier occurrence;
    * repeated rows (same id and text) are one document: treated alike and not
      repeats of each other; rows with one id and different texts are ordered
      by a hash of the text;
    * overlapping repeats (one line many times): the first line stays;
    * very long texts: linear in their lines; empty table: no rows;
    * further columns are ignored.
    """
    rows = texts(docs, doc_id=doc_id, text=text).withColumn("th", F.xxhash64("text"))
    lines = F.split(F.col("text"), "\n", -1)
    # columns of their own, so that no lambda computes them again for each line
    listed = rows.where("doc_id is not null").select("doc_id", "th", lines.alias("lines")).select(
        "*", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", F.length).alias("sizes")
    )
    windows = cut_lineage(
        listed.select("doc_id", "th", F.explode(_windows(run, long_line)).alias("w")).select("doc_id", "th", "w.*")
    )
    prints = windows.select("doc_id", "th", "n", "least", "at").groupBy("least", "n").agg(
        F.count(F.lit(1)).alias("times")
    ).where("times > 1").select("least", "n")
    suspects = windows.join(cut_lineage(prints), ["least", "n"], "left_semi").drop("least")
    suspects = cut_lineage(suspects)
    first = suspects.groupBy("key", "key2", "n").agg(
        F.min(F.struct("doc_id", "th", "at")).alias("first"), F.count(F.lit(1)).alias("times")
    ).where("times > 1").drop("times")
    later = suspects.join(cut_lineage(first), ["key", "key2", "n"]).where(
        F.struct("doc_id", "th", "at") != F.col("first")
    ).select("doc_id", "th", "at", (F.col("at") + F.col("n")).alias("to"))
    # maximal runs of a document: an interval opens a run if it begins beyond all before it
    order = Window.partitionBy("doc_id", "th").orderBy("at", "to")
    marked = later.withColumn("reach", F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = marked.withColumn("no", F.sum(F.when(F.col("at") > F.col("reach"), 1).otherwise(0)).over(order))
    gone = (
        numbered.groupBy("doc_id", "th", "no").agg(F.min("at").alias("at"), F.max("to").alias("to"))
        .groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("gone"))
    )
    joined = rows.join(gone, ["doc_id", "th"], "left").withColumn("lines", lines)
    # what stays: before the first run, between runs, after the last
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["to"]))
    ends = F.concat(F.transform("gone", lambda g: g["at"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(F.col("lines"), b + 1, e - b)))
    removed = F.aggregate("gone", F.lit(0), lambda n, g: n + g["to"] - g["at"])
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


SQL = f"""
WITH lines AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, unnest(range(0, len(lines) - {RUN} + 1)) AS pos, {RUN} AS n, lines FROM lines WHERE len(lines) >= {RUN}
  UNION ALL
  SELECT doc_id, pos, 1, lines FROM (SELECT doc_id, unnest(range(0, len(lines))) AS pos, lines FROM lines)
  WHERE len(regexp_split_to_array(trim(lines[pos + 1]), '\\s+')) >= {LONG_LINE}
),
keyed AS (SELECT doc_id, pos, n, array_to_string(lines[pos + 1 : pos + n], chr(10)) AS key FROM windows),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n, key ORDER BY doc_id, pos) AS place FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM ordered WHERE place > 1),
numbered AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM lines),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM numbered ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(lines) AS n_lines, len(lines) - coalesce(n, 0) AS n_removed, coalesce(kept.text, '') AS text
FROM lines LEFT JOIN kept USING (doc_id)
"""
