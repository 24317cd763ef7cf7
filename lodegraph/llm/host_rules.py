"""Quality rules judged by host.

Every document is measured on its own; the failures of each rule are then
counted by host and every host's rate is shrunk towards what all hosts show:
a beta prior is fitted by moments to the hosts' rates, so that a host with few
documents is judged mostly by the prior and one with many mostly by its own.
That a document fails any rule counts as one more
rule. The verdict on a host goes back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut_lineage

WINDOW = 8
HOST_LIMIT = 0.5
# how many documents the prior counts for, at least and at most
WEAKEST, STRONGEST = 1.0, 10_000.0
# verdicts, some 40 bytes each, up to which all are broadcast; of hosts with over 1/1000 of the rows there are at most 1000
BROADCAST_HOSTS, HOT_SHARE = 200_000, 1000

RULES = {
    "short": "n_words < 20",
    "repeated": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
# a host may fail by one rule, or by some here and some there
RULES["total"] = " or ".join(RULES.values())
BASE_RULES = ("short", "repeated")
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOLS, _CONTINUATION = b"#*$%&|<>", bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of `window` (a power of two) words that occurs twice or more."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    width = 1
    while width < window:  # numbers of windows of twice the width, from pairs of numbers
        _, ids, counts = np.unique(ids[:-width] * n + ids[width:], return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        width *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The columns of MEASURES for one text in UTF-8."""
    words = text.split()  # bytes part at \x20 and \x09-\x0D only
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (
        len(words), len(joined.translate(None, _CONTINUATION)), len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated_words(words),
    )


def measured(text: Column) -> Column:
    """A struct of MEASURES; a null text has no words."""

    @F.arrow_udf(f"struct<{MEASURES.replace(' long', ':bigint')}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [m.split()[0] for m in MEASURES.split(", ")]
        for batch in batches:
            rows = [measures(text.as_py() or b"") for text in batch]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run(text.cast("binary"))


def prior(hosts: int, docs: int, failed: int, spread: float, squares: float) -> tuple[float, float]:
    """(alpha, beta) of the beta prior of a rule's failure rate over hosts, by moments.

    `spread` is the sum of failed * failed / docs over hosts, `squares` that of
    docs * docs. Where hosts differ no more than chance has it, or nothing can
    be told, the prior counts for STRONGEST documents.
    """
    rate = failed / docs if docs else 0.0
    between, room = spread - failed * rate, docs - squares / docs - (hosts - 1) if docs else 0.0
    noise = rate * (1 - rate)
    alike = (between / noise - (hosts - 1)) / room if noise > 0 and room > 0 else 0.0
    strength = min(max(1 / alike - 1, WEAKEST), STRONGEST) if alike > 0 else STRONGEST
    return rate * strength, (1 - rate) * strength


def verdicts(rows: DataFrame, rules: dict[str, str] = RULES, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_docs, host_rate, host_rule, host_failed) from measured rows with a column `host`.

    `host_rate` is the largest of the shrunk rates and `host_rule` the rule it
    belongs to (the first of equal ones). Counts are folded map-side, so a host
    with a third of all rows is one row per task; what reaches the driver is
    one row of totals.
    """
    hosts = cut_lineage(
        rows.where("host is not null").groupBy("host")
        .agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(F.expr(test)).alias(rule) for rule, test in rules.items()])
    )
    totals = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(F.col("docs").cast("double") * F.col("docs")), F.lit(0.0)).alias("squares"),
        *[F.coalesce(F.sum(rule), F.lit(0)).alias(rule) for rule in rules],
        *[F.coalesce(F.sum(F.col(rule).cast("double") * F.col(rule) / F.col("docs")), F.lit(0.0)).alias(f"{rule}_spread") for rule in rules],
    ).first()
    rates = []
    for k, rule in enumerate(rules):
        alpha, beta = prior(totals["hosts"], totals["docs"], totals[rule], totals[f"{rule}_spread"], totals["squares"])
        rate = F.round((F.col(rule) + alpha) / (F.col("docs") + (alpha + beta)), 6)
        rates.append(F.struct(rate.alias("rate"), F.lit(-k).alias("k"), F.lit(rule).alias("rule")))
    worst = F.array_max(F.array(*rates))
    return hosts.select("host", F.col("docs").alias("host_docs"), worst.alias("worst")).select(
        "host", "host_docs", F.col("worst.rate").alias("host_rate"), F.col("worst.rule").alias("host_rule"),
        (F.col("worst.rate") > limit).alias("host_failed"),
    )


def judged(rows: DataFrame, rules: dict[str, str] = RULES, base_rules=BASE_RULES, limit: float = HOST_LIMIT) -> DataFrame:
    """Measured rows with their host's verdict, `base_failed` and `kept`.

    Few verdicts are broadcast. Many are joined by shuffle, but for those of
    hosts with more than 1/1000 of all rows, of which there are at most 1000.
    """
    found = cut_lineage(verdicts(rows, rules, limit))
    names = ["host_docs", "host_rate", "host_rule", "host_failed"]
    count, docs = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("host_docs"), F.lit(0))).first()
    if count <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        hot = F.broadcast(found.where(F.col("host_docs") * HOT_SHARE > docs))
        rest = rows.join(hot.select("host"), "host", "left_anti")
        joined = rows.join(hot, "host").unionByName(rest.where("host is not null").join(found, "host"))
        none = rest.where("host is null").select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names])
        joined = joined.unionByName(none)
    base = F.expr(" or ".join(f"({rules[r]})" for r in base_rules))
    return joined.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))


def document_rules(docs: DataFrame, host: Column | str = "source", doc_id: str = "doc_id", text: str = "text",
                   limit: float = HOST_LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    then host, host_rate, host_rule.

    `host` is a column of hosts, or an expression such as parse_url(url, 'HOST').

    * null or empty text: no words, base_failed;
    * null host: no host to judge by (host_rate and host_rule null), the base rules decide;
    * null doc_id and repeated rows: each is a row of its own, counted each;
    * ties between rules: the first of RULES is named;
    * very long texts: measured whole, a text at a time;
    * empty table: no rows; further columns are ignored, whatever their names.
    """
    host = F.col(host) if isinstance(host, str) else host
    rows = docs.select(F.col(doc_id).alias("doc_id"), host.cast("string").alias("host"), measured(F.col(text)).alias("m"))
    # numbers only: texts are read once and do not cross the network
    rows = cut_lineage(rows.select("doc_id", "host", "m.*"))
    return judged(rows, limit=limit).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host", "host_rate", "host_rule")


def kept_documents(docs: DataFrame, host: Column | str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows that pass, with all their columns.

    The verdict stays beside its row, so rows without an id and rows that
    share one are judged each by their own text. Texts are measured twice
    rather than stored again.
    """
    host = F.col(host) if isinstance(host, str) else host
    rows = docs.select(F.struct("*").alias("_row"), host.cast("string").alias("host"), measured(F.col(text)).alias("_m"))
    return judged(rows.select("_row", "host", "_m.*"), limit=limit).where("kept").select("_row.*")


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_RATES = "\n  UNION ALL ".join(
    f"SELECT host, {-k} AS k, '{rule}' AS rule, {rule} AS failed, docs FROM hosts" for k, rule in enumerate(RULES))

SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
words AS MATERIALIZED (SELECT row, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS pos FROM d),
wins AS (SELECT row, pos, [{', '.join(f'lead(w, {k}) OVER o' for k in range(WINDOW))}] AS win, lead(pos, {WINDOW - 1}) OVER o AS final
         FROM words WINDOW o AS (PARTITION BY row ORDER BY pos)),
again AS (SELECT row, pos FROM wins WHERE final IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
covered AS (SELECT row, count(DISTINCT pos + k) AS n FROM again, range({WINDOW}) r(k) GROUP BY 1),
lines AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS MATERIALIZED (
  SELECT row, doc_id, host, len({_WORDS}) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines,
         coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines l USING (row) LEFT JOIN covered c USING (row)),
hosts AS MATERIALIZED (SELECT host, count(*) AS docs, {', '.join(f'count(*) FILTER ({test}) AS {rule}' for rule, test in RULES.items())}
                       FROM m WHERE host IS NOT NULL GROUP BY 1),
counts AS MATERIALIZED ({_RATES}),
sums AS (SELECT rule, count(*) AS h, sum(docs)::DOUBLE AS n, sum(failed) / sum(docs)::DOUBLE AS p,
                sum(failed::DOUBLE * failed / docs) - sum(failed) * (sum(failed) / sum(docs)::DOUBLE) AS between_,
                sum(docs) - sum(docs::DOUBLE * docs) / sum(docs) - (count(*) - 1) AS room FROM counts GROUP BY 1),
alike AS (SELECT rule, p, CASE WHEN p * (1 - p) > 0 AND room > 0 THEN (between_ / (p * (1 - p)) - (h - 1)) / room ELSE 0 END AS a FROM sums),
priors AS (SELECT rule, p, CASE WHEN a > 0 THEN least(greatest(1 / a - 1, {WEAKEST}), {STRONGEST}) ELSE {STRONGEST} END AS s FROM alike),
rates AS (SELECT host, rule, k, round((failed + p * s) / (docs + (p * s + (1 - p) * s)), 6) AS rate FROM counts JOIN priors USING (rule)),
worst AS (SELECT host, rate, rule FROM rates QUALIFY row_number() OVER (PARTITION BY host ORDER BY rate DESC, k DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rate > {HOST_LIMIT}, false) AS kept, host, rate AS host_rate, rule AS host_rule
FROM (SELECT *, {' OR '.join(RULES[r] for r in BASE_RULES)} AS base_failed FROM m) LEFT JOIN worst USING (host)
"""
