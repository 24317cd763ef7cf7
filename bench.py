"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. Every query runs
over whole tables and its full result is consumed; the value is the sum of
the per-query medians of the warm runs (three, fewer for a slow query; at
least one).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

import workload  # noqa: E402
from lodegraph.operators import fulltext  # noqa: E402
from lodegraph.operators.vector_index import VectorIndex  # noqa: E402
from lodegraph.plans import search  # noqa: E402
from lodegraph.plans.kept import Kept  # noqa: E402
from lodegraph.session import local_session  # noqa: E402
from lodegraph.sources import roles  # noqa: E402
from workload import retrieval  # noqa: E402

# seconds after which a query is not repeated any more
PATIENCE = 20.0

HEADLINES = [
    "hybrid_search", "bm25_topk", "vector_topk", "rrf_fusion", "chunk_documents", "dashboard_coverage",
    "dashboard_totals", "experts_top", "risk_pairs", "gap_matrix", "gap_pairs_not_exists", "gap_pivot_topn",
    "graph_around_entity", "doc_top_entities", "measurement_candidates", "entity_resolver", "mention_upsert_counts",
    "conclusion_versions", "graph_stats_edges", "experts_by_process",
]


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def consumed(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stored_search(spark, base: str) -> dict[str, float]:
    """Searches over a stored graph: chunks, text and vector index written once,
    as the original keeps them, then the same four-channel query; and what a
    batch of a hundredth of the chunks costs the text index."""
    folder = tempfile.mkdtemp(prefix="run-bench-", dir="/tmp")
    graph, vectors = roles.texts(spark, base), VectorIndex(spark, f"{folder}/vectors", rows_a_band=100)

    def build() -> None:
        graph.node("Chunk").write.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{folder}/chunks")
        graph.nodes["Chunk"] = spark.read.parquet(f"{folder}/chunks")
        fulltext.write_index(graph.node("Chunk"), f"{folder}/index")

    out = {"stored_index_build": timed(build), "vector_index_build": timed(lambda: vectors.build(roles.text_vectors(spark, base)))}
    hundredth = F.pmod(F.xxhash64("id"), F.lit(100)) == 0
    out["stored_index_batch"] = timed(lambda: fulltext.update_index(graph.node("Chunk").where(hundredth), f"{folder}/index"))
    query = retrieval.query_vector(spark, base)
    searches = {
        "stored_hybrid_search": lambda: search.hybrid_search(
            graph, retrieval.QUESTION, query, k=10, entity_keys=retrieval.KEYS, lookup=True,
            fulltext=fulltext.search_index(spark, f"{folder}/index", retrieval.QUESTION, 50),
            vectors=lambda n, within: vectors.search(query, n, within)),
        "vector_index_search": lambda: vectors.search(query, 20),
    }
    for name, run in searches.items():
        times = [timed(lambda run=run: consumed(run())) for _ in range(4)]
        out[name] = statistics.median(times[1:])
    return out


def kept_dashboard(spark, base: str) -> dict[str, float]:
    """All five parts of the dashboard from kept counts, and what keeping them costs."""
    kept, graph = Kept(spark, f"{tempfile.mkdtemp(prefix='run-bench-', dir='/tmp')}/kept"), roles.records(spark, base)
    build = timed(lambda: kept.rebuild(graph))
    times = [timed(lambda: [df.collect() for df in kept.dashboard().values()]) for _ in range(4)]
    return {"kept_dashboard_build": build, "kept_dashboard": statistics.median(times[1:])}


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in sys.argv[1:] if n != "stored"] if sys.argv[1:] else HEADLINES
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        times = []
        while len(times) < 2 or (len(times) <= runs and sum(times) < PATIENCE):
            began = time.perf_counter()
            workload.QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: cold {times[0]:.2f} s, warm {seconds[name]:.2f} s", file=sys.stderr, flush=True)
    if not sys.argv[1:] or "stored" in sys.argv[1:]:
        seconds.update({name: round(t, 3) for part in (stored_search, kept_dashboard) for name, t in part(spark, base).items()})
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(base.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
