"""Command line over one graph store.

    python -m lodegraph.cli --store FOLDER VERB …
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from lodegraph.extraction.client import RuleClient
from lodegraph.extraction.pipeline import embed_missing, extract
from lodegraph.functions.vectors import hashing_encoder
from lodegraph.plans import analytics
from lodegraph.plans.search import check_request, hybrid_search
from lodegraph.session import job_session
from lodegraph.sinks.store import Store
from lodegraph.sources import corpus, tabular


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def ping(store: Store, args) -> int:
    print(f"ok {store.spark.range(1).count()}")
    return 0


def schema(store: Store, args) -> int:
    print("\n".join(store.create()) or "nothing to create")
    return 0


def load(store: Store, args) -> int:
    result = tabular.load(store, args.kind, args.path, _now())
    print(result.report())
    return int(not result.rejected.isEmpty())


def load_all(store: Store, args) -> int:
    code = 0
    for kind, result in tabular.load_all(store, args.dir, _now()).items():
        if result is None:
            print(f"[{kind}] no file")
            continue
        print(result.report())
        code |= int(not result.rejected.isEmpty())
    return code


def seed(store: Store, args) -> int:
    for file, n in tabular.load_seed(store, args.dir).items():
        print(f"{file}: {'missing' if n is None else n}")
    return 0


def ingest(store: Store, args) -> int:
    result = corpus.ingest(store, args.dir, _now(), args.category, args.resume, args.limit)
    rejected = result.rejected.count()
    print(f"documents: {result.documents.count()}, chunks: {result.chunks.count()}, rejected: {rejected}")
    return int(rejected > 0)


def index(store: Store, args) -> int:
    store.index_chunks()
    store.index_vectors()
    return 0


def embed(store: Store, args) -> int:
    print(f"embedded: {embed_missing(store, lambda: hashing_encoder(args.dims), args.limit)}")
    return 0


def extract_facts(store: Store, args) -> int:
    """With the rule-based stand-in; a real client is plugged in from Python."""
    graph = store.graph()
    names = {
        kind: [r["name"] for r in graph.node(label).where("needs_review = false").select("name").collect()]
        for kind, label in (("materials", "Material"), ("processes", "Process"), ("equipment", "Equipment"))
    }
    facts = extract(store, lambda: RuleClient(names), RuleClient.model, _now(), args.workers, limit=args.limit,
                    doc_id=args.doc, category=args.category, force=args.force)
    rejected = facts.rejected.count()
    print(f"extracted: {facts.done.count()}, rejected: {rejected}")
    return int(rejected > 0)


def search(store: Store, args) -> int:
    check_request(args.query, args.k, 30, args.language, args.year_from)
    vector = hashing_encoder(args.dims)([args.query])[0]
    hits = hybrid_search(store.graph(), args.query, vector, k=args.k, category=args.category, language=args.language,
                         year_from=args.year_from, lookup=True, fulltext=store.fulltext(args.query), vectors=store.vectors(vector))
    for h in hits.collect():
        print(f"[{h['rrf_score']:.4f}] {h['title']} ({h['category']}, {h['year'] or '—'}, {h['unit_kind']} {h['unit_no']})")
        print("        " + h["text"].replace("\n", " "))
    return 0


def stats(store: Store, args) -> int:
    for title, counts, name in (("nodes", analytics.node_counts, "label"), ("edges", analytics.edge_counts, "type")):
        print(title)
        for r in counts(store.graph()).orderBy(name).collect():
            print(f"  {r[name]}: {r['n']}")
    return 0


def wipe(store: Store, args) -> int:
    if not args.yes:
        print("add --yes to empty the graph")
        return 1
    store.wipe()
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodegraph")
    top.add_argument("--store", default=os.environ.get("LODEGRAPH_STORE", "graph-store"))
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *arguments) -> None:
        sub = verbs.add_parser(name)
        for flags, options in arguments:
            sub.add_argument(*flags, **options)
        sub.set_defaults(run=run)

    limit = (["--limit"], {"type": int})
    category = (["--category"], {})
    dims = (["--dims"], {"type": int, "default": 384})
    verb("ping", ping)
    verb("schema", schema)
    verb("load", load, (["kind"], {"choices": tabular.LOADERS}), (["path"], {}))
    verb("load-all", load_all, (["dir"], {}))
    verb("seed", seed, (["dir"], {}))
    verb("ingest", ingest, (["dir"], {}), limit, category, (["--resume"], {"action": "store_true"}))
    verb("embed", embed, limit, dims)
    verb("index", index)
    verb("extract", extract_facts, limit, (["--doc"], {}), category,
         (["--workers"], {"type": int, "default": 1}), (["--force"], {"action": "store_true"}))
    verb("search", search, (["query"], {}), (["-k"], {"type": int, "default": 8}), category,
         (["--language"], {}), (["--year-from"], {"type": int}), dims)
    verb("stats", stats)
    verb("wipe", wipe, (["--yes"], {"action": "store_true"}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(Store(spark or job_session(), args.store), args)


if __name__ == "__main__":
    sys.exit(main())
