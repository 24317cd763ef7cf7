import pytest

from lodegraph import cli
from lodegraph.sinks import audit
from lodegraph.streaming import jobs

CHUNK = "id string, doc_id string, seq int, unit_no int, unit_kind string, text string"
MENTION = "src_id string, dst_label string, dst_id string, source string, unit string, confidence double, extracted_at string, model string"
CONCLUSION = ("id string, text string, confidence double, geography string, date date, needs_review boolean, now string, model string")


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def work_off(query):
    query.awaitTermination()
    assert query.exception() is None


def test_chunks_continue_where_they_stopped(spark, store, folder):
    run = lambda: work_off(jobs.chunk_upserts(store, jobs.arriving(spark, f"{folder}/in", CHUNK), f"{folder}/cp"))
    land(spark, f"{folder}/in", [("D:1", "D", 1, 1, "page", "a"), ("D:2", "D", 2, 1, "page", "b")], CHUNK)
    run()
    land(spark, f"{folder}/in", [("D:2", "D", 2, 1, "page", "c")], CHUNK)
    run()
    run()
    assert {r["id"]: r["text"] for r in store.read("Chunk").collect()} == {"D:1": "a", "D:2": "c"}


def test_counts_are_those_of_one_batch_run(spark, store, folder):
    run = lambda: work_off(jobs.mention_counts(store, jobs.arriving(spark, f"{folder}/in", MENTION, 1), f"{folder}/cp"))
    row = lambda chunk, at: ("D", "Material", "M:1", chunk, "page 1", 0.8, at, "m")
    land(spark, f"{folder}/in", [row("D:1", "t1"), row("D:1", "t1")], MENTION)
    run()
    land(spark, f"{folder}/in", [row("D:2", "t2")], MENTION)
    run()
    run()
    edge = store.read("MENTIONS").first()
    assert (edge["count"], edge["source"], edge["extracted_at"]) == (3, "D:2", "t2")


def test_conclusions_are_versioned_batch_by_batch(spark, store, folder):
    run = lambda: work_off(jobs.versioned_conclusions(store, jobs.arriving(spark, f"{folder}/in", CONCLUSION, 1), f"{folder}/cp"))
    for text, now in (("a", "t1"), ("a", "t2"), ("b", "t3")):
        land(spark, f"{folder}/in", [("C", text, 0.7, None, None, False, now, "m")], CONCLUSION)
        run()
    row = store.read("Conclusion").first()
    assert (row["version"], row["text"], row["updated_at"]) == (2, "b", "t3")
    assert [(r["version"], r["text"]) for r in store.read("ConclusionVersion").collect()] == [(1, "a")]


def test_audit_stream(spark, folder):
    land(spark, f"{folder}/in", [("t1", "u", None)], "ts string, user string, q string")
    work_off(jobs.audit_log(jobs.arriving(spark, f"{folder}/in", "ts string, user string, q string"), f"{folder}/log", f"{folder}/cp"))
    assert [r["record"] for r in audit.tail(spark, f"{folder}/log").collect()] == ['{"ts":"t1","user":"u"}']


def test_command_line(spark, folder, capsys):
    with open(f"{folder}/equipment.csv", "w") as f:
        f.write("id,type,lab\nE1,печь,L\n")
    run = lambda *args: cli.main(["--store", f"{folder}/store", *args], spark)
    assert run("ping") == 0 and run("schema") == 0
    assert run("load", "equipment", f"{folder}/equipment.csv") == 0
    assert run("load-all", folder) == 0
    assert run("embed") == 0 and run("extract") == 0
    assert run("search", "печь") == 0
    assert run("stats") == 0 and "Equipment: 1" in capsys.readouterr().out
    assert run("wipe") == 1 and run("wipe", "--yes") == 0
    assert run("stats") == 0 and "Equipment" not in capsys.readouterr().out


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_versions_do_not_depend_on_the_batches(spark, store, folder, files_per_batch):
    store.write("Conclusion", spark.createDataFrame([("C", "old", 0.7, None, None, 4, "t0")],
                                                    "id string, text string, confidence double, geography string, date date, version int, updated_at string"))
    for text, now in (("a", "t1"), ("a", "t2"), ("b", "t3"), (None, "t4"), ("c", "t5")):
        land(spark, f"{folder}/in", [("C", text, 0.7, None, None, False, now, "m"), ("new", text or "-", 0.5, None, None, False, now, "m")], CONCLUSION)
    run = lambda checkpoint: work_off(jobs.versioned_conclusions(store, jobs.arriving(spark, f"{folder}/in", CONCLUSION, files_per_batch), f"{folder}/{checkpoint}"))
    run("cp")
    state = lambda: ({(r["id"], r["version"], r["text"], r["updated_at"]) for r in store.read("Conclusion").collect()},
                     {(r["conclusion_id"], r["version"], r["text"]) for r in store.read("ConclusionVersion").collect()})
    seen = state()
    assert seen[0] == {("C", 7, "c", "t5"), ("new", 4, "c", "t5")}
    assert seen[1] == {("C", 4, "old"), ("C", 5, "a"), ("C", 6, "b"), ("new", 1, "a"), ("new", 2, "b"), ("new", 3, "-")}
    run("again")  # the same batches once more
    assert state() == seen


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_the_last_arrival_of_a_chunk_wins(spark, store, folder, files_per_batch):
    for text in "abc":
        land(spark, f"{folder}/in", [("D:1", "D", 1, 1, "page", text)], CHUNK)
    work_off(jobs.chunk_upserts(store, jobs.arriving(spark, f"{folder}/in", CHUNK, files_per_batch), f"{folder}/cp"))
    assert [r["text"] for r in store.read("Chunk").collect()] == ["c"]


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_streamed_counts_add_to_stored_ones(spark, store, folder, files_per_batch):
    row = lambda chunk, at: ("D", "Material", "M:1", chunk, "page 1", 0.8, at, "m")
    store.write("MENTIONS", spark.createDataFrame([(*row("D:0", "t0"), 5), ("E", *row("E:0", "t0")[1:], 2)], MENTION + ", count long"))
    for k in (1, 2):
        land(spark, f"{folder}/in", [row(f"D:{k}", f"t{k}")], MENTION)
        work_off(jobs.mention_counts(store, jobs.arriving(spark, f"{folder}/in", MENTION, files_per_batch), f"{folder}/cp"))
    got = {r["src_id"]: (r["count"], r["source"]) for r in store.graph().edge("MENTIONS").collect()}
    assert got == {"D": (7, "D:2"), "E": (2, "E:0")}
