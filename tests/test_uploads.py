"""The stream of uploads against a plain replay: restarts, files that come first or last, deletions, constant work per batch."""

import datetime
import hashlib
import json

import pytest

from docketry.streaming import uploads as U
from docketry.streaming.ingest import staged_files

CASES, ORDERS = [(c, f"CASE-2026-{c:04d}") for c in range(1, 6)], [(10 * c, c, f"N{c}", "2026-01") for c in range(1, 6)]


def contents(name):
    return b"%PDF" + name.split("-")[1].encode()


def request(seq, case, order, name, original="a.pdf"):
    now = datetime.datetime.now().replace(microsecond=0)
    return (seq, case, order, "POD", name, original, None, None, now)


BATCHES = [
    [request(1, 1, 10, "s1-x.pdf"), request(2, 1, 10, "s2-x.pdf"), request(3, 2, 20, "s3-x.pdf")],
    [request(4, 1, 10, "s4-x.pdf"), request(5, 9, 10, "s5-y.pdf"), request(6, 3, 10, "s6-y.pdf"), request(7, 3, None, "s7-y.pdf")],
    [request(8, 4, 40, "s8-z.pdf", "b.txt"), request(9, 4, 40, "s9-z.pdf"), request(10, 5, 50, "s10-old.pdf")],
]


def expected(before=()):
    seen, out = set(before), {}
    owner = {o: c for o, c, *_ in ORDERS}
    for seq, case, order, _, name, original, *_ in (r for b in BATCHES for r in b):
        key = (case, hashlib.sha256(contents(name)).hexdigest())
        why = None
        if not original.endswith(".pdf"):
            why = "not a PDF"
        elif case not in dict(CASES):
            why = "case not found"
        elif order is None:
            why = "sales order required"
        elif owner[order] != case:
            why = "sales order of another case"
        elif key in seen:
            why = "duplicate file"
        else:
            seen.add(key)
        out[seq] = why
    return out


@pytest.fixture
def world(spark, tmp_path):
    cases, orders = spark.createDataFrame(CASES, "id long, case_id string"), spark.createDataFrame(ORDERS, "id long, case_id long, so_number string, so_month string")
    (tmp_path / "staged").mkdir()
    spark.createDataFrame([], U.REQUEST).write.parquet(f"{tmp_path}/in")

    def run(before=None, deletions=None):
        stream = spark.readStream.schema(U.REQUEST).parquet(f"{tmp_path}/in")
        gone = None if deletions is None else spark.readStream.schema(U.DELETION).parquet(deletions)
        q = U.ingest(stream, staged_files(spark, f"{tmp_path}/staged"), cases, orders, f"{tmp_path}/out", f"{tmp_path}/check", gone, before)
        q.awaitTermination()
        return q

    def send(rows, stored=True):
        for r in rows if stored else ():
            (tmp_path / "staged" / r[4]).write_bytes(contents(r[4]))
        spark.createDataFrame(rows, U.REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def told():
        ok = {r.seq: None for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()}
        return ok | {r.seq: r.reject_reason for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()}

    return run, send, told, tmp_path


def test_restarts_change_no_verdict(spark, world):
    run, send, told, path = world
    progress = []
    old = spark.createDataFrame([(5, hashlib.sha256(contents("s10-old.pdf")).hexdigest())], "case_id long, checksum string")
    for rows in BATCHES:  # each run starts anew from the checkpoint
        send(rows)
        progress.append(run(old).lastProgress)
    got = told()
    assert got == expected({(5, hashlib.sha256(contents("s10-old.pdf")).hexdigest())})
    assert got[2] == got[4] == got[10] == "duplicate file" and got[3] is None and got[9] is None
    rows = spark.read.parquet(f"{path}/out/documents").collect()
    assert len({r.id for r in rows}) == len(rows) and all(r.storage_path.startswith(f"/data/cases/CASE-2026-{r.case_id:04d}/2026-01/SO-N{r.case_id}/POD/") for r in rows)
    trail = {r.document_id: json.loads(r.details) for r in spark.read.parquet(f"{path}/out/audit").collect()}
    assert trail == {r.id: {"document_type": "POD", "original_filename": "a.pdf", "file_size": r.file_size} for r in rows}


def test_a_file_may_come_later_and_a_deleted_one_again(spark, world):
    run, send, told, path = world
    spark.createDataFrame([], U.DELETION).write.parquet(f"{path}/gone")
    send([request(1, 1, 10, "s1-x.pdf")], stored=False)
    send([request(2, 2, 20, "s2-q.pdf")])
    run(deletions=f"{path}/gone")
    assert told() == {2: None}
    (path / "staged" / "s1-x.pdf").write_bytes(contents("s1-x.pdf"))
    run(deletions=f"{path}/gone")
    assert told() == {1: None, 2: None}
    gone = (3, 1, hashlib.sha256(contents("s1-x.pdf")).hexdigest(), datetime.datetime.now())
    spark.createDataFrame([gone], U.DELETION).coalesce(1).write.mode("append").parquet(f"{path}/gone")
    send([request(4, 1, 10, "s4-x.pdf"), request(5, 1, 10, "s5-x.pdf")])
    run(deletions=f"{path}/gone")
    assert told() == {1: None, 2: None, 4: None, 5: "duplicate file"}


def test_the_work_of_a_batch_does_not_grow(spark, world):
    run, send, _, path = world
    read, updated = [], []
    for i in range(4):
        send([request(10 * i + k, 1 + k, 10 + 10 * k, f"s{i}{k}-c{i}.pdf") for k in range(5)])
        done = [p for p in run().recentProgress if p["numInputRows"]]
        read.append(sum(p["numInputRows"] for p in done))
        updated.append(sum(op["numRowsUpdated"] for p in done for op in p["stateOperators"] if op["operatorName"].startswith("transformWithState")))
    assert len(set(read)) == 1 and len(set(updated)) == 1
    assert spark.read.parquet(f"{path}/out/documents").count() == 20
