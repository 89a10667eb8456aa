"""Batches on stored tables, held against a replay in DuckDB; stops and reruns; cascades against recursive SQL."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from docketry.operators import cascade as D
from docketry.operators import commands as C
from docketry.plans.records import Records
from docketry.sources.store import Folder, StoredTable
from docketry.sources.tables import CASES, DOC_FILES, SALES_ORDERS, cases, doc_keys, sales_orders

ddl = lambda x: x.replace("?", "")
at = lambda day: F.lit(f"2026-02-{day:02d} 00:00:00").cast("timestamp_ntz")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def records(spark, tmp_path):
    cases = spark.createDataFrame([(i, f"CASE-2026-{i:04d}", f"SKY-{i}", f"name {i}", "HARDWARE", "OPEN", None, None, None) for i in range(1, 41)], ddl(CASES))
    orders = spark.createDataFrame([(100 + i, i, f"SO{i}", "2026-01", None, None) for i in range(1, 41)], ddl(SALES_ORDERS))
    r = Records(spark, str(tmp_path / "r"), parts=6)
    r.load(cases, orders, spark.createDataFrame([], ddl(DOC_FILES)))
    return r


def replay(con, records):
    """Each batch as statements of its own, in order of seq."""
    con.execute("CREATE TABLE cases (id BIGINT, case_id VARCHAR, opportunity_id VARCHAR, customer_name VARCHAR, case_type VARCHAR, status VARCHAR, notes VARCHAR)")
    con.execute("CREATE TABLE orders (id BIGINT, case_id BIGINT, so_number VARCHAR)")
    con.execute("CREATE TABLE docs (id BIGINT, case_id BIGINT, sales_order_id BIGINT, checksum VARCHAR, rotation INTEGER)")
    con.execute("INSERT INTO cases SELECT i, 'CASE-2026-' || lpad(CAST(i AS VARCHAR), 4, '0'), 'SKY-' || CAST(i AS VARCHAR), 'name ' || CAST(i AS VARCHAR), 'HARDWARE', 'OPEN', NULL FROM range(1, 41) t(i)")
    con.execute("INSERT INTO orders SELECT 100 + i, i, 'SO' || CAST(i AS VARCHAR) FROM range(1, 41) t(i)")


def test_a_sequence_equals_a_replay(spark, records):
    con = duckdb.connect()
    replay(con, records)
    new = [(1, " sky900 ", " Ann ", "SERVICES", "  "), (2, "SKY-7", "Bob", "SERVICES", None), (3, "900", "Cy", "SERVICES", None), (4, "OPP-1", "Di", "HARDWARE", "n")]
    records.create_cases(1, spark.createDataFrame(new, "seq long, opportunity_id string, customer_name string, case_type string, notes string"), 2026, at(1))
    con.execute("INSERT INTO cases VALUES (41, 'CASE-2026-0041', 'SKY-900', 'Ann', 'SERVICES', 'OPEN', NULL), (42, 'CASE-2026-0042', 'OPP-1', 'Di', 'HARDWARE', 'OPEN', 'n')")
    patches = [(1, 5, ["status"], None, None, "CLOSED", None), (2, 5, ["notes"], None, None, None, "x"), (3, 5, ["status"], None, None, "LOST", None), (4, 6, ["notes", "customer_name"], "New", None, None, None), (5, 6, ["customer_name"], None, None, None, None), (6, 99, ["notes"], None, None, None, "y")]
    judged = records.update_cases(2, spark.createDataFrame(patches, "seq long, id long, set array<string>, customer_name string, case_type string, status string, notes string"), at(2))
    assert rows(judged, "seq", "reject_reason") == [(1, None), (2, None), (3, "status"), (4, None), (5, "customer_name"), (6, "case not found")]
    con.execute("UPDATE cases SET status = 'CLOSED' WHERE id = 5; UPDATE cases SET notes = 'x' WHERE id = 5; UPDATE cases SET notes = NULL, customer_name = 'New' WHERE id = 6")
    records.create_orders(3, spark.createDataFrame([(1, 41, "N1", "2026-03"), (2, 41, "SO3", "2026-03"), (3, 41, "N1", "2026-03"), (4, 42, "N2", "2026-04")], "seq long, case_id long, so_number string, so_month string"), at(3))
    con.execute("INSERT INTO orders VALUES (141, 41, 'N1'), (142, 42, 'N2')")
    uploads = [(i, i % 42 + 1, (100 + i % 42 + 1), "POD", f"a {i}.pdf", f"sum{i % 50}", 10 * i, " ", None) for i in range(60)] + [(60, 41, 141, "POD", "z.pdf", "z", 1, "R", "me")]
    schema = "seq long, case_id long, sales_order_id long, document_type string, original_filename string, checksum string, file_size long, reference_number string, uploaded_by string"
    replies = records.upload(4, spark.createDataFrame(uploads, schema), at(4))
    seen, number = set(), 0
    known = {100 + i: i for i in range(1, 41)} | {141: 41, 142: 42}
    for seq, case, order, _, _, checksum, *_ in uploads:
        if known.get(order) == case and (case, checksum) not in seen:
            seen.add((case, checksum))
            number += 1
            con.execute("INSERT INTO docs VALUES (?, ?, ?, ?, 0)", [number, case, order, checksum])
    assert number > 50 and rows(replies, "id") == sorted([(i,) for i in range(1, number + 1)], key=repr)
    records.rotate(5, spark.createDataFrame([(1, 1, 90), (2, 1, 270), (3, 2, 90), (4, 2, 45), (5, 1, 90), (6, 999, 90)], "seq long, id long, degrees int"), at(5))
    con.execute("UPDATE docs SET rotation = 90 WHERE id IN (1, 2)")
    records.delete_documents(6, spark.createDataFrame([(1, 3, "ann"), (2, 3, "bob"), (3, 4, None)], "seq long, id long, deleted_by string"), at(6))
    con.execute("DELETE FROM docs WHERE id IN (3, 4)")
    paths = records.delete_cases(7, spark.createDataFrame([(10,), (41,)], "id long"))
    gone = con.execute("SELECT id FROM docs WHERE case_id IN (10, 41) ORDER BY 1").fetchall()
    assert rows(paths, "id") == sorted(gone, key=repr) and all(p.startswith("/data/cases/CASE-2026-") for (p,) in rows(paths, "storage_path"))
    con.execute("DELETE FROM docs WHERE case_id IN (10, 41); DELETE FROM orders WHERE case_id IN (10, 41); DELETE FROM cases WHERE id IN (10, 41)")
    for stored, sql in ((records.cases, "SELECT id, case_id, opportunity_id, customer_name, case_type, status, notes FROM cases"), (records.sales_orders, "SELECT id, case_id, so_number FROM orders"), (records.documents, "SELECT id, case_id, sales_order_id, checksum, rotation FROM docs")):
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert rows(stored.read(), *columns) == sorted(found.fetchall(), key=repr)
    trail = {(r.action, r.case_id, r.document_id, r.sales_order_id, r.actor): json.loads(r.details) for r in records.audit().where("batch <> 4").collect()}
    assert {k[0] for k in trail} == {"CASE_CREATED", "CASE_UPDATED", "SO_CREATED", "DOCUMENT_ROTATED", "DOCUMENT_DELETED"}
    assert trail["CASE_UPDATED", 6, None, None, "System"] == {"customer_name": "New", "notes": None}
    assert trail["SO_CREATED", 42, None, 142, "System"] == {"so_number": "N2", "so_month": "2026-04"}
    assert trail["DOCUMENT_DELETED", 3, None, 103, "ann"] == {"document_type": "POD", "original_filename": "a 2.pdf"}
    assert sorted((json.loads(r.details)["degrees"], json.loads(r.details)["new_rotation"]) for r in records.audit().where("batch = 5").collect()) == [(90, 90), (90, 90), (90, 90), (270, 0)]
    first = json.loads(records.audit().where("batch = 4 and document_id = 1").first().details)
    assert first == {"document_type": "POD", "original_filename": "a 0.pdf", "file_size": 0}


def files_of(path):
    return {p.name: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_only_touched_partitions_change(spark, records):
    before = {p.name: files_of(p) for p in Path(records.cases.rows).iterdir() if p.is_dir()}
    patch = spark.createDataFrame([(1, 5, ["status"], None, None, "CLOSED", None)], "seq long, id long, set array<string>, customer_name string, case_type string, status string, notes string")
    records.update_cases(1, patch, at(1))
    after = {p.name: files_of(p) for p in Path(records.cases.rows).iterdir() if p.is_dir()}
    assert [k for k in before if before[k] != after[k]] == [f"_part={records.cases.touched(1)[0]}"] and len(records.cases.touched(1)) == 1
    records.update_cases(1, patch, at(9))  # known: nothing happens
    assert {p.name: files_of(p) for p in Path(records.cases.rows).iterdir() if p.is_dir()} == after
    assert records.audit().count() == 1


@pytest.mark.parametrize("step", ["plan", "overwrite", "note"])
def test_a_batch_that_stopped_is_finished(spark, tmp_path, monkeypatch, step):
    t = StoredTable(spark, str(tmp_path / "t"), "id long, x string", "id", 8)
    t.upsert(0, spark.createDataFrame([(i, "a") for i in range(40)], "id long, x string"))
    batch = spark.createDataFrame([(3, "b"), (77, "c")], "id long, x string")
    real = Folder.write

    def stop(self, name, text):
        if (step == "plan") == ("plan" in name) and step != "overwrite":
            raise RuntimeError("lost")
        real(self, name, text)
        if step == "overwrite" and "plan" in name:
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Folder, "write", stop)
        with pytest.raises(RuntimeError):
            t.upsert(1, batch)
    assert t.upsert(1, batch) and not t.upsert(1, batch)
    assert rows(t.read(), "id", "x") == sorted([(i, "b" if i == 3 else "a") for i in range(40)] + [(77, "c")], key=repr)


def test_an_emptied_partition_goes(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), "id long, x string", "id", 4)
    t.upsert(0, spark.createDataFrame([(i, "a") for i in range(20)], "id long, x string"))
    t.remove(1, spark.range(20))
    assert t.read().count() == 0
    t.upsert(2, spark.createDataFrame([(5, "z")], "id long, x string"))
    assert rows(t.read(), "id", "x") == [(5, "z")]
    with pytest.raises(ValueError):
        t.apply(3, spark.createDataFrame([(5,)], "id long"), lambda old: spark.createDataFrame([(i, "q") for i in range(9)], "id long, x string"))


def test_cascades_equal_recursive_sql(spark):
    keys = (D.ForeignKey("folder", "parent", "folder", "CASCADE"), D.ForeignKey("leaf", "folder", "folder", "CASCADE"), D.ForeignKey("log", "leaf", "leaf", "SET NULL"))
    folders = [(i, i // 3 if i else None) for i in range(60)] + [(100, 101), (101, 100)]
    leaves, logs = [(i, (i * 7) % 60) for i in range(90)], [(i, i % 90) for i in range(150)]
    tables = {"folder": spark.createDataFrame(folders, "id long, parent long"), "leaf": spark.createDataFrame(leaves, "id long, folder long"), "log": spark.createDataFrame(logs, "id long, leaf long")}
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_v", df.toPandas())
    for start in ([2], [100, 5], [40], [12345], list(range(0, 60, 7))):
        d = D.delete(tables, {"folder": spark.createDataFrame([(i,) for i in start], "id long")}, keys)
        gone = {r[0] for r in con.execute(f"WITH RECURSIVE g AS (SELECT id FROM folder_v WHERE id IN ({','.join(map(str, start))}) UNION SELECT f.id FROM folder_v f JOIN g ON f.parent = g.id) SELECT id FROM g").fetchall()}
        assert {r.id for r in d.left["folder"].collect()} == {i for i, _ in folders} - gone
        left = {i for i, f in leaves if f not in gone}
        assert {r.id for r in d.left["leaf"].collect()} == left
        assert rows(d.left["log"], "id", "leaf") == sorted([(i, x if x in left else None) for i, x in logs], key=repr)


def test_orders_and_cases_at_once(spark, sf_dir):
    from docketry.sources.tables import audit_logs, cases, doc_files, sales_orders

    tables = {"cases": cases(spark, sf_dir), "sales_orders": sales_orders(spark, sf_dir), "documents": doc_files(spark, sf_dir), "audit_logs": audit_logs(spark, sf_dir)}
    d = D.delete(tables, {"cases": tables["cases"].where("id % 5 = 0"), "sales_orders": tables["sales_orders"].where("id % 7 = 0")})
    orders = {r.id: r.case_id for r in tables["sales_orders"].collect()}
    gone = {i for i, c in orders.items() if i % 7 == 0 or c % 5 == 0}
    assert {r.id for r in d.gone["sales_orders"].collect()} == gone
    docs = tables["documents"].collect()
    lost = {r.id for r in docs if r.case_id % 5 == 0 or r.sales_order_id in gone}
    assert {r.id for r in d.gone["documents"].collect()} == lost and rows(D.files(tables["documents"], d), "id", "storage_path") == sorted([(r.id, r.storage_path) for r in docs if r.id in lost], key=repr)
    had_case = {r.id for r in tables["cases"].collect() if r.id % 5 == 0}
    assert rows(d.left["audit_logs"], "id", "case_id", "sales_order_id") == sorted([(r.id, None if r.case_id in had_case else r.case_id, None if r.sales_order_id in gone else r.sales_order_id) for r in tables["audit_logs"].collect()], key=repr)


def test_patches_shown_one_by_one(spark):
    cases = spark.createDataFrame([(1, "A", "HARDWARE", "OPEN", None)], "id long, customer_name string, case_type string, status string, notes string")
    patches = spark.createDataFrame([(1, 1, ["status"], None, None, "CLOSED", None), (2, 1, ["notes"], None, None, None, "x"), (3, 1, ["status"], None, None, None, None)], "seq long, id long, set array<string>, customer_name string, case_type string, status string, notes string")
    assert rows(C.update_cases(cases, patches), "seq", "new_status", "new_notes") == [(1, "CLOSED", None), (2, "CLOSED", "x"), (3, None, "x")]


def test_deletions_shuffle_ids_and_not_what_they_are_made_of(spark, sf_dir):
    tables = {"cases": cases(spark, sf_dir), "sales_orders": sales_orders(spark, sf_dir), "documents": doc_keys(spark, sf_dir)}
    d = D.delete(tables, {"cases": tables["cases"].where("id % 10 = 0")})
    plan = d.left["documents"].select("id", "case_id")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "sha2" in line]
    gone = "case_id % 10 = 0"
    assert d.gone["documents"].count() == tables["documents"].where(gone).count() and d.left["documents"].where(gone).count() == 0
