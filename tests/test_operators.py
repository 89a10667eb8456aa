"""Edge cases of lookups, aggregates, checklists, pages, commands and files."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import aggregates as A
from docketry.operators import checklist as K
from docketry.operators import commands as C
from docketry.operators import lookups as L
from docketry.operators import paging as P
from docketry.sources import files

CASE = "id long, case_id string, opportunity_id string, customer_name string, case_type string, status string, notes string"


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(0, "CASE-2026-9999", "SKY-1", "A", "HARDWARE", "OPEN", None), (1, "CASE-2026-10000", "SKY-2", "100% b_c", "SERVICES", None, "n"), (2, "CASE-2026-x", "OPP\\2", "C", "SERVICES", "CLOSED", None)]
    return spark.createDataFrame(rows, CASE)


def test_next_case_id(spark, cases):
    assert A.next_case_id(cases, 2026).first().case_id == "CASE-2026-10001"
    assert A.next_case_id(cases, 2027).first().case_id == "CASE-2027-0001"


def test_status_counts_leave_null_out(cases):
    r = A.case_status(cases).first()
    assert (r.total, r.open_cases, r.in_progress_cases, r.closed_cases) == (3, 1, 0, 1)


def test_search_wildcards_and_backslash(cases):
    ids = lambda q: [r.id for r in L.search(cases, ("customer_name", "opportunity_id"), q, "id").collect()]
    assert ids("b_c") == [1] and ids("B%C") == [1] and ids("\\2") == [2] and ids("\\") == [2] and ids("zz") == []


def test_audit_filters_skip_zero_and_empty(spark):
    logs = spark.createDataFrame([(1, 0, "A", "user_1"), (2, 5, "B", "USER_12")], "id long, case_id long, action string, actor string")
    assert L.audit_filtered(logs, 0, "", None).count() == 2
    assert [r.id for r in L.audit_filtered(logs, actor="user_12").collect()] == [2]


def test_month_filter_lets_customer_orders_through(spark):
    docs = spark.createDataFrame([(1, 10, "POD", "a", None), (1, None, "CUSTOMER_PO", "b", None), (1, 11, "POD", "c", None)], "case_id long, sales_order_id long, document_type string, checksum string, uploaded_at timestamp_ntz")
    orders = spark.createDataFrame([(10, 1, "2026-01"), (11, 1, "2026-02")], "id long, case_id long, so_month string")
    assert [r.checksum for r in L.documents_of_case(docs, orders, 1, month="2026-01").collect()] == ["a", "b"]
    assert L.documents_of_case(docs, orders, 1, sales_order_id=11, kind="POD").count() == 1


def test_checklist_of_an_empty_order(spark):
    orders = spark.createDataFrame([(1, "n")], "id long, so_number string")
    docs = spark.createDataFrame([], "sales_order_id long, document_type string, checksum string")
    r = K.with_checklist(orders, docs).first()
    assert r.document_count == 0 and r.has_pod is False


def test_nested_case_detail(spark, sf_dir):
    from docketry.sources.tables import cases, doc_files, sales_orders

    orders = sales_orders(spark, sf_dir)
    nested = K.nested(K.case_detail(cases(spark, sf_dir), orders, doc_files(spark, sf_dir)))
    assert nested.count() == 150
    assert nested.select(F.sum(F.size("sales_orders"))).first()[0] == orders.count()


def test_pages(spark):
    logs = spark.range(10).withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    assert [r.id for r in P.audit_page(logs, 3, 2).collect()] == [7, 6, 5]
    with pytest.raises(ValueError):
        P.audit_page(logs, 201)
    with pytest.raises(ValueError):
        P.audit_page(logs, 10, -1)
    w = P.page_window(logs, 5, 8).first()
    assert (w.first, w.last, w.has_previous, w.has_next) == (9, 10, True, False)


def test_create_cases_within_a_batch(spark, cases):
    batch = spark.createDataFrame([(1, "7", "N", "HARDWARE"), (2, "sky-7", "N", "HARDWARE"), (3, "SKY-1", "N", "HARDWARE"), (4, "8", "", "HARDWARE"), (5, "1" * 20, "N", "HARDWARE"), (6, "9", "N", None), (7, "10", "N", "SERVICES")], "seq long, opportunity_id string, customer_name string, case_type string")
    got = {r.seq: (r.reject_reason, r.case_id) for r in C.create_cases(cases, batch, 2026).collect()}
    assert got == {1: (None, "CASE-2026-10001"), 2: ("opportunity exists", None), 3: ("opportunity exists", None), 4: ("customer_name", None), 5: ("opportunity_id", None), 6: ("case_type", None), 7: (None, "CASE-2026-10002")}


def test_upload_reasons_in_order(spark, cases):
    orders = spark.createDataFrame([(5, 0), (6, 1)], "id long, case_id long")
    docs = spark.createDataFrame([(0, "old")], "case_id long, checksum string")
    batch = spark.createDataFrame(
        [(1, 9, None, "a.pdf", "x"), (2, 0, None, "a.pdf", "x"), (3, 0, 99, "a.pdf", "x"), (4, 0, 6, "a.pdf", "x"), (5, 0, 5, "a.PDF", "old"), (6, 0, 5, "a.pdf", "x"), (7, 0, 5, "a.pdf", "x"), (8, 0, 5, "a.txt", "y")],
        "seq long, case_id long, sales_order_id long, original_filename string, checksum string",
    )
    got = {r.seq: r.reject_reason for r in C.upload_documents(cases, orders, docs, batch).collect()}
    assert got == {1: "case not found", 2: "sales order required", 3: "sales order not found", 4: "sales order of another case", 5: "duplicate file", 6: None, 7: "duplicate file", 8: "not a PDF"}


def test_explicit_null_is_a_value(spark, cases):
    batch = spark.createDataFrame([(0, ["status"], None, None, None, None), (1, ["customer_name"], None, None, None, None), (2, ["notes"], "ignored", None, None, "new")], "id long, set array<string>, customer_name string, case_type string, status string, notes string")
    got = {r.id: r for r in C.update_cases(cases, batch).collect()}
    assert got[0].reject_reason is None and got[0].new_status is None
    assert got[1].reject_reason == "customer_name" and got[1].new_customer_name == "100% b_c"
    assert (got[2].new_notes, got[2].new_customer_name) == ("new", "C")


def test_rotate_adds_up(spark):
    docs = spark.createDataFrame([("a", 270), ("b", None)], "checksum string, rotation int")
    batch = spark.createDataFrame([("a", 90), ("a", 90), ("b", 45)], "checksum string, degrees int")
    assert {r.checksum: r.rotation for r in C.rotate(docs, batch).collect()} == {"a": 90, "b": None}


def test_files_round_trip(spark, tmp_path):
    base = f"{tmp_path}/CASE-2026-0001/2026-01/SO-10/POD"
    docs = spark.createDataFrame([(f"{base}/x_a.pdf", "a.pdf", bytearray(b"%PDF")), (f"{base}/x_b.PDF", "b.PDF", bytearray(b"%PDF2"))], "storage_path string, original_filename string, content binary")
    files.write(docs)
    found = files.located(files.scan(spark, str(tmp_path)))
    assert {(r.case_id, r.so_month, r.so_number, r.document_type, r.length) for r in found.collect()} == {("CASE-2026-0001", "2026-01", "10", "POD", 4), ("CASE-2026-0001", "2026-01", "10", "POD", 5)}
    assert files.content(docs.drop("content"), files.scan(spark, str(tmp_path))).count() == 2
    known = docs.drop("content").withColumns({"id": F.length("original_filename").cast("long") + F.when(F.col("original_filename") == "b.PDF", 1).otherwise(0), "rotation": F.lit(90)})
    one = files.content_of(known, files.scan(spark, str(tmp_path)), 6).first()
    assert (bytes(one.content), one.rotation_header, one.inline) == (b"%PDF2", "90", 'inline; filename="b.PDF"')
    lost = known.withColumn("storage_path", F.lit("/no/such/file.pdf"))
    with pytest.raises(Exception, match="file not found"):
        files.content(lost, files.scan(spark, str(tmp_path))).collect()
    assert [r.content for r in files.content(lost, files.scan(spark, str(tmp_path)), strict=False).collect()] == [None, None]
    assert files.delete(docs.limit(1)) == 1 and files.delete(docs.limit(1).withColumn("storage_path", F.lit("/no/such/file.pdf"))) == 0
    assert sorted(r.length for r in files.present(docs, files.scan(spark, str(tmp_path))).collect())[0] == 0


def test_numbering_goes_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 5003).alias("seq")).repartition(7)
    got = {r.seq: r.nth for r in C.numbered(rows, "seq").collect()}
    assert [got[s] for s in sorted(got)] == list(range(1, 5001))


def test_repeats_of_one_key_and_of_null_keys(spark):
    batch = spark.createDataFrame([(i, "same" if i % 2 else None, None if i < 6 else "bad") for i in range(8)], "seq long, key string, reject_reason string")
    got = {r.seq: r.reject_reason for r in C._without_repeats(batch, "again", "key").collect()}
    assert got == {0: None, 1: None, 2: "again", 3: "again", 4: "again", 5: "again", 6: "bad", 7: "bad"}


def test_odd_turns_have_a_reason(spark):
    batch = spark.createDataFrame([(1, 90), (2, 45), (3, None)], "seq long, degrees int")
    assert {r.seq: r.reject_reason for r in C.judged_turns(batch).collect()} == {1: None, 2: "rotation", 3: "rotation"}


def test_shortest_queries(cases):
    assert L.long_enough(cases, "s", L.LEAST_CASE_QUERY).count() == 0 and L.long_enough(cases, "sk", L.LEAST_CASE_QUERY).count() == 3
    assert L.long_enough(cases, "10", L.LEAST_ORDER_QUERY).count() == 0


def test_schemas_are_those_of_the_tables(spark, sf_dir):
    from docketry.sources import tables as T

    for columns, table in ((T.CASES, T.cases), (T.SALES_ORDERS, T.sales_orders), (T.DOC_FILES, T.doc_files), (T.AUDIT_LOGS, T.audit_logs)):
        declared = T.schema(columns)
        assert [(f.name, f.dataType) for f in table(spark, sf_dir).schema] == [(f.name, f.dataType) for f in declared]
        assert spark.createDataFrame([], declared).count() == 0


def test_jdbc_reads_by_ranges(spark, tmp_path):
    """The database that comes with Spark, in memory."""
    url = "jdbc:derby:memory:cases;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).selectExpr("id as ID", "cast(id * 2 as int) as CASE_ID")
    rows.write.format("jdbc").options(url=url, dbtable="SALES_ORDERS", **driver).mode("overwrite").save()
    got = files.jdbc(spark, url, "SALES_ORDERS", "ID", (0, 100), 4, fetchsize="10", **driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in got.collect()) == [(i, 2 * i) for i in range(100)]
    one = got.where("ID = 42")
    assert [tuple(r) for r in one.collect()] == [(42, 84)] and "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,42)]" in one._jdf.queryExecution().toString()


def test_queries_that_are_too_short_find_nothing(spark, cases):
    orders = spark.createDataFrame([(1, "SO12")], "id long, so_number string")
    ids = lambda q, kind: [r.id for r in L.asked_search(cases, orders, q, kind).collect()]
    assert ids(" y-1 ", "opportunity") == [0] and ids(" 1 ", "opportunity") == [] and ids("o12", "sales_order") == [1] and ids("12 ", "sales_order") == []


def test_uploads_are_judged_once_over_narrow_rows(spark, cases):
    """The verdicts are kept: what follows reads them, and neither the tables nor checksums are joined again."""
    orders = spark.createDataFrame([(7, 1)], "id long, case_id long")
    docs = spark.createDataFrame([(1, 1, "old"), (2, 1, None)], "id long, case_id long, checksum string")
    rows = [(1, 1, 7, "a.pdf", "old"), (2, 1, 7, "a.pdf", "new"), (3, 1, 7, "a.PDF", "new"), (4, 1, 7, "a.txt", "new"), (5, 1, 7, "a.pdf", None), (6, 1, 7, "a.pdf", None), (7, 9, 7, "a.pdf", "x")]
    judged = C.upload_documents(cases, orders, docs, spark.createDataFrame(rows, "seq long, case_id long, sales_order_id long, original_filename string, checksum string"))
    assert {r.seq: r.reject_reason for r in judged.collect()} == {1: "duplicate file", 2: None, 3: "duplicate file", 4: "not a PDF", 5: None, 6: "duplicate file", 7: "case not found"}
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_files_of_a_case_keep_their_columns(spark, sf_dir):
    """Files are packed for the shuffle; paths that don't end with the filename, and nulls, come back as they were."""
    from docketry.operators import nested as N
    from docketry.sources.tables import cases, doc_files, sales_orders

    files = doc_files(spark, sf_dir).limit(300).withColumns({
        "storage_path": F.when(F.col("id") % 4 == 0, "elsewhere.pdf").when(F.col("id") % 4 == 1, None).otherwise(F.col("storage_path")), "filename": F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, None).otherwise(F.col("filename")),
    }).cache()
    cases_of, orders = cases(spark, sf_dir), sales_orders(spark, sf_dir)
    assert not {"storage_path", "case_id", "sales_order_id"} & set(files.select(N._packed().alias("f")).select("f.*").columns)
    nested = N.case_documents(cases_of, orders, files).select(F.explode("sales_orders").alias("o")).select(F.explode("o.documents").alias("f")).select("f.*")
    want = files.where("sales_order_id is not null").select(*N._shown(N.FILE))
    assert sorted(map(tuple, nested.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
