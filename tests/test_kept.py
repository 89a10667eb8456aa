"""Statistics from deltas, pages far down, lookups in clustered files."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import aggregates as A
from docketry.operators.deltas import Statistics
from docketry.operators.paging import PagedLog, audit_page
from docketry.plans.catalog import queries
from docketry.sources import clustered
from docketry.sources.tables import audit_logs, cases, doc_files, doc_keys, doc_lines, documents_of, order_files, sales_orders
from tests.test_trigrams import rows_read

LOG = "id long, case_id long, action string, created_at timestamp_ntz"


def stage_bytes(spark):
    """Bytes that every stage so far shuffled, spilled and wrote, by its number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    done = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    done = [done.apply(i) for i in range(done.size())]
    return {s.stageId(): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in done}


def test_deltas_equal_the_whole(spark, sf_dir, tmp_path):
    """Twenty batches of uploads, deletions and status changes."""
    stats = Statistics(spark, str(tmp_path / "s"))
    all_cases, orders, docs = cases(spark, sf_dir).persist(), sales_orders(spark, sf_dir).persist(), doc_files(spark, sf_dir).persist()
    there = docs.where("id % 20 = 0")
    stats.add(0, {"cases": all_cases, "sales_orders": orders, "documents": there})
    for b in range(1, 20):
        new = docs.where(f"id % 20 = {b}")
        stats.add(b, {"documents": new}, {"documents": docs.where(f"id % 20 = {b - 1} and rotation = 90")} if b % 3 == 0 else None)
        if b == 10:
            stats.compact(10)
    stats.add(20, {"cases": all_cases.where("id % 4 = 0").withColumn("status", F.lit("CLOSED"))}, {"cases": all_cases.where("id % 4 = 0")})
    stats.add(20, {"cases": all_cases.where("id % 4 = 0").withColumn("status", F.lit("CLOSED"))}, {"cases": all_cases.where("id % 4 = 0")})  # again
    left = docs.where("not (id % 20 in (2, 5, 8, 11, 14, 17) and rotation = 90)").persist()
    now = all_cases.withColumn("status", F.when(F.col("id") % 4 == 0, "CLOSED").otherwise(F.col("status")))
    want = A.overview(now, orders, left, "1998-09-01")
    got = stats.overview("1998-09-01")
    assert got.columns == want.columns and got.collect() == want.collect()
    stats.forget()
    assert stats.overview("1998-09-01").collect() == want.collect()
    assert stats.overview("1998-09-01 12:30:00", documents=left).collect() == A.overview(now, orders, left, "1998-09-01 12:30:00").collect()
    assert {(r.part, r.n) for r in stats.by_part("documents", "document_type").collect()} == {(r.document_type, r.n) for r in A.by_type(left).collect()}
    assert {r.part for r in stats.by_part("sales_orders", "so_month").collect()} == {r.so_month for r in A.months(orders).collect()}
    assert Statistics(spark, str(tmp_path / "none")).overview("2026-01-01").first().total == 0


@pytest.mark.parametrize("late", [False, True])
def test_pages_far_down(spark, tmp_path, late):
    rng = random.Random(4)
    day = lambda i: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=i // 50 * 50)  # noqa: E731  ties of 50
    rows = [(i, i % 9, "A", day(i) if i % 401 else None) for i in range(20_000)]
    first, second = rows[:16_000], rows[16_000:]
    if late:
        rng.shuffle(rows)
        first, second = rows[:16_000], rows[16_000:]
    log = PagedLog(spark, str(tmp_path / "p"), range_rows=1000)
    log.add(0, spark.createDataFrame(first, LOG))
    log.add(1, spark.createDataFrame(second, LOG))
    log.add(1, spark.createDataFrame(second, LOG))  # again: replaces itself
    ordered = sorted(rows, key=lambda r: (r[3] is None, r[3] or datetime.datetime.min, r[0]), reverse=True)
    assert log.total() == 20_000
    for offset in (0, 18_000, 19_970, 15_999, 25_000):
        page = log.page(50, offset)
        assert [tuple(r) for r in page.collect()] == ordered[offset : offset + 50]
        if not late and offset == 18_000:
            assert 0 < rows_read(page) <= 2500  # of 20,000: its range
    with pytest.raises(ValueError):
        log.page(201)


def test_page_equals_a_sort(spark, sf_dir, tmp_path):
    logs = audit_logs(spark, sf_dir).where("created_at is not null")
    log = PagedLog(spark, str(tmp_path / "p"), range_rows=100)
    log.add(0, logs)
    n = logs.count()
    assert log.page(20, int(0.9 * n)).collect() == audit_page(logs, 20, int(0.9 * n)).collect()


def test_lookups_skip_files(spark, tmp_path):
    n = F.col("id")
    df = spark.range(40_000).select((n * 7919 % 1_000_003).alias("id"), F.format_string("CASE-2026-%05d", n).alias("case_id"), F.repeat(F.lit("x"), 50).alias("notes"))
    path = str(tmp_path / "c")
    clustered.write(df, path, "case_id", ("id",), files=16)
    found = clustered.find(spark, path, "case_id", "CASE-2026-00042")
    assert "EqualTo(case_id,CASE-2026-00042)" in found._jdf.queryExecution().toString()
    assert [r.id for r in found.collect()] == [42 * 7919 % 1_000_003] and rows_read(found) <= 40_000 / 10
    by_id = clustered.find_many(spark, path, "id", [42 * 7919 % 1_000_003, 30_000 * 7919 % 1_000_003])
    assert {r.case_id for r in by_id.collect()} == {"CASE-2026-00042", "CASE-2026-30000"} and rows_read(by_id) <= 2 * 40_000 / 10
    assert clustered.find(spark, path, "id", -1).count() == 0


def test_rows_without_a_key_fill_many_files(spark, tmp_path):
    path = str(tmp_path / "c")
    clustered.write(spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("order")), path, "order", ("id",), files=8)
    rows = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 5000
    assert [r.id for r in clustered.find(spark, path, "order", 42).collect()] == [42]


def test_documents_by_order_are_whole(spark, sf_dir, tmp_path):
    path, every = str(tmp_path / "c"), doc_files(spark, sf_dir)
    clustered.write(doc_lines(spark, sf_dir), path, "sales_order_id", ("id",), files=4, made=documents_of)
    stored = spark.read.parquet(path)
    assert [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in every.schema]
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, every.collect()), key=repr)
    place = [(r.sales_order_id is not None, r.sales_order_id or 0, r.id) for f in sorted(stored.inputFiles()) for r in spark.read.parquet(f).collect()]
    assert place == sorted(place) and len(stored.inputFiles()) == 4


def test_documents_by_order_move_few_bytes(spark, sf_dir):
    """Shuffled, spilled and written for a document: 138 bytes here, 276 when whole rows were dealt out and written as Snappy."""
    before = stage_bytes(spark)
    found = queries()["lookup_docs_of_orders"](spark, sf_dir)
    moved = sum(b for stage, b in stage_bytes(spark).items() if stage not in before)
    assert 0 < moved < 200 * doc_files(spark, sf_dir).count()
    assert found.count() == doc_files(spark, sf_dir).where("sales_order_id in (1, 77, 1234)").count() > 0


def test_narrow_documents_are_the_documents(spark, sf_dir):
    every = doc_files(spark, sf_dir)
    some = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert some(doc_keys(spark, sf_dir)) == some(every.select("id", "case_id", "sales_order_id"))
    assert some(order_files(spark, sf_dir)) == some(every.where("sales_order_id is not null").select(*order_files(spark, sf_dir).columns))
    plan = doc_keys(spark, sf_dir).hint("merge")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sha2")  # below the join
