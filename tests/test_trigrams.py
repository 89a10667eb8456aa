"""The index against scans: results, rows read, rows added and removed."""

import pytest
from pyspark.sql import functions as F

from docketry.operators.lookups import search
from docketry.operators.trigrams import TrigramIndex, pieces_in


def rows_read(df):
    """Rows that the scans of a query gave, after files and pages were pruned."""
    df.collect()
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            seen += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return seen


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """60,000 rows that look alike, in files sorted by key."""
    n = F.col("id")
    names = F.when(n % 7 == 0, F.concat(F.lit("Ünïcode % "), F.hex(n))).when(n % 11 == 0, None).otherwise(F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0")))
    df = spark.range(60_000).select(n.alias("row"), F.concat(F.lit("10TM"), F.lpad((n * 7919 % 1_000_003).cast("string"), 10, "0")).alias("number"), names.alias("name"))
    path = str(tmp_path_factory.mktemp("t"))
    df.repartitionByRange(4, "number").sortWithinPartitions("number").write.option("parquet.page.row.count.limit", 50).parquet(f"{path}/table")
    index = TrigramIndex(spark, f"{path}/index", "number", ("number", "name"), page_rows=100)
    index.add(0, spark.read.parquet(f"{path}/table"))
    return spark.read.parquet(f"{path}/table"), index


@pytest.mark.parametrize("query", ["0123", "#0000123", "nïcode", "tm%555%1", "zzz", "ab", "", "\\", "0000"])
def test_search_equals_a_scan(stored, query):
    table, index = stored
    want = search(table, ("number", "name"), query, "number").collect()
    assert index.search(table, query, 20).collect() == want
    assert sorted(index.matching(table, query, ("name",)).collect(), key=repr) == sorted(table.where(F.col("name").ilike(f"%{query}%".replace("\\", "\\\\"))).collect(), key=repr)


def test_few_rows_are_read(stored):
    table, index = stored
    total = table.count()
    for query in ("98765", "4321", "#00001234"):
        pieces = [p for _, p in index.rarest("number", query)]
        assert index.rarest("number", query)[0][0] < 0.02 * total
        read = rows_read(index.candidates("number", query, pieces)) if index.rarest("number", query)[0][0] else 0
        read += rows_read(index.search(table, query, 20, ("number",)))
        assert read < 0.05 * total


def test_added_and_removed_rows(spark, stored, tmp_path):
    table, _ = stored
    index = TrigramIndex(spark, str(tmp_path / "i"), "number", ("number", "name"))
    few = table.where("row < 2000")
    index.add(0, few)
    added = spark.createDataFrame([(100_000, "NEW-777", "Zebra Ltd"), (100_001, "NEW-778", "zebra gmbh")], "row long, number string, name string")
    assert index.search(few, "zebra", 20).count() == 0
    index.add(1, added)
    index.add(1, added)  # again: replaces itself
    both = few.unionByName(added)
    assert [r.number for r in index.search(both, "ZEBRA", 20).collect()] == ["NEW-777", "NEW-778"]
    index.remove(2, added.where("row = 100000"))
    assert [r.number for r in index.search(both, "zebra", 20).collect()] == ["NEW-778"]
    index.add(2, spark.createDataFrame([(100_000, "NEW-777", "Yak")], "row long, number string, name string"))
    assert [r.number for r in index.keys("yak", ("name",)).select(F.col("key").alias("number")).collect()] == ["NEW-777"]
    assert index.keys("zebra", ("name",)).count() == 1


def test_tasks_sort_a_bounded_number_and_searches_group_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("docketry.operators.trigrams.TASK_POSTINGS", 1000)
    rows = spark.range(2000).select(F.format_string("10TM%06d", "id").alias("number"))
    index = TrigramIndex(spark, str(tmp_path / "i"), "number", ("number",))
    index.add(0, rows)
    written = spark.read.parquet(f"{tmp_path}/i/added/batch=0/postings").groupBy(F.input_file_name()).count()
    assert max(r["count"] for r in written.collect()) < 2500
    found = index.keys("tm%0012")
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString() and {r.key for r in found.collect()} == {r.number for r in search(rows, ("number",), "tm%0012", "number", 2000).collect()}


def test_pieces():
    assert pieces_in("Ab%cdEf_gh") == ["cde", "def"] and pieces_in("ab") == [] and pieces_in("aaaa") == ["aaa"]
