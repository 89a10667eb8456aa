import hashlib

from docketry.streaming.ingest import REQUEST, ingest_uploads, staged_files


def test_duplicates_across_batches(spark, tmp_path):
    cases = spark.createDataFrame([(1,)], "id long")
    orders = spark.createDataFrame([(10, 1)], "id long, case_id long")
    paths = [f"{tmp_path}/{n}" for n in ("accepted", "rejected", "audit", "checkpoint")]
    for i, rows in enumerate([[(1, 1, 10, "POD", "a.pdf", "x", "me"), (2, 1, 10, "POD", "b.pdf", "x", "me")], [(3, 1, 10, "POD", "c.pdf", "x", "me"), (4, 1, 10, "POD", "d.pdf", "y", "me")]]):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest_uploads(spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in"), cases, orders, *paths).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(paths[0]).collect()) == [1, 4]
    assert {(r.seq, r.reject_reason) for r in spark.read.parquet(paths[1]).collect()} == {(2, "duplicate file"), (3, "duplicate file")}
    assert spark.read.parquet(paths[2]).count() == 2


def test_files_that_there_were_before(spark, tmp_path):
    cases, orders = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(10, 1)], "id long, case_id long")
    documents = spark.createDataFrame([(1, "old"), (2, "x")], "case_id long, checksum string")
    spark.createDataFrame([(1, 1, 10, "POD", "a.pdf", "x", "me"), (2, 1, 10, "POD", "b.pdf", "old", "me")], REQUEST).coalesce(1).write.parquet(f"{tmp_path}/in")
    paths = [f"{tmp_path}/{n}" for n in ("accepted", "rejected", "audit", "checkpoint")]
    ingest_uploads(spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in"), cases, orders, *paths, documents=documents).awaitTermination()
    assert [r.seq for r in spark.read.parquet(paths[0]).collect()] == [1]


def test_staged_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"%PDF"), ("b.PDF", b"%PDF2"), ("c.txt", b"no")):
        (tmp_path / "in" / name).write_bytes(data)
    staged_files(spark, f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = {(r.original_filename, bytes(r.content), r.checksum, r.file_size) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(n, d, hashlib.sha256(d).hexdigest(), len(d)) for n, d in (("a.pdf", b"%PDF"), ("b.PDF", b"%PDF2"))}
