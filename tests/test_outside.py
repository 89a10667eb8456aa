"""Files of any size, and a database behind JDBC."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docketry.sources import blobs
from docketry.sources.database import Database
from docketry.sources.tables import CASES


def test_a_file_over_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "big.PDF", "wb") as f:
        f.seek(size - 4)
        f.write(b"tail")
    digest = hashlib.sha256()
    zeros = bytes(1 << 20)
    for _ in range((size - 4) // len(zeros)):
        digest.update(zeros)
    digest.update(bytes((size - 4) % len(zeros)) + b"tail")
    assert [tuple(r)[1:] for r in blobs.digests(spark, str(tmp_path)).collect()] == [(size, digest.hexdigest())]
    ranges = blobs._Reader({"path": str(tmp_path), "give": "chunks", "rangebytes": str(512 << 20)}).partitions()
    assert [r.stop - r.start for r in ranges] == [512 << 20] * 4 + [12_345]


def test_round_trip_and_small_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    data = {"a.pdf": b"", "sub/b.PDF": bytes(range(256)) * 50, "c.txt": b"no"}
    for name, content in data.items():
        (tmp_path / "in" / name).write_bytes(content)
    found = blobs.chunks(spark, str(tmp_path / "in"), chunkBytes="1000", rangeBytes="3000")
    blobs.write(found.withColumn("path", F.replace("path", F.lit("/in/"), F.lit("/out/deep/"))))
    out = tmp_path / "out" / "deep"
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()} == {k: v for k, v in data.items() if k != "c.txt"}
    assert {r.sha256 for r in blobs.digests(spark, str(out)).collect()} == {hashlib.sha256(v).hexdigest() for k, v in data.items() if k != "c.txt"}


def test_a_killed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit(f"{tmp_path}/o/"), F.col("id").cast("string"), F.lit(".pdf")).alias("path"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") == 31, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        blobs.write(rows)
    assert not [p for p in tmp_path.rglob("*.pdf")] and not [p for p in tmp_path.rglob("*.part")]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"jdbc:derby:memory:{tmp_path.name};create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")


def test_skewed_ids_in_even_ranges(spark, db):
    db.execute("CREATE TABLE t (id BIGINT, x VARCHAR(20))")
    skewed = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id")).otherwise(F.col("id") * 1_000_000_007).alias("id"), F.lit("v").alias("x"))
    skewed.write.jdbc(db.url, "t", mode="append", properties=db.options)
    df = db.read("t", parts=8)
    counts = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 4000 and len(counts) == 8 and max(counts) <= 2 * min(counts)
    assert sorted(r.id for r in df.collect()) == sorted(r.id for r in skewed.collect())
    db.execute("CREATE TABLE e (id BIGINT)")
    assert db.read("e").count() == 0
    db.execute("INSERT INTO e VALUES (NULL), (5)")
    assert db.read("e", parts=2).count() == 2


def test_a_second_write_changes_nothing(spark, db):
    db.create("cases", CASES)
    db.create("cases", CASES)
    names = CASES.replace("?", "")
    row = lambda i, name, notes: (i, f"C{i}", f"SKY-{i}", name, "HARDWARE", "OPEN", notes, None, None)
    df = spark.createDataFrame([row(i, "n", None) for i in range(50)], names)
    assert db.upsert(df, "cases") == 50 and db.upsert(df, "cases") == 0
    changed = spark.createDataFrame([row(3, "m", None), row(4, "n", "x"), row(5, "n", None), row(99, "z", None)], names)
    assert db.upsert(changed, "cases") == 3 and db.upsert(changed, "cases") == 0
    got = {r.id: (r.customer_name, r.notes) for r in db.read("cases", parts=3).collect()}
    assert len(got) == 51 and got[3] == ("m", None) and got[4] == ("n", "x") and got[99] == ("z", None)
    assert db.alive() and not Database(spark, "jdbc:derby:memory:none").alive()
    with pytest.raises(Exception, match="(?i)null"):
        db.upsert(spark.createDataFrame([(7, None)], "id long, customer_name string"), "cases")
    db.drop("cases")
