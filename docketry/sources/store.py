"""Tables kept in a shared folder: partitions by a hash of the key, changed in numbered batches that touch few of them."""

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one only for a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, what: str) -> DataFrame:
    """The same rows out of Parquet in the shared folder: worked out once, as few bytes as their columns have."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Folder:
    """Small files and folders of whatever file system a path is on, through Spark's own Hadoop client."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.exists(name) else []

    def write(self, name: str, text: str) -> None:
        """Under another name first, so that a file that is there is whole."""
        passing = self._at(f"{name}.{uuid.uuid4().hex}")
        out = self.fs.create(passing, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(passing, self._at(name)):
            self.fs.delete(passing, False)
            if not self.exists(name):
                raise OSError(f"{self.path}/{name} could not be written")

    def read(self, name: str) -> str:
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return rows[0].value if rows else ""

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)


class StoredTable:
    """Rows in `parts` folders by a hash of their key. A batch replaces the folders that its keys fall into, and no other.

    A batch is worked out into a folder of its own, which is complete or is not there; then its partitions overwrite those of the
    table; then its number is noted. A batch that stopped on the way is finished when it is run again, from what it had worked
    out, and one that is noted is passed over. One writer at a time.
    """

    PART = "_part"

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, parts: int = 64):
        self.spark, self.folder, self.schema, self.key, self.parts = spark, Folder(spark, path), schema, key, parts
        self.rows = f"{self.folder.path}/rows"

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.parts)).cast("int")

    def _stored(self) -> DataFrame:
        if not self.folder.exists("rows"):
            return self.spark.createDataFrame([], f"{self.schema}, {self.PART} int")
        return self.spark.read.schema(f"{self.schema}, {self.PART} int").parquet(self.rows)

    def read(self) -> DataFrame:
        return self._stored().drop(self.PART)

    def of(self, parts: list[int]) -> DataFrame:
        """The rows of some partitions; the folders of others are not listed in the scan."""
        return self._stored().where(F.col(self.PART).isin(parts)).drop(self.PART)

    def applied(self, number: int) -> bool:
        return self.folder.exists(f"batches/{number}.json")

    def apply(self, number: int, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Replace the partitions of `keys` (a column named as the key) by change(their rows); whether the batch was new.

        change gives all rows that those partitions have from now on, and may only move keys that it is given.
        """
        if self.applied(number):
            return False
        staged = f"staged/{number}"
        if not self.folder.exists(f"{staged}/plan.json"):
            self.folder.delete(staged)
            touched = sorted(r[0] for r in keys.select(self.part(F.col(self.key))).distinct().collect())  # `parts` numbers at most
            new = change(self.of(touched)).select(*self._names(), self.part(F.col(self.key)).alias(self.PART))
            new.repartition(self.PART).write.partitionBy(self.PART).parquet(f"{self.folder.path}/{staged}/rows")
            filled = [int(n.split("=")[1]) for n in self.folder.names(f"{staged}/rows") if n.startswith(f"{self.PART}=")]
            if strays := sorted(set(filled) - set(touched)):
                raise ValueError(f"batch {number} has rows of partitions {strays} that none of its keys is in")
            self.folder.write(f"{staged}/plan.json", json.dumps({"touched": touched, "filled": filled}))
        plan = json.loads(self.folder.read(f"{staged}/plan.json"))
        if plan["filled"]:
            new = self.spark.read.schema(f"{self.schema}, {self.PART} int").parquet(f"{self.folder.path}/{staged}/rows")
            new.repartition(self.PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.PART).parquet(self.rows)
        for emptied in set(plan["touched"]) - set(plan["filled"]):
            self.folder.delete(f"rows/{self.PART}={emptied}")
        self.spark.catalog.refreshByPath(self.rows)
        self.folder.write(f"batches/{number}.json", json.dumps(plan))
        self.folder.delete(staged)
        return True

    def touched(self, number: int) -> list[int]:
        return json.loads(self.folder.read(f"batches/{number}.json"))["touched"]

    def _names(self) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.schema.split(",")]

    def upsert(self, number: int, rows: DataFrame) -> bool:
        """Insert rows, replacing those of equal keys."""
        kept = rows.select(*self._names())
        return self.apply(number, kept.select(self.key), lambda old: old.join(kept.select(self.key), self.key, "left_anti").select(*self._names()).unionByName(kept))

    def remove(self, number: int, keys: DataFrame) -> bool:
        return self.apply(number, keys.select(self.key), lambda old: old.join(keys.select(self.key), self.key, "left_anti"))
