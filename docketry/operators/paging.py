"""Pages of the audit trail."""

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docketry.sources.store import Folder

DEFAULT_LIMIT, MOST = 50, 200


def audit_page(logs: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Newest first, the larger id first among equals: a top-k, not a sort of the table."""
    if not 0 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit must be 0..{MOST} and offset not negative")
    return logs.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def page_window(logs: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """What a page shows of the whole: first and last row, total, and whether there are pages before and after."""
    total = logs.agg(F.count("*").alias("total"))
    last = F.least(F.lit(offset + limit).cast("long"), F.col("total"))
    return total.select("total", F.lit(offset + 1).cast("long").alias("first"), last.alias("last"), F.lit(offset > 0).alias("has_previous"), (F.lit(offset + limit) < F.col("total")).alias("has_next"))


def envelope(logs: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One row: total, limit, offset, and the page's rows as an array of structs in its order. A page has MOST rows at most."""
    order = F.struct(F.col("created_at"), F.col("id"))
    page = audit_page(logs, limit, offset).agg(F.sort_array(F.collect_list(F.struct(order.alias("order"), F.struct("*").alias("log"))), asc=False)["log"].alias("logs"))
    return logs.agg(F.count("*").alias("total")).crossJoin(page).select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), "logs")


class PagedLog:
    """The trail in ranges of its order with a count for each, so that a page far down is read from its own range.

    A batch of rows is dealt into ranges by Spark's sketch of their keys, sorted, and written a folder to a range. For each
    range its first and last key and its rows are noted. Ranges of different batches that overlap are read together.
    """

    ORDER = ("created_at", "id")

    def __init__(self, spark: SparkSession, path: str, range_rows: int = 100_000):
        self.spark, self.folder, self.range_rows = spark, Folder(spark, path), range_rows

    def add(self, batch: int, logs: DataFrame) -> None:
        """Rows of a batch, which replace what it had before."""
        ranges = max(1, -(-logs.count() // self.range_rows))
        keys = [F.desc_nulls_first("created_at"), F.desc("id")]
        dealt = logs.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("range").parquet(f"{self.folder.path}/rows/batch={batch}")
        key = F.struct(F.col("created_at").isNull().alias("undated"), *self.ORDER)  # nulls first, as in the order of pages
        noted = self.spark.read.schema(f"{_ddl(logs)}, range int").parquet(f"{self.folder.path}/rows/batch={batch}").groupBy("range").agg(F.count("*").alias("n"), F.min(key).alias("last"), F.max(key).alias("first"))
        noted.coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/ranges/batch={batch}")

    def _groups(self) -> list[dict]:
        """Ranges in the order of pages, overlapping ones as one: some 16 numbers for each range_rows rows."""
        if not self.folder.exists("ranges"):
            return []
        found = self.spark.read.parquet(f"{self.folder.path}/ranges").collect()
        groups: list[dict] = []
        for r in sorted(found, key=lambda r: _place(r.first), reverse=True):
            if groups and _place(r.first) >= groups[-1]["last"]:
                groups[-1]["ranges"].append((r.batch, r.range))
                groups[-1]["n"] += r.n
                groups[-1]["last"] = min(groups[-1]["last"], _place(r.last))
            else:
                groups.append({"ranges": [(r.batch, r.range)], "n": r.n, "last": _place(r.last)})
        return groups

    def page(self, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
        """As audit_page, but of the ranges alone that the page is in."""
        if not 0 <= limit <= MOST or offset < 0:
            raise ValueError(f"limit must be 0..{MOST} and offset not negative")
        before, skipped, wanted = 0, 0, []
        for g in self._groups():
            if before + g["n"] <= offset:
                skipped += g["n"]
            elif before < offset + limit:
                wanted += g["ranges"]
            before += g["n"]
        rows = self.spark.read.parquet(f"{self.folder.path}/rows")
        hit = F.lit(False)
        for batch, number in wanted:
            hit = hit | ((F.col("batch") == batch) & (F.col("range") == number))
        return rows.where(hit).drop("batch", "range").orderBy(F.desc_nulls_first("created_at"), F.desc("id")).offset(offset - skipped).limit(limit)

    def total(self) -> int:
        return sum(g["n"] for g in self._groups())


def _place(key: Row) -> tuple:
    """A key as a tuple that sorts: undated rows above all dated ones."""
    return (1, 0, key.id) if key.created_at is None else (0, key.created_at, key.id)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
