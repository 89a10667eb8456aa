"""Statistics kept up to date: what each batch adds and takes away, summed when they are read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.scalars import megabytes
from docketry.sources.store import Folder
from docketry.sources.tables import DOCUMENT_TYPES

#: By table, the parts of its counts: a row counts once under each. Sums are of file sizes.
PARTS = {"cases": ("status",), "sales_orders": ("so_month",), "documents": ("document_type", "uploaded_on")}


def measured(table: str, rows: DataFrame, sign: int = 1) -> DataFrame:
    """(table, measure, part, value): the counts and sums of rows that come (sign 1) or go (-1), a row for each part."""
    if table == "documents":
        rows = rows.withColumn("uploaded_on", F.to_date("uploaded_at").cast("string"))
    size = F.sum(F.col("file_size").cast("long")) if table == "documents" else F.lit(0).cast("long")
    total = rows.agg(F.count("*").alias("count"), F.coalesce(size, F.lit(0)).alias("bytes")).select(F.lit("").alias("part"), F.explode(F.create_map(F.lit("count"), "count", F.lit("bytes"), "bytes")).alias("measure", "value"))
    found = total.select("measure", "part", "value")
    for c in PARTS[table]:
        found = found.unionByName(rows.groupBy(F.col(c).alias("part")).agg(F.count("*").alias("value")).select(F.lit(c).alias("measure"), "part", "value"))
    return found.select(F.lit(table).alias("table"), "measure", "part", (F.col("value") * sign).alias("value")).where("value <> 0")


class Statistics:
    """A folder of deltas, one for each batch: a batch that is added again replaces itself. Reading sums them; `compact` writes the sum of old ones.

    Counts, sums and counts by part are additive, so deletions are rows of the opposite sign, and an update is both. What stands in for a
    least or largest value is whether a part's count is above zero.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def add(self, batch: int, came: dict[str, DataFrame] | None = None, went: dict[str, DataFrame] | None = None) -> None:
        found = None
        for rows, sign in ((came or {}, 1), (went or {}, -1)):
            for table, df in rows.items():
                one = measured(table, df, sign)
                found = one if found is None else found.unionByName(one)
        if found is None:
            raise ValueError("a batch needs rows that come or go")
        summed = found.groupBy("table", "measure", "part").agg(F.sum("value").alias("value"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/delta/batch={batch}")  # a row for each part

    def _batches(self, kind: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names(kind) if n.startswith("batch=") and self.folder.exists(f"{kind}/{n}/_SUCCESS"))

    def merged(self, upto: int | None = None) -> DataFrame:
        """(table, measure, part, value) of all batches, or of those up to one: the last sum that was written, and what came after."""
        sums = [b for b in self._batches("sum") if upto is None or b <= upto]
        base = max(sums, default=None)
        later = [b for b in self._batches("delta") if (base is None or b > base) and (upto is None or b <= upto)]
        paths = ([f"{self.folder.path}/sum/batch={base}"] if base is not None else []) + [f"{self.folder.path}/delta/batch={b}" for b in later]
        rows = self.spark.read.schema("table string, measure string, part string, value long").parquet(*paths) if paths else self.spark.createDataFrame([], "table string, measure string, part string, value long")
        return rows.groupBy("table", "measure", "part").agg(F.sum("value").alias("value")).where("value <> 0")

    def compact(self, upto: int) -> None:
        """Write the sum of the batches up to one. They stay until `forget`, so a reader in between sees either."""
        self.merged(upto).coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/sum/batch={upto}")

    def forget(self) -> None:
        """Remove what the last sum holds."""
        base = max(self._batches("sum"), default=None)
        for kind in ("sum", "delta"):
            for b in self._batches(kind):
                if base is not None and (b < base or (b == base and kind == "delta")):
                    self.folder.delete(f"{kind}/batch={b}")

    def overview(self, as_of: str, days: int = 7, documents: DataFrame | None = None) -> DataFrame:
        """All statistics in one row, as aggregates.overview gives them, from the deltas alone.

        Uploads are counted by day. Where as_of has a time of day, the first day counts from that time on, which `documents` is asked for.
        """
        since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
        is_ = lambda table, measure: (F.col("table") == table) & (F.col("measure") == measure)
        total = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0))
        day = F.col("part").cast("date")
        status = [total(is_("cases", "status") & (F.col("part") == s)).alias(n) for s, n in (("OPEN", "open_cases"), ("IN_PROGRESS", "in_progress_cases"), ("CLOSED", "closed_cases"))]
        types = [total(is_("documents", "document_type") & (F.col("part") == t)).alias(f"n_{t.lower()}") for t in DOCUMENT_TYPES]
        whole = is_("documents", "uploaded_on") & ((day.cast("timestamp_ntz") >= since) if documents is None else (day > since.cast("date")))
        found = self.merged().agg(
            total(is_("cases", "count")).alias("total"), *status, total(is_("sales_orders", "count")).alias("total_sales_orders"), total(is_("documents", "count")).alias("total_documents"),
            total(is_("documents", "bytes")).alias("total_bytes"), total(whole).alias("recent_uploads"), *types,
        ).withColumn("total_mb", megabytes(F.col("total_bytes")))
        if documents is not None:
            first_day = documents.where((F.col("uploaded_at") >= since) & (F.col("uploaded_at") < (since.cast("date") + F.expr("interval 1 day")).cast("timestamp_ntz"))).agg(F.count("*").alias("_first"))
            found = found.crossJoin(first_day).withColumn("recent_uploads", F.col("recent_uploads") + F.col("_first")).drop("_first")
        return found

    def by_part(self, table: str, measure: str) -> DataFrame:
        """(part, n) of the parts that rows are in: documents by type, orders by month."""
        return self.merged().where((F.col("table") == table) & (F.col("measure") == measure) & (F.col("value") > 0)).select("part", F.col("value").alias("n"))
