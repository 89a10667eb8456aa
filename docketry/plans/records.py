"""The case records as stored tables, changed by numbered batches of requests."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import cascade as D
from docketry.operators import commands as C
from docketry.sources.store import Folder, StoredTable
from docketry.sources.tables import AUDIT_LOGS, BASE, CASES, DOC_FILES, SALES_ORDERS


def _ddl(columns: str) -> str:
    return columns.replace("?", "")


class Records:
    """Cases, sales orders and documents in partitions by a hash of their id, and the audit trail in a folder for each batch.

    Each command judges its batch once, against the state before it, and writes the verdicts; rows and audit rows are worked out from
    these. So a batch that stopped anywhere is finished by running it again, and one that was finished changes nothing. Batch numbers rise; one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.folder = spark, Folder(spark, path)
        table = lambda name, columns: StoredTable(spark, f"{path}/{name}", _ddl(columns), "id", parts)
        self.cases, self.sales_orders, self.documents = table("cases", CASES), table("sales_orders", SALES_ORDERS), table("documents", DOC_FILES)

    def load(self, cases: DataFrame, orders: DataFrame, documents: DataFrame) -> None:
        """The state before the first batch, as batch 0."""
        for stored, rows in ((self.cases, cases), (self.sales_orders, orders), (self.documents, documents)):
            stored.upsert(0, rows)

    def audit(self) -> DataFrame:
        if not self.folder.exists("audit"):
            return self.spark.createDataFrame([], f"{_ddl(AUDIT_LOGS)}, batch long")
        return self.spark.read.schema(f"{_ddl(AUDIT_LOGS)}, batch long").parquet(f"{self.folder.path}/audit")

    def verdicts(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/verdicts/{number}")

    def _judged(self, number: int, judge: Callable[[], DataFrame]) -> DataFrame:
        if not self.folder.exists(f"verdicts/{number}/_SUCCESS"):
            judge().write.mode("overwrite").parquet(f"{self.folder.path}/verdicts/{number}")
        return self.verdicts(number)

    def _made(self, number: int, make: Callable[[], DataFrame]) -> DataFrame:
        """New rows, kept with the verdicts: their ids follow the state before the batch, whenever it is finished."""
        at = f"made/{number}"
        if not self.folder.exists(f"{at}/_SUCCESS"):
            make().write.mode("overwrite").parquet(f"{self.folder.path}/{at}")
        return self.spark.read.parquet(f"{self.folder.path}/{at}")

    def _log(self, number: int, rows: DataFrame, at: Column) -> None:
        """Ids go on in steps of batches: the batch's number, then the place in it."""
        if self.folder.exists(f"audit/batch={number}/_SUCCESS"):
            return
        placed = C.numbered(rows, "seq").withColumn("id", F.lit(number).cast("long") * (1 << 40) + F.col("nth"))
        placed.select("id", "case_id", "document_id", "sales_order_id", "action", "actor", "details", at.alias("created_at")).write.mode("overwrite").parquet(f"{self.folder.path}/audit/batch={number}")

    def create_cases(self, number: int, batch: DataFrame, year: int, at: Column) -> DataFrame:
        """Requests (seq, opportunity_id, customer_name, case_type, notes)."""
        judged = self._judged(number, lambda: C.create_cases(self.cases.read(), C.trimmed(batch), year))
        rows = self._made(number, lambda: C.case_rows(judged, self.cases.read(), at))
        self.cases.upsert(number, rows)
        self._log(number, C.audit_new_cases(rows), at)
        return judged

    def update_cases(self, number: int, batch: DataFrame, at: Column) -> DataFrame:
        """Patches (seq, id, set, customer_name, case_type, status, notes)."""
        judged = self._judged(number, lambda: C.judged_patches(self.cases.read(), C.trimmed(batch)))
        self.cases.apply(number, judged.where("reject_reason is null").select("id"), lambda old: C.patched_cases(old, judged, at))
        self._log(number, C.audit_patches(judged), at)
        return judged

    def create_orders(self, number: int, batch: DataFrame, at: Column) -> DataFrame:
        """Requests (seq, case_id, so_number, so_month)."""
        judged = self._judged(number, lambda: C.create_sales_orders(self.cases.read(), self.sales_orders.read(), C.trimmed(batch)))
        rows = self._made(number, lambda: C.order_rows(judged, self.sales_orders.read(), at))
        self.sales_orders.upsert(number, rows)
        self._log(number, C.audit_new_orders(rows), at)
        return judged

    def upload(self, number: int, batch: DataFrame, at: Column, base: str = BASE) -> DataFrame:
        """Requests (seq, case_id, sales_order_id, document_type, original_filename, checksum, file_size, reference_number, uploaded_by); the replies to the accepted ones."""
        judged = self._judged(number, lambda: C.upload_documents(self.cases.read(), self.sales_orders.read(), self.documents.read(), C.trimmed(batch)))
        rows = self._made(number, lambda: C.document_rows(judged, self.cases.read(), self.sales_orders.read(), self.documents.read(), base, at))
        self.documents.upsert(number, rows)
        self._log(number, C.audit_new_documents(rows), at)
        return C.upload_replies(rows)

    def rotate(self, number: int, batch: DataFrame, at: Column) -> DataFrame:
        """Turns (seq, id, degrees)."""
        judged = self._judged(number, lambda: C.judged_rotations(self.documents.read(), batch))
        turns = judged.where("reject_reason is null").select("id", "degrees")
        self.documents.apply(number, turns, lambda old: C.rotate(old, turns, "id"))
        self._log(number, C.audit_rotations(judged), at)
        return judged

    def delete_documents(self, number: int, batch: DataFrame, at: Column) -> DataFrame:
        """Deletions (seq, id, deleted_by); the verdicts name the files to remove."""
        judged = self._judged(number, lambda: C.judged_deletions(self.documents.read(), batch))
        self.documents.remove(number, judged.where("reject_reason is null"))
        self._log(number, C.audit_deletions(judged), at)
        return judged

    def delete_cases(self, number: int, ids: DataFrame) -> DataFrame:
        """Cases, their orders and documents, by the declared keys; (id, storage_path) of the files to remove. The trail keeps its rows; what they name may be gone."""
        def found() -> DataFrame:
            tables = {"cases": self.cases.read(), "sales_orders": self.sales_orders.read(), "documents": self.documents.read()}
            deletion = D.delete(tables, {"cases": ids})
            paths = D.files(tables["documents"], deletion)
            none = F.lit(None).cast("string")
            marked = [df.select(F.lit(t).alias("table"), "id", none.alias("storage_path")) for t, df in deletion.gone.items() if t != "documents"]
            every = paths.select(F.lit("documents").alias("table"), "id", "storage_path")
            for df in marked:
                every = every.unionByName(df)
            return every

        judged = self._judged(number, found)
        of = lambda t: judged.where(F.col("table") == t)
        for name, stored in (("documents", self.documents), ("sales_orders", self.sales_orders), ("cases", self.cases)):
            stored.remove(number, of(name))
        return of("documents").select("id", "storage_path")
