"""Uploads as one stream: requests meet their files by name, duplicates are found in keyed state, accepted ones become rows and audit rows."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketry.functions.scalars import file_id, storage_path, stored_filename
from docketry.operators import commands as C
from docketry.sources.store import shared_dir
from docketry.sources.tables import BASE

#: A request names the file that was put into the staging folder for it.
REQUEST = "seq long, case_id long, sales_order_id long, document_type string, staged_name string, original_filename string, reference_number string, uploaded_by string, sent_at timestamp"
#: A document that goes; its file may be uploaded again from then on.
DELETION = "seq long, case_id long, checksum string, sent_at timestamp"
_JUDGED = "kind string, seq long, case_id long, sales_order_id long, document_type string, original_filename string, reference_number string, uploaded_by string, checksum string, file_size long, case_key string, so_number string, so_month string, sent_at timestamp, reject_reason string"


def with_files(requests: DataFrame, files: DataFrame, within: str = "1 hour") -> DataFrame:
    """Requests with checksum and file_size of the staged file that they name, each of two streams waiting for the other.

    Both are kept for `within` after event time has passed them, and the file must be stored within that time of the request, before
    or after it; then they are forgotten. Contents are not kept, only what was worked out of them.
    """
    asked = requests.withWatermark("sent_at", within)
    stored = files.select(F.col("original_filename").alias("_name"), "checksum", "file_size", "stored_at").withWatermark("stored_at", within)
    near = F.col("stored_at").between(F.col("sent_at") - F.expr(f"interval {within}"), F.col("sent_at") + F.expr(f"interval {within}"))
    return asked.join(stored, (F.col("staged_name") == F.col("_name")) & near).drop("_name", "stored_at", "staged_name")


def judged(requests: DataFrame, cases: DataFrame, orders: DataFrame) -> DataFrame:
    """Requests with the first reason against them that the tables of cases and orders give, and what their path needs."""
    known = requests.join(cases.select(F.col("id").alias("case_id"), F.col("case_id").alias("case_key"), F.lit(True).alias("_case")), "case_id", "left")
    known = known.join(orders.select(F.col("id").alias("sales_order_id"), F.col("case_id").alias("_owner"), "so_number", "so_month"), "sales_order_id", "left")
    return known.withColumn("reject_reason", C.upload_reason(F.lit(False))).drop("_case", "_owner")


class FirstOfItsKind(StatefulProcessor):
    """Of each case and checksum, the seq of the upload that was accepted: later ones are duplicates, until the document is deleted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")  # one file's requests of one batch
        held, last, reasons = self.accepted.exists(), None, []
        for kind, seq, reason in zip(frame["kind"], frame["seq"], frame["reject_reason"], strict=True):
            if kind == "delete":
                held = False
            elif reason is None and held:
                reason = "duplicate file"
            elif reason is None:
                held, last = True, int(seq)
            reasons.append(reason)
        if not held:
            self.accepted.clear()
        elif last is not None:
            self.accepted.update((last,))
        frame["reject_reason"] = pd.Series(reasons, index=frame.index, dtype=object)
        yield frame[frame["kind"] == "upload"]

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.accepted.update((-1,))

    def close(self) -> None:
        pass


def without_duplicates(rows: DataFrame, deletions: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Judged requests, duplicates among them rejected: state is kept by case and checksum, so a batch's work is that of its own rows.

    `before`: (case_id, checksum) of the documents that there were when the stream first started.
    """
    names = [c.strip().split(" ")[0] for c in _JUDGED.split(",")]
    uploads = rows.withColumn("kind", F.lit("upload")).select(*names)
    if deletions is not None:
        none = {n: F.lit(None).cast(kind) for n, kind in (c.strip().split(" ") for c in _JUDGED.split(",")) if n not in ("seq", "case_id", "checksum", "sent_at")}
        uploads = uploads.unionByName(deletions.withColumns({**none, "kind": F.lit("delete")}).select(*names))
    known = None if before is None else before.select("case_id", "checksum").distinct().groupBy("case_id", "checksum")
    return uploads.groupBy("case_id", "checksum").transformWithStateInPandas(FirstOfItsKind(), _JUDGED, "append", "None", known)


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store, which keeps it on disk and checkpoints what changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def ingest(
    requests: DataFrame, files: DataFrame, cases: DataFrame, orders: DataFrame, path: str, checkpoint: str, deletions: DataFrame | None = None, before: DataFrame | None = None, within: str = "1 hour", base: str = BASE
) -> StreamingQuery:
    """Everything that is there: document rows, rejected requests and audit rows, in folders of `path` named by batch.

    A batch that runs again after a failure overwrites its own folders from the same state, so results are written once. A document's id is a hash of case and
    checksum, which are unique together, and needs no look at the table. `before` counts when the checkpoint is new, and only then.
    """
    spark = requests.sparkSession
    use_keyed_state(spark)
    shared_dir(spark)
    told = without_duplicates(judged(with_files(requests, files, within), cases, orders), deletions, before)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        ok = batch.where("reject_reason is null")
        stored = stored_filename(F.concat_ws("-", "case_id", "checksum"), F.col("original_filename"))
        rows = ok.select(
            "seq", file_id(F.sha2(F.concat_ws("-", "case_id", "checksum"), 256)).alias("id"), "case_id", "sales_order_id", "document_type", stored.alias("filename"), "original_filename", "reference_number",
            storage_path(F.lit(base), F.col("case_key"), F.col("so_month"), F.col("so_number"), F.col("document_type"), stored).alias("storage_path"), "checksum", F.col("file_size").cast("int").alias("file_size"),
            F.lit(0).alias("rotation"), F.col("sent_at").cast("timestamp_ntz").alias("uploaded_at"), F.coalesce("uploaded_by", F.lit("Anonymous")).alias("uploaded_by"),
        )
        put(rows, "documents")
        put(C.audit_new_documents(rows), "audit")
        put(batch.where("reject_reason is not null").select("seq", "case_id", "checksum", "original_filename", "reject_reason"), "rejected")
        batch.unpersist()

    return told.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
