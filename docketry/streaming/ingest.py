"""Upload requests as a stream: each micro-batch goes through the batch command, against all that was accepted before.

uploads.ingest does the same with keyed state, whose work doesn't grow with the age of the stream, and joins requests to their files.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.operators.commands import audit_rows, upload_documents

REQUEST = "seq long, case_id long, sales_order_id long, document_type string, original_filename string, checksum string, uploaded_by string"


#: Columns of a file source that reads whole files.
FILES = "path string, modificationTime timestamp, length long, content binary"


def staged_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files put into a staging folder, as a stream: original_filename, content, checksum and file_size of each PDF, whatever its letter case."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return files.select("path", name.alias("original_filename"), "content", F.sha2("content", 256).alias("checksum"), F.col("length").alias("file_size"), F.col("modificationTime").alias("stored_at"))


def ingest_uploads(requests: DataFrame, cases: DataFrame, orders: DataFrame, accepted_path: str, rejected_path: str, audit_path: str, checkpoint: str, documents: DataFrame | None = None) -> StreamingQuery:
    """Append accepted requests, rejected ones with their reason, and audit rows, batch by batch.

    What was accepted before and the `documents` that there were already are the state that duplicates are looked up in, so a file
    uploaded again in a later batch is rejected. Of that state, upload_documents keeps what a batch asks for before anything is shuffled. A batch that is run again after a failure writes to the same folders, named by the batch,
    and leaves out its own earlier output.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], "case_id long, checksum string, batch long")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(accepted_path)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            before = spark.read.schema("case_id long, checksum string, batch long").parquet(accepted_path)
        state = before.where(F.col("batch") < number).select("case_id", "checksum")
        if documents is not None:
            state = state.unionByName(documents.select("case_id", "checksum"))
        judged = upload_documents(cases, orders, state, batch).persist()
        judged.where("reject_reason is null").drop("reject_reason").write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
        judged.where("reject_reason is not null").write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        audit_rows(judged, "DOCUMENT_UPLOADED", F.col("uploaded_by"), ["document_type", "original_filename"]).write.mode("overwrite").parquet(f"{audit_path}/batch={number}")
        judged.unpersist()

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
