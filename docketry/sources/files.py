"""Stored PDF files: listing, content by document, existence and size, writing and deleting."""

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime and content of every PDF below the folder, whatever its letter case."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)


def located(files: DataFrame) -> DataFrame:
    """Files with case_id, so_month, so_number and document_type, from .../case/month/SO-number/type/name."""
    at = r"([^/]+)/(\d{4}-\d{2})/SO-([^/]+)/([^/]+)/[^/]+$"
    return files.withColumns({name: F.regexp_extract("path", at, i + 1) for i, name in enumerate(("case_id", "so_month", "so_number", "document_type"))})


def content(documents: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """Documents with the content of the file at their storage_path, its sha-256, rotation_header and the two download headers.

    A document whose file is missing ends the query with an error; without `strict` its content is null.
    """
    stored = files.select(F.regexp_replace("path", "^file:/+", "/").alias("storage_path"), "content", "length")
    named = lambda kind: F.concat(F.lit(f'{kind}; filename="'), F.col("original_filename"), F.lit('"'))
    joined = documents.join(stored, "storage_path", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("file not found: "), F.coalesce("storage_path", F.lit("no path")))).cast("binary")
        joined = joined.withColumn("content", F.when(F.col("content").isNull(), missing).otherwise(F.col("content")))
    turned = F.coalesce(F.col("rotation"), F.lit(0)).cast("string") if "rotation" in documents.columns else F.lit("0")
    return joined.withColumns({"sha256": F.sha2("content", 256), "rotation_header": turned, "inline": named("inline"), "attachment": named("attachment")})


def content_of(documents: DataFrame, files: DataFrame, document_id: int) -> DataFrame:
    """`content` of one document, by its id."""
    return content(documents.where(F.col("id") == document_id).limit(1), files)


def present(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents with `exists` and `length`, 0 where the file is missing. Content is not read."""
    stored = files.select(F.regexp_replace("path", "^file:/+", "/").alias("storage_path"), F.col("length").alias("_length"))
    return documents.join(stored, "storage_path", "left").withColumns({"exists": F.col("_length").isNotNull(), "length": F.coalesce("_length", F.lit(0))}).drop("_length")


def write(documents: DataFrame) -> None:
    """Write `content` to `storage_path`, making folders; a path that all executors share."""

    def save(rows: Iterator[Row]) -> None:
        for row in rows:
            path = Path(row.storage_path)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(bytes(row.content))

    documents.select("storage_path", "content").foreachPartition(save)


def delete(documents: DataFrame) -> int:
    """Remove the files at `storage_path`; how many of them there were."""
    gone = documents.sparkSession.sparkContext.accumulator(0)

    def remove(rows: Iterator[Row]) -> None:
        for row in rows:
            path = Path(row.storage_path)
            if path.exists():
                path.unlink(missing_ok=True)
                gone.add(1)

    documents.select("storage_path").foreachPartition(remove)
    return gone.value


def jdbc(spark: SparkSession, url: str, name: str, partition_column: str = "id", bounds: tuple[int, int] = (0, 1 << 31), partitions: int = 30, **options: str) -> DataFrame:
    """A table of the operational database, read in ranges of its key, so many at a time.

    options are the source's own: user, password, driver, fetchsize (10000 unless given), queryTimeout.
    """
    known = {"url": url, "dbtable": name, "partitionColumn": partition_column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions, "fetchsize": 10000} | options
    return spark.read.format("jdbc").options(**{k: str(v) for k, v in known.items()}).load()
