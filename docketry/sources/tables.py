"""The four domain tables, as views over the star-schema tables of a data folder."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.scalars import file_id, storage_path, stored_filename

# Fixed values of the data model.
CASE_TYPES = ("HARDWARE", "SERVICES")
STATUSES = ("OPEN", "IN_PROGRESS", "CLOSED")
DOCUMENT_TYPES = ("CUSTOMER_PO", "VENDOR_INVOICE", "VENDOR_DC", "COMPANY_INVOICE", "COMPANY_DC", "POD")
#: Orders list all types when searched, and all but the customer's own in a case's detail.
ORDER_TYPES = DOCUMENT_TYPES[1:]
ROTATIONS = (0, 90, 180, 270)


# Columns of the four tables, in order; a ? marks those that may be null.
CASES = "id long, case_id string, opportunity_id string, customer_name string, case_type string, status string?, notes string?, created_at timestamp_ntz?, updated_at timestamp_ntz?"
SALES_ORDERS = "id long, case_id long, so_number string, so_month string, created_at timestamp_ntz?, updated_at timestamp_ntz?"
DOC_FILES = (
    "id long, case_id long, sales_order_id long?, document_type string, filename string, original_filename string, reference_number string?, storage_path string, checksum string, file_size int, rotation int?, "
    "uploaded_at timestamp_ntz?, uploaded_by string?"
)
AUDIT_LOGS = "id long, case_id long?, document_id long?, sales_order_id long?, action string, actor string, details string?, created_at timestamp_ntz?"
#: Where the derived documents are filed.
BASE = "/data/cases"
#: Columns of a line that its document is made of.
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def schema(columns: str) -> T.StructType:
    """The schema that a table is created and read with."""
    fields = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind.rstrip("?")), kind.endswith("?")) for name, kind in fields])


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    number = F.when(key < 10000, F.lpad(key.cast("string"), 4, "0")).otherwise(key.cast("string"))
    status = F.when(key % 50 == 0, None).when(key % 3 == 0, "OPEN").when(key % 3 == 1, "IN_PROGRESS").otherwise("CLOSED")
    created = F.dateadd(F.lit("2026-01-01").cast("date"), (key % 300).cast("int")).cast("timestamp_ntz")
    return raw(spark, sf_dir, "customer").select(
        key.alias("id"), F.concat(F.lit("CASE-2026-"), number).alias("case_id"), F.concat(F.lit("SKY-"), key.cast("string")).alias("opportunity_id"), F.col("c_name").alias("customer_name"),
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "FURNITURE", "MACHINERY"), "HARDWARE").otherwise("SERVICES").alias("case_type"), status.alias("status"), F.lit(None).cast("string").alias("notes"),
        created.alias("created_at"), F.when(key % 4 != 0, F.dateadd(created, (key % 9).cast("int")).cast("timestamp_ntz")).alias("updated_at"),
    )


def sales_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return raw(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("case_id"), F.concat(F.lit("10TM"), F.lpad(key.cast("string"), 10, "0")).alias("so_number"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("so_month"), F.col("o_orderdate").alias("created_at"),
        F.when(key % 2 == 0, F.dateadd(F.col("o_orderdate"), 1).cast("timestamp_ntz")).alias("updated_at"),
    )


def _checksum() -> Column:
    """The SHA-256 of a line, in hex."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    parts += [cents(c) for c in ("l_extendedprice", "l_discount", "l_tax")] + [F.col("l_returnflag"), F.col("l_linestatus"), F.substring(F.col("l_shipdate").cast("string"), 1, 10)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(_owned(spark, raw(spark, sf_dir, "lineitem"), sf_dir))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are filed under an order. Their order is a plain column, so Spark sees that they lie by it and joins orders without dealing the documents out again."""
    return documents_of(_owned(spark, raw(spark, sf_dir, "lineitem").where("l_linenumber <> 7"), sf_dir), F.col("l_orderkey"))


def doc_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, case_id and sales_order_id of every document. Ids are made before the join, so 8 bytes of a document are shuffled and not the ten columns that its checksum is made of."""
    lines = raw(spark, sf_dir, "lineitem").select(file_id(_checksum()).alias("id"), "l_orderkey", _filed().alias("sales_order_id"))
    owners = raw(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"))
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select("id", "case_id", "sales_order_id")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document is made of, with its id and order to deal it out by: less than half the bytes of the documents that `documents_of` makes of them."""
    lines = _owned(spark, raw(spark, sf_dir, "lineitem"), sf_dir)
    return lines.select(*LINE, "o_custkey", "o_orderdate", file_id(_checksum()).alias("id"), _filed().alias("sales_order_id"))


def documents_of(lines: DataFrame, filed: Column | None = None) -> DataFrame:
    """The documents that lines and their orders make, each out of its own row."""
    line = F.col("l_linenumber")
    kind = F.when(line == 2, "VENDOR_INVOICE").when(line == 3, "VENDOR_DC").when(line == 4, "COMPANY_INVOICE").when(line == 5, "COMPANY_DC").when(line == 6, "POD").otherwise("CUSTOMER_PO")
    order, customer = F.col("l_orderkey"), F.col("o_custkey")
    case_key = F.concat(F.lit("CASE-2026-"), F.when(customer < 10000, F.lpad(customer.cast("string"), 4, "0")).otherwise(customer.cast("string")))
    number, month = F.concat(F.lit("10TM"), F.lpad(order.cast("string"), 10, "0")), F.substring(F.col("o_orderdate").cast("string"), 1, 7)
    name = F.concat(F.lower(kind), F.lit(" "), line.cast("string"), F.lit(".pdf"))
    stored = stored_filename(F.col("checksum"), name)
    return lines.withColumn("checksum", _checksum()).select(
        file_id(F.col("checksum")).alias("id"), customer.alias("case_id"), (_filed() if filed is None else filed).alias("sales_order_id"), kind.alias("document_type"), stored.alias("filename"), name.alias("original_filename"),
        F.when(line % 2 == 0, F.concat(F.lit("REF-"), F.col("l_partkey").cast("string"))).alias("reference_number"), storage_path(F.lit(BASE), case_key, month, number, kind, stored).alias("storage_path"),
        "checksum", F.floor("l_extendedprice").cast("int").alias("file_size"), ((line % 4) * 90).cast("int").alias("rotation"), F.col("l_shipdate").alias("uploaded_at"), F.lit("Anonymous").alias("uploaded_by"),
    )


def _filed() -> Column:
    """The order that a line's document is filed under, if it is under one."""
    return F.when(F.col("l_linenumber") != 7, F.col("l_orderkey"))


def _owned(spark: SparkSession, lines: DataFrame, sf_dir: str) -> DataFrame:
    owners = raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") + 7).alias("document_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 1000).alias("sales_order_id"), F.concat(F.lit("DOCUMENT_"), F.upper("event_type")).alias("action"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("actor"), F.col("props").alias("details"), F.col("ts").alias("created_at"),
    )
