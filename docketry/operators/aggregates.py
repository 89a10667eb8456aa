"""Counts, sums and the statistics document."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.scalars import case_number, case_suffix, megabytes


def totals(cases: DataFrame, orders: DataFrame, documents: DataFrame) -> DataFrame:
    """One row; each table is counted in a pass of its own, over no columns."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(cases, "total_cases").crossJoin(count(orders, "total_sales_orders")).crossJoin(count(documents, "total_documents"))


def case_status(cases: DataFrame) -> DataFrame:
    """A null status is in no count but the total."""
    each = [F.count_if(F.col("status") == s).alias(name) for s, name in (("OPEN", "open_cases"), ("IN_PROGRESS", "in_progress_cases"), ("CLOSED", "closed_cases"))]
    return cases.agg(F.count("*").alias("total"), *each)


def by_type(documents: DataFrame) -> DataFrame:
    return documents.groupBy("document_type").agg(F.count("*").alias("n"))


def type_share(documents: DataFrame) -> DataFrame:
    """Percent of all documents, from the grouped counts: the table is read once."""
    counts = by_type(documents)
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).select("document_type", "n", (F.col("n") * 100.0 / F.col("_all")).alias("share"))


def storage(documents: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.col("file_size").cast("long")), F.lit(0))
    return documents.agg(total.alias("total_bytes")).withColumn("total_mb", megabytes(F.col("total_bytes")))


def recent_uploads(documents: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Uploads from `days` before as_of on, without an upper bound."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    return documents.agg(F.count_if(F.col("uploaded_at") >= since).alias("recent_uploads"))


def months(orders: DataFrame) -> DataFrame:
    return orders.select("so_month").distinct().orderBy("so_month")


def month_counts(orders: DataFrame, case_id: int, month: str) -> DataFrame:
    return orders.where(F.col("case_id") == case_id).agg(F.count_if(F.col("so_month") == month).alias("shown"), F.count("*").alias("total"))


def overview(cases: DataFrame, orders: DataFrame, documents: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """All statistics in one row; documents are aggregated once for five of them."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    types = [F.count_if(F.col("document_type") == t).alias(f"n_{t.lower()}") for t in ("CUSTOMER_PO", "VENDOR_INVOICE", "VENDOR_DC", "COMPANY_INVOICE", "COMPANY_DC", "POD")]
    of_documents = documents.agg(
        F.count("*").alias("total_documents"), F.coalesce(F.sum(F.col("file_size").cast("long")), F.lit(0)).alias("total_bytes"), F.count_if(F.col("uploaded_at") >= since).alias("recent_uploads"), *types
    ).withColumn("total_mb", megabytes(F.col("total_bytes")))
    return case_status(cases).crossJoin(orders.agg(F.count("*").alias("total_sales_orders"))).crossJoin(of_documents)


def next_case_id(cases: DataFrame, year: int) -> DataFrame:
    """The id after the largest number of the year, 0001 for the first; by number, so 10000 follows 9999."""
    prefix = f"CASE-{year}-"
    largest = cases.where(F.col("case_id").startswith(prefix)).agg(F.coalesce(F.max(case_suffix(F.col("case_id"))), F.lit(0)).alias("_n"))
    return largest.select(case_number(F.lit(prefix), F.col("_n") + 1).alias("case_id"))
