"""Which document types a sales order has, and the joins that show it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.scalars import folder_path
from docketry.operators.lookups import search
from docketry.sources.tables import DOCUMENT_TYPES, ORDER_TYPES


def per_order(documents: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row per sales order with documents: their number and a boolean per type, summed before any shuffle."""
    has = [F.bool_or(F.col("document_type") == t).alias(f"has_{t.lower()}") for t in types]
    return documents.where("sales_order_id is not null").groupBy("sales_order_id").agg(F.count("*").alias("document_count"), *has)


def with_checklist(orders: DataFrame, documents: DataFrame, types: tuple[str, ...] = ORDER_TYPES) -> DataFrame:
    """Orders with their checklist; an order without documents has count 0 and no types."""
    names = [f"has_{t.lower()}" for t in types]
    joined = orders.join(per_order(documents, types), orders["id"] == F.col("sales_order_id"), "left")
    filled = {"document_count": F.coalesce("document_count", F.lit(0)), **{n: F.coalesce(n, F.lit(False)) for n in names}}
    return joined.withColumns(filled).drop("sales_order_id")


def type_set(documents: DataFrame) -> DataFrame:
    """The distinct types of each order, comma-joined in order."""
    sets = documents.where("sales_order_id is not null").groupBy("sales_order_id").agg(F.array_sort(F.collect_set("document_type")).alias("_t"))
    return sets.select("sales_order_id", F.array_join("_t", ",").alias("types"))


def completion(listed: DataFrame, types: tuple[str, ...]) -> DataFrame:
    done = sum((F.col(f"has_{t.lower()}").cast("int") for t in types), F.lit(0))
    return listed.select("id", "so_number", done.alias("completed"), F.lit(len(types)).alias("total"), (done == len(types)).alias("is_complete"))


def unpivoted(listed: DataFrame, types: tuple[str, ...]) -> DataFrame:
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("document_type"), F.col(f"has_{t.lower()}").alias("present")) for t in types]))
    return listed.select("id", entries.alias("_e")).select("id", "_e.document_type", "_e.present")


def order_search(orders: DataFrame, cases: DataFrame, documents: DataFrame, query: str, limit: int = 20, hits: DataFrame | None = None) -> DataFrame:
    """Hits first, from a scan or as an index found them, then at most `limit` of them are joined: their case, folder and six-type checklist."""
    hits = (search(orders, ("so_number",), query, "so_number", limit) if hits is None else hits).drop("created_at", "updated_at")
    known = cases.select(F.col("id").alias("_case"), F.col("case_id").alias("case_key"), "opportunity_id", "customer_name")
    # At most `limit` order ids: the documents are filtered to them before they are summed up.
    of_hits = documents.join(F.broadcast(hits.select(F.col("id").alias("_hit"))), documents["sales_order_id"] == F.col("_hit"), "left_semi")
    listed = with_checklist(hits.join(known, hits["case_id"] == F.col("_case"), "left"), of_hits, DOCUMENT_TYPES)
    return listed.withColumn("folder_path", folder_path(F.col("case_key"), F.col("so_month"), F.col("so_number"))).drop("_case")


def customer_po(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Each case with one customer PO, that of the smallest checksum; null without one."""
    first = documents.where(F.col("document_type") == "CUSTOMER_PO").groupBy(F.col("case_id").alias("_case")).agg(F.min("checksum").alias("po_checksum"))
    return cases.join(first, cases["id"] == F.col("_case"), "left").select("id", "case_id", "po_checksum")


def case_detail(cases: DataFrame, orders: DataFrame, documents: DataFrame) -> DataFrame:
    """Flat: one row per case and order, cases without orders kept."""
    po = customer_po(cases, documents).select(F.col("id").alias("_c"), "po_checksum")
    listed = with_checklist(orders.select("id", F.col("case_id").alias("_case"), "so_number", "so_month"), documents).withColumnRenamed("id", "so_id")
    return cases.join(po, cases["id"] == F.col("_c"), "left").join(listed, cases["id"] == F.col("_case"), "left").drop("_c", "_case", "notes", "created_at", "updated_at")


def nested(detail: DataFrame) -> DataFrame:
    """One row per case of case_detail, its orders an array sorted by month and number."""
    per = [c for c in detail.columns if c.startswith("has_")]
    order = F.struct("so_month", "so_number", "so_id", "document_count", F.struct(*[F.col(c).alias(c[4:].upper()) for c in per]).alias("checklist"))
    keys = ["id", "case_id", "opportunity_id", "customer_name", "case_type", "status", "po_checksum"]
    return detail.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("so_id").isNotNull(), order))).alias("sales_orders"))
