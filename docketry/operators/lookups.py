"""Filters, key lookups and substring searches."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.scalars import normalize_opportunity

#: Rows that a search returns, and the shortest query that the client sends for cases and for orders.
SEARCH_LIMIT, LEAST_CASE_QUERY, LEAST_ORDER_QUERY = 20, 2, 3


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """At most one row: the columns looked up are unique."""
    return df.where(F.col(column) == F.lit(value)).limit(1)


def case_by_opportunity(cases: DataFrame, opportunity: str) -> DataFrame:
    return cases.where(F.col("opportunity_id") == normalize_opportunity(F.lit(opportunity))).limit(1)


def like(column: str, query: str) -> Column:
    """Anywhere, in any letter case; % and _ of the query are wildcards, a backslash is itself."""
    return F.col(column).ilike(f"%{query}%".replace("\\", "\\\\"))


def search(df: DataFrame, columns: tuple[str, ...], query: str, order: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Rows with the query in one of the columns, the first ones by a unique column."""
    hit = like(columns[0], query)
    for c in columns[1:]:
        hit = hit | like(c, query)
    return df.where(hit).orderBy(order).limit(limit)


def long_enough(df: DataFrame, query: str, least: int) -> DataFrame:
    """df, or nothing where the query has fewer characters than a search asks for."""
    return df if len(query) >= least else df.limit(0)


def global_search(cases: DataFrame, orders: DataFrame, query: str, kind: str) -> DataFrame:
    """Cases by opportunity or sales orders by number; any other kind finds nothing."""
    if kind == "opportunity":
        return search(cases, ("opportunity_id",), query, "opportunity_id")
    if kind == "sales_order":
        return search(orders, ("so_number",), query, "so_number")
    return cases.limit(0)


def asked_search(cases: DataFrame, orders: DataFrame, query: str, kind: str) -> DataFrame:
    """A search as the client sends it: without white space around, and only if it has the characters that one asks for."""
    query, least = query.strip(), {"opportunity": LEAST_CASE_QUERY, "sales_order": LEAST_ORDER_QUERY}.get(kind, 0)
    return long_enough(global_search(cases, orders, query, kind), query, least)


def audit_filtered(logs: DataFrame, case_id: int | None = None, action: str | None = None, actor: str | None = None) -> DataFrame:
    """Any of three filters; 0 and empty strings are no filter, as they are for the original."""
    if case_id:
        logs = logs.where(F.col("case_id") == case_id)
    if action:
        logs = logs.where(F.col("action") == action)
    if actor:
        logs = logs.where(like("actor", actor))
    return logs


def orders_of_case(orders: DataFrame, case_id: int, month: str | None = None) -> DataFrame:
    found = orders.where(F.col("case_id") == case_id)
    return (found.where(F.col("so_month") == month) if month else found).orderBy("so_month", "so_number")


def documents_of_case(documents: DataFrame, orders: DataFrame, case_id: int, sales_order_id: int | None = None, kind: str | None = None, month: str | None = None) -> DataFrame:
    """Newest first, undated ones before all. A month keeps that month's orders' documents and every customer PO."""
    found = documents.where(F.col("case_id") == case_id)
    if sales_order_id is not None:
        found = found.where(F.col("sales_order_id") == sales_order_id)
    if kind:
        found = found.where(F.col("document_type") == kind)
    if month:
        found = _of_orders(found, orders.where((F.col("case_id") == case_id) & (F.col("so_month") == month)))
    return found.orderBy(F.desc_nulls_first("uploaded_at"), "checksum")


def documents_of_months(documents: DataFrame, orders: DataFrame, case_id: int, months: DataFrame) -> DataFrame:
    """documents_of_case for the months of a table with the column so_month."""
    of_months = orders.where(F.col("case_id") == case_id).join(months, "so_month", "left_semi")
    return _of_orders(documents.where(F.col("case_id") == case_id), of_months).orderBy(F.desc_nulls_first("uploaded_at"), "checksum")


def _of_orders(documents: DataFrame, orders: DataFrame) -> DataFrame:
    """Documents of the orders, and every customer PO."""
    hit = orders.select(F.col("id").alias("_order"), F.lit(True).alias("_hit"))
    joined = documents.join(hit, documents["sales_order_id"] == F.col("_order"), "left")
    return joined.where(F.col("_hit").isNotNull() | (F.col("document_type") == "CUSTOMER_PO")).drop("_order", "_hit")


def documents_by_case_key(documents: DataFrame, cases: DataFrame, case_key: str) -> DataFrame:
    ids = cases.where(F.col("case_id") == case_key).select(F.col("id").alias("_case"))
    return documents.join(ids, documents["case_id"] == F.col("_case")).drop("_case")


def sidebar_search(orders: DataFrame, query: str) -> DataFrame:
    """The query taken literally, in any letter case."""
    return orders.where(F.lower("so_number").contains(query.lower()))


def uploaded_since(documents: DataFrame, since: datetime) -> DataFrame:
    return documents.where(F.col("uploaded_at") >= F.lit(since).cast("timestamp_ntz"))
