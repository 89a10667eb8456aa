"""The registry of queries: the domain tables in SQL, and what every module of queries adds."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The domain tables in DuckDB SQL.
VIEWS = """
cases AS (
  SELECT c_custkey AS id, 'CASE-2026-' || CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END AS case_id,
    'SKY-' || CAST(c_custkey AS VARCHAR) AS opportunity_id, c_name AS customer_name,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE', 'MACHINERY') THEN 'HARDWARE' ELSE 'SERVICES' END AS case_type,
    CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'OPEN' WHEN c_custkey % 3 = 1 THEN 'IN_PROGRESS' ELSE 'CLOSED' END AS status, CAST(NULL AS VARCHAR) AS notes,
    CAST(DATE '2026-01-01' + CAST(c_custkey % 300 AS INTEGER) AS TIMESTAMP) AS created_at, CASE WHEN c_custkey % 4 <> 0 THEN CAST(DATE '2026-01-01' + CAST(c_custkey % 300 + c_custkey % 9 AS INTEGER) AS TIMESTAMP) END AS updated_at
  FROM customer),
sales_orders AS (
  SELECT o_orderkey AS id, o_custkey AS case_id, '10TM' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS so_number, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS so_month, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP) END AS updated_at
  FROM orders),
doc_kinds AS (
  SELECT *, CASE l_linenumber WHEN 2 THEN 'VENDOR_INVOICE' WHEN 3 THEN 'VENDOR_DC' WHEN 4 THEN 'COMPANY_INVOICE' WHEN 5 THEN 'COMPANY_DC' WHEN 6 THEN 'POD' ELSE 'CUSTOMER_PO' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
doc_rows AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_custkey AS case_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS sales_order_id, kind AS document_type,
    lower(kind) || ' ' || CAST(l_linenumber AS VARCHAR) || '.pdf' AS original_filename, CASE WHEN l_linenumber % 2 = 0 THEN 'REF-' || CAST(l_partkey AS VARCHAR) END AS reference_number,
    sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
      CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), l_returnflag, l_linestatus, substr(CAST(l_shipdate AS VARCHAR), 1, 10))) AS checksum,
    CAST(floor(l_extendedprice) AS INTEGER) AS file_size, CAST((l_linenumber % 4) * 90 AS INTEGER) AS rotation, l_shipdate AS uploaded_at, 'Anonymous' AS uploaded_by
  FROM doc_kinds),
doc_names AS (SELECT *, CAST('0x' || substr(checksum, 1, 15) AS BIGINT) AS id, substr(md5(checksum), 1, 8) || '_' || replace(original_filename, ' ', '_') AS filename FROM doc_rows),
doc_files AS (
  SELECT * EXCLUDE (o_orderkey, o_custkey, o_orderdate), '/data/cases/CASE-2026-' || CASE WHEN o_custkey < 10000 THEN lpad(CAST(o_custkey AS VARCHAR), 4, '0') ELSE CAST(o_custkey AS VARCHAR) END || '/' || substr(CAST(o_orderdate AS VARCHAR), 1, 7)
    || '/SO-10TM' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '/' || document_type || '/' || filename AS storage_path
  FROM doc_names),
audit_logs AS (
  SELECT event_id AS id, user_id AS case_id, CASE WHEN event_id % 3 <> 0 THEN event_id + 7 END AS document_id, CASE WHEN event_id % 2 = 0 THEN event_id % 1000 END AS sales_order_id, 'DOCUMENT_' || upper(event_type) AS action, 'user_' || CAST(user_id AS VARCHAR) AS actor, props AS details, ts AS created_at FROM events)
"""


def has_types(types: tuple[str, ...], prefix: str = "") -> str:
    return ", ".join(f"coalesce(bool_or(document_type = '{t}'), false) AS has_{t.lower()}" for t in types)


def listed(types: tuple[str, ...]) -> str:
    """Orders with their checklist, in SQL."""
    return f"SELECT s.id, s.case_id, so_number, so_month, created_at, count(d.checksum) AS document_count, {has_types(types)} FROM sales_orders s LEFT JOIN doc_files d ON d.sales_order_id = s.id GROUP BY ALL"


def register(name: str, sql: str, query: Query) -> None:
    """sql reads the domain tables; views that it doesn't use cost nothing."""
    QUERIES[name] = query
    SQL[name] = f"WITH {VIEWS} {sql}"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
