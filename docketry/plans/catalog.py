"""Every registered query of the case-record library, with the DuckDB SQL that it is held against.

Queries come with fixed arguments; all of them read the whole tables that they concern.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import scalars as S
from docketry.operators import aggregates as A
from docketry.operators import checklist as K
from docketry.operators import commands as C
from docketry.operators import lookups as L
from docketry.operators import paging as P
from docketry.plans.registry import SQL, VIEWS, Query, listed, oracle_sql, queries, register
from docketry.sources.tables import BASE, DOCUMENT_TYPES, ORDER_TYPES, audit_logs, cases, doc_files, doc_keys, order_files, raw, sales_orders

#: Time is an argument, never the clock.
AS_OF, YEAR = "2001-11-04", 2026

# Scans and projections. Times are shown as text, which both engines write alike.
_AT = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
_AT_SQL = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
_CASE, _DOC = ("id", "case_id", "opportunity_id", "customer_name", "case_type", "status", "notes"), ("case_id", "sales_order_id", "document_type", "original_filename", "reference_number", "file_size", "rotation")
register("scan_cases", f"SELECT {', '.join(_CASE)}, {_AT_SQL('created_at')}, {_AT_SQL('updated_at')} FROM cases", lambda s, d: cases(s, d).select(*_CASE, _AT("created_at"), _AT("updated_at")))
register("scan_sales_orders", f"SELECT id, case_id, so_number, so_month, {_AT_SQL('created_at')}, {_AT_SQL('updated_at')} FROM sales_orders", lambda s, d: sales_orders(s, d).select("id", "case_id", "so_number", "so_month", _AT("created_at"), _AT("updated_at")))
register("scan_doc_files", f"SELECT id, filename, storage_path, {', '.join(_DOC)}, checksum, {_AT_SQL('uploaded_at')}, uploaded_by FROM doc_files", lambda s, d: doc_files(s, d).select("id", "filename", "storage_path", *_DOC, "checksum", _AT("uploaded_at"), "uploaded_by"))
register("scan_audit_logs", f"SELECT id, case_id, document_id, sales_order_id, action, actor, details, {_AT_SQL('created_at')} FROM audit_logs", lambda s, d: audit_logs(s, d).select("id", "case_id", "document_id", "sales_order_id", "action", "actor", "details", _AT("created_at")))
register("proj_case_response", f"SELECT {', '.join(_CASE)}, {_AT_SQL('created_at')}, {_AT_SQL('updated_at')} FROM cases", lambda s, d: cases(s, d).select(*_CASE, _AT("created_at"), _AT("updated_at")))
register("proj_document_response", f"SELECT id, filename, storage_path, {', '.join(_DOC)}, {_AT_SQL('uploaded_at')}, uploaded_by FROM doc_files", lambda s, d: doc_files(s, d).drop("checksum").select("id", "filename", "storage_path", *_DOC, _AT("uploaded_at"), "uploaded_by"))


def _json(name: str, view: str, table: Query, columns: tuple[str, ...], times: tuple[str, ...] = ()) -> None:
    """The client's JSON of every row of a table, with the names that it gives the columns."""
    packed = ", ".join([f"{S.camel(c)} := {'CAST(details AS JSON)' if c == 'details' else c}" for c in columns] + [f"{S.camel(c)} := strftime({c}, '%Y-%m-%d %H:%M:%S')" for c in times])
    shown = lambda s, d: table(s, d).select(*[F.parse_json(c).alias(c) if c == "details" else F.col(c) for c in columns], *[_AT(c) for c in times])
    register(name, f"SELECT id, CAST(to_json(struct_pack({packed})) AS VARCHAR) AS body FROM {view}", lambda s, d: (df := shown(s, d)).select("id", S.response_json(df, *df.columns).alias("body")))


_json("json_cases", "cases", cases, _CASE, ("created_at", "updated_at"))
_json("json_sales_orders", "sales_orders", sales_orders, ("id", "case_id", "so_number", "so_month"), ("created_at", "updated_at"))
_json("json_documents", "doc_files", doc_files, ("id", "case_id", "sales_order_id", "document_type", "filename", "original_filename", "reference_number", "storage_path", "file_size", "rotation", "uploaded_by"), ("uploaded_at",))
_json("json_audit_logs", "audit_logs", audit_logs, ("id", "case_id", "document_id", "sales_order_id", "action", "actor", "details"), ("created_at",))

# Scalars, over whole tables.
register(
    "input_trim", "SELECT id, n, trim(raw, ' ' || chr(9)) AS name, nullif(trim(raw, ' ' || chr(9)), '') AS notes FROM (SELECT id, 0 AS n, '  ' || customer_name || chr(9) AS raw FROM cases UNION ALL SELECT id, 1, ' ' FROM cases)",
    lambda s, d: cases(s, d).select("id", F.posexplode(F.array(F.concat(F.lit("  "), F.col("customer_name"), F.lit("\t")), F.lit(" "))).alias("n", "raw")).select("id", "n", S.strip(F.col("raw")).alias("name"), S.optional(F.col("raw")).alias("notes")),
)
register(
    "normalize_opp",
    r"""SELECT id, n, CASE WHEN raw = '' THEN raw WHEN regexp_full_match(v, '\d+') THEN 'SKY-' || v WHEN regexp_full_match(v, 'SKY\d+') THEN 'SKY-' || substr(v, 4) ELSE v END AS normalized
    FROM (SELECT id, n, raw, upper(trim(raw, ' ' || chr(9))) AS v FROM (SELECT id, 0 AS n, CAST(id AS VARCHAR) AS raw FROM cases UNION ALL SELECT id, 1, ' sky' || CAST(id AS VARCHAR) || chr(9) FROM cases
      UNION ALL SELECT id, 2, lower(opportunity_id) FROM cases UNION ALL SELECT id, 3, 'opp-' || CAST(id AS VARCHAR) FROM cases UNION ALL SELECT id, 4, '' FROM cases))""",
    lambda s, d: cases(s, d).select("id", F.posexplode(F.array(F.col("id").cast("string"), F.concat(F.lit(" sky"), F.col("id").cast("string"), F.lit("\t")), F.lower("opportunity_id"), F.concat(F.lit("opp-"), F.col("id").cast("string")), F.lit(""))).alias("n", "_raw")).select("id", "n", S.normalize_opportunity(F.col("_raw")).alias("normalized")),
)
register(
    "normalize_filename", r"SELECT checksum, regexp_extract(replace('a b/c\' || original_filename, ' ', '_'), '[^/\\]*$') AS name FROM doc_files",
    lambda s, d: doc_files(s, d).select("checksum", S.normalize_filename(F.concat(F.lit("a b/c\\"), F.col("original_filename"))).alias("name")),
)
register("stored_filename", "SELECT checksum, substr(md5(checksum), 1, 8) || '_' || replace(original_filename, ' ', '_') AS name FROM doc_files", lambda s, d: doc_files(s, d).select("checksum", S.stored_filename(F.col("checksum"), F.col("original_filename")).alias("name")))
register("file_checksum", "SELECT doc_id, sha256(text) AS checksum, CAST(octet_length(encode(text)) AS BIGINT) AS file_size FROM documents", lambda s, d: raw(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.octet_length("text").cast("long").alias("file_size")))
register("rotation_mod", "SELECT checksum, CAST((coalesce(rotation, 0) + 90) % 360 AS INTEGER) AS rotation FROM doc_files", lambda s, d: doc_files(s, d).select("checksum", S.rotated(F.col("rotation"), F.lit(90)).cast("int").alias("rotation")))


def _with_case(s: SparkSession, d: str) -> DataFrame:
    return sales_orders(s, d).join(cases(s, d).select(F.col("id").alias("_case"), F.col("case_id").alias("case_key")), F.col("case_id") == F.col("_case"), "left")


register(
    "folder_path", "SELECT s.id, '/nas/cases/' || c.case_id || '/' || so_month || '/SO-' || so_number AS folder_path FROM sales_orders s LEFT JOIN cases c ON s.case_id = c.id",
    lambda s, d: _with_case(s, d).select("id", S.folder_path(F.col("case_key"), F.col("so_month"), F.col("so_number")).alias("folder_path")),
)
register(
    "storage_path",
    f"""SELECT d.checksum, '{BASE}/' || c.case_id || '/' || so_month || '/SO-' || so_number || '/' || document_type || '/' || replace(original_filename, ' ', '_') AS storage_path
    FROM doc_files d LEFT JOIN sales_orders s ON d.sales_order_id = s.id LEFT JOIN cases c ON s.case_id = c.id""",
    lambda s, d: doc_files(s, d).join(_with_case(s, d).select(F.col("id").alias("_so"), "case_key", "so_month", "so_number"), F.col("sales_order_id") == F.col("_so"), "left")
    .select("checksum", S.storage_path(F.lit(BASE), F.col("case_key"), F.col("so_month"), F.col("so_number"), F.col("document_type"), F.replace("original_filename", F.lit(" "), F.lit("_"))).alias("storage_path")),
)
register(
    "valid_month", r"SELECT id, n, regexp_full_match(m, '\d{4}-\d{2}') AND coalesce(TRY_CAST(substr(m, 6, 2) AS INTEGER) BETWEEN 1 AND 12, false) AS ok FROM (SELECT id, 0 AS n, so_month AS m FROM sales_orders UNION ALL SELECT id, 1, substr(so_month, 1, 5) || '13' FROM sales_orders UNION ALL SELECT id, 2, substr(so_month, 1, 6) FROM sales_orders)",
    lambda s, d: sales_orders(s, d).select("id", F.posexplode(F.array(F.col("so_month"), F.concat(F.substring("so_month", 1, 5), F.lit("13")), F.substring("so_month", 1, 6))).alias("n", "_m")).select("id", "n", S.is_month(F.col("_m")).alias("ok")),
)
register("month_label", "SELECT id, strftime(CAST(so_month || '-01' AS DATE), '%b %Y') AS short, strftime(CAST(so_month || '-01' AS DATE), '%B %Y') AS long FROM sales_orders", lambda s, d: sales_orders(s, d).select("id", S.month_label(F.col("so_month")).alias("short"), S.month_label(F.col("so_month"), True).alias("long")))
register("month_compose", "SELECT id, so_month AS month FROM sales_orders", lambda s, d: sales_orders(s, d).select("id", S.month_of(F.year("created_at"), F.month("created_at")).alias("month")))
register(
    "file_size_label", "SELECT checksum, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1)) ELSE printf('%.1f MB', round(b / 1048576.0, 1)) END AS label, printf('%.1f KB', round(file_size / 1024.0, 1)) AS kb FROM (SELECT checksum, file_size, CAST(file_size AS BIGINT) * (rotation // 90) * 16 AS b FROM doc_files)",
    lambda s, d: doc_files(s, d).select("checksum", S.size_label(F.col("file_size").cast("long") * (F.col("rotation") / 90).cast("long") * 16).alias("label"), S.kilobytes_label(F.col("file_size")).alias("kb")),
)
register("date_label", "SELECT id, strftime(created_at, '%b %-d, %Y') AS date, strftime(created_at, '%b %-d, %I:%M %p') AS time FROM audit_logs", lambda s, d: audit_logs(s, d).select("id", S.date_label(F.col("created_at")).alias("date"), S.datetime_label(F.col("created_at")).alias("time")))


def _map_sql(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


register("type_label", f"SELECT checksum, {_map_sql('document_type', S.TYPE_LABELS)} AS label, {_map_sql('document_type', S.TYPE_CODES)} AS code FROM doc_files", lambda s, d: doc_files(s, d).select("checksum", S.type_label(F.col("document_type")).alias("label"), S.type_code(F.col("document_type")).alias("code")))
register("so_short", "SELECT id, right(so_number, 6) AS short FROM sales_orders", lambda s, d: sales_orders(s, d).select("id", S.short_number(F.col("so_number")).alias("short")))
register("audit_details_preview", "SELECT id, substr(details, 1, 100) AS preview FROM audit_logs", lambda s, d: audit_logs(s, d).select("id", S.details_preview(F.col("details")).alias("preview")))
register("audit_json_field", "SELECT id, json_extract_string(details, '$.k') AS k FROM audit_logs", lambda s, d: audit_logs(s, d).select("id", F.get_json_object("details", "$.k").alias("k")))
register(
    "action_class", "SELECT id, n, CASE WHEN contains(a, 'CREATED') THEN 'created' WHEN contains(a, 'DELETED') THEN 'deleted' WHEN contains(a, 'UPDATED') OR contains(a, 'ROTATED') THEN 'changed' ELSE 'other' END AS class FROM (SELECT id, 0 AS n, action AS a FROM audit_logs UNION ALL SELECT id, 1, replace(replace(action, 'CLICK', 'CREATED'), 'VIEW', 'ROTATED') FROM audit_logs)",
    lambda s, d: audit_logs(s, d).select("id", F.posexplode(F.array(F.col("action"), F.replace(F.replace("action", F.lit("CLICK"), F.lit("CREATED")), F.lit("VIEW"), F.lit("ROTATED")))).alias("n", "_a")).select("id", "n", S.action_class(F.col("_a")).alias("class")),
)
register("status_class", "SELECT id, CASE WHEN status = 'OPEN' THEN 'green' WHEN status = 'IN_PROGRESS' THEN 'yellow' ELSE 'gray' END AS class FROM cases", lambda s, d: cases(s, d).select("id", S.status_class(F.col("status")).alias("class")))
register("next_case_id", f"SELECT 'CASE-{YEAR}-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS case_id FROM (SELECT max(CAST(split_part(case_id, '-', 3) AS INTEGER)) + 1 AS n FROM cases WHERE case_id LIKE 'CASE-{YEAR}-%')", lambda s, d: A.next_case_id(cases(s, d), YEAR))

# Aggregates.
_SINCE = f"TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
_MB = "coalesce(round_even(CAST(sum(file_size) AS DOUBLE) / 1048576, 2), 0)"
_STATUS = "count(*) AS total, count(*) FILTER (status = 'OPEN') AS open_cases, count(*) FILTER (status = 'IN_PROGRESS') AS in_progress_cases, count(*) FILTER (status = 'CLOSED') AS closed_cases"
register("stats_totals", "SELECT (SELECT count(*) FROM cases) AS total_cases, (SELECT count(*) FROM sales_orders) AS total_sales_orders, (SELECT count(*) FROM doc_files) AS total_documents", lambda s, d: A.totals(cases(s, d), sales_orders(s, d), doc_files(s, d)))
register("stats_case_status", f"SELECT {_STATUS} FROM cases", lambda s, d: A.case_status(cases(s, d)))
register("docs_by_type", "SELECT document_type, count(*) AS n FROM doc_files GROUP BY 1", lambda s, d: A.by_type(doc_files(s, d)))
register("docs_type_share", "SELECT document_type, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS share FROM doc_files GROUP BY 1", lambda s, d: A.type_share(doc_files(s, d)))
register("storage_total", f"SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_bytes, {_MB} AS total_mb FROM doc_files", lambda s, d: A.storage(doc_files(s, d)))
register("recent_uploads", f"SELECT count(*) FILTER (uploaded_at >= {_SINCE}) AS recent_uploads FROM doc_files", lambda s, d: A.recent_uploads(doc_files(s, d), AS_OF))
register("audit_count", "SELECT count(*) AS n FROM audit_logs WHERE action = 'DOCUMENT_CLICK' AND actor ILIKE '%USER_1%'", lambda s, d: L.audit_filtered(audit_logs(s, d), action="DOCUMENT_CLICK", actor="USER_1").agg(F.count("*").alias("n")))
register("available_months", "SELECT DISTINCT so_month FROM sales_orders ORDER BY 1", lambda s, d: A.months(sales_orders(s, d)))
register("so_month_counts", "SELECT count(*) FILTER (so_month = '1996-03') AS shown, count(*) AS total FROM sales_orders WHERE case_id = 42", lambda s, d: A.month_counts(sales_orders(s, d), 42, "1996-03"))
_TYPES = ", ".join(f"count(*) FILTER (document_type = '{t}') AS n_{t.lower()}" for t in DOCUMENT_TYPES)
register(
    "stats_overview", f"SELECT * FROM (SELECT {_STATUS} FROM cases), (SELECT count(*) AS total_sales_orders FROM sales_orders), (SELECT count(*) AS total_documents, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_bytes, count(*) FILTER (uploaded_at >= {_SINCE}) AS recent_uploads, {_TYPES}, {_MB} AS total_mb FROM doc_files)",
    lambda s, d: A.overview(cases(s, d), sales_orders(s, d), doc_files(s, d), AS_OF),
)

# Filters, lookups and searches.
_SO, _SO_COLS = "id, case_id, so_number, so_month", ("id", "case_id", "so_number", "so_month")
register("case_by_key", f"SELECT {', '.join(_CASE)} FROM cases WHERE case_id = 'CASE-2026-0042'", lambda s, d: L.by_key(cases(s, d), "case_id", "CASE-2026-0042").select(*_CASE))
register("case_by_id", f"SELECT {', '.join(_CASE)} FROM cases WHERE id = 42", lambda s, d: L.by_key(cases(s, d), "id", 42).select(*_CASE))
register("case_by_opportunity", f"SELECT {', '.join(_CASE)} FROM cases WHERE opportunity_id = 'SKY-42'", lambda s, d: L.case_by_opportunity(cases(s, d), " sky42").select(*_CASE))
register("so_by_id", f"SELECT {_SO} FROM sales_orders WHERE id = 77", lambda s, d: L.by_key(sales_orders(s, d), "id", 77).select(*_SO_COLS))
register("so_by_number", f"SELECT {_SO} FROM sales_orders WHERE so_number = '10TM0000000077'", lambda s, d: L.by_key(sales_orders(s, d), "so_number", "10TM0000000077").select(*_SO_COLS))
_FIRST = "SELECT min(id) AS c FROM doc_files"
register("document_by_id", f"SELECT id, filename, storage_path, {', '.join(_DOC)}, checksum FROM doc_files WHERE id = ({_FIRST})", lambda s, d: doc_files(s, d).where(F.col("id") == doc_keys(s, d).agg(F.min("id")).scalar()).select("id", "filename", "storage_path", *_DOC, "checksum"))
register("search_opportunity", f"SELECT {', '.join(_CASE)} FROM cases WHERE opportunity_id ILIKE '%ky-1%' ORDER BY opportunity_id LIMIT 20", lambda s, d: L.global_search(cases(s, d), sales_orders(s, d), "ky-1", "opportunity").select(*_CASE))
register("search_so_global", f"SELECT {_SO} FROM sales_orders WHERE so_number ILIKE '%tm%12%' ORDER BY so_number LIMIT 20", lambda s, d: L.global_search(cases(s, d), sales_orders(s, d), "tm%12", "sales_order").select(*_SO_COLS))
register("search_unknown_type", f"SELECT {', '.join(_CASE)} FROM cases WHERE false", lambda s, d: L.global_search(cases(s, d), sales_orders(s, d), "x", "other").select(*_CASE))
register("search_cases_any", f"SELECT {', '.join(_CASE)} FROM cases WHERE opportunity_id ILIKE '%99%' OR customer_name ILIKE '%99%' OR case_id ILIKE '%99%' ORDER BY case_id LIMIT 20", lambda s, d: L.search(cases(s, d), ("opportunity_id", "customer_name", "case_id"), "99", "case_id").select(*_CASE))
register("so_for_case", f"SELECT {_SO} FROM sales_orders WHERE case_id = 42 ORDER BY so_month, so_number", lambda s, d: L.orders_of_case(sales_orders(s, d), 42).select(*_SO_COLS))
register("so_sidebar_search", f"SELECT {_SO} FROM sales_orders WHERE contains(lower(so_number), '10tm00000001')", lambda s, d: L.sidebar_search(sales_orders(s, d), "10TM00000001").select(*_SO_COLS))
_LOG, _LOG_COLS = f"id, case_id, action, actor, details, {_AT_SQL('created_at')}", ("id", "case_id", "action", "actor", "details")
register("audit_by_actor", f"SELECT {_LOG} FROM audit_logs WHERE actor ILIKE '%SER_1%'", lambda s, d: L.audit_filtered(audit_logs(s, d), actor="SER_1").select(*_LOG_COLS, _AT("created_at")))
register("audit_filtered", f"SELECT {_LOG} FROM audit_logs WHERE case_id = 7 AND action = 'DOCUMENT_VIEW'", lambda s, d: L.audit_filtered(audit_logs(s, d), 7, "DOCUMENT_VIEW", "").select(*_LOG_COLS, _AT("created_at")))
_DOC_AT = f"{', '.join(_DOC)}, checksum, {_AT_SQL('uploaded_at')}"
register("docs_for_case", f"SELECT {_DOC_AT} FROM doc_files WHERE case_id = 42", lambda s, d: L.documents_of_case(doc_files(s, d), sales_orders(s, d), 42).select(*_DOC, "checksum", _AT("uploaded_at")))

# Joins and checklists.
_LIST = lambda types: f"id, case_id, so_number, so_month, document_count, {', '.join(f'has_{t.lower()}' for t in types)}"
_LIST_COLS = lambda types: ("id", "case_id", "so_number", "so_month", "document_count", *[f"has_{t.lower()}" for t in types])
register("so_with_checklist", f"SELECT {_LIST(ORDER_TYPES)} FROM ({listed(ORDER_TYPES)})", lambda s, d: K.with_checklist(sales_orders(s, d), doc_files(s, d)).select(*_LIST_COLS(ORDER_TYPES)))
register("so_type_set", "SELECT sales_order_id, string_agg(DISTINCT document_type, ',' ORDER BY document_type) AS types FROM doc_files WHERE sales_order_id IS NOT NULL GROUP BY 1", lambda s, d: K.type_set(doc_files(s, d)))
_DONE = " + ".join(f"CAST(has_{t.lower()} AS INTEGER)" for t in DOCUMENT_TYPES)
register("so_completion", f"SELECT id, so_number, {_DONE} AS completed, 6 AS total, {_DONE} = 6 AS is_complete FROM ({listed(DOCUMENT_TYPES)})", lambda s, d: K.completion(K.with_checklist(sales_orders(s, d), doc_files(s, d), DOCUMENT_TYPES), DOCUMENT_TYPES))
register("checklist_unpivot", " UNION ALL ".join(f"SELECT id, '{t}' AS document_type, has_{t.lower()} AS present FROM ({listed(ORDER_TYPES)})" for t in ORDER_TYPES), lambda s, d: K.unpivoted(K.with_checklist(sales_orders(s, d), doc_files(s, d)), ORDER_TYPES))
_SEARCH = f"""SELECT {_LIST(DOCUMENT_TYPES).replace('id, case_id', 'l.id, l.case_id', 1)}, c.case_id AS case_key, opportunity_id, customer_name, '/nas/cases/' || c.case_id || '/' || so_month || '/SO-' || so_number AS folder_path
FROM ({listed(DOCUMENT_TYPES)}) l LEFT JOIN cases c ON l.case_id = c.id WHERE so_number ILIKE '%123%' ORDER BY so_number LIMIT """
register("so_search", _SEARCH + "20", lambda s, d: K.order_search(sales_orders(s, d), cases(s, d), doc_files(s, d), "123"))
register("so_search_first", _SEARCH + "1", lambda s, d: K.order_search(sales_orders(s, d), cases(s, d), doc_files(s, d), "123", 1))
register("so_docs_of_type", f"SELECT {', '.join(_DOC)}, checksum FROM doc_files WHERE sales_order_id IS NOT NULL AND document_type = 'POD'", lambda s, d: doc_files(s, d).where("sales_order_id is not null and document_type = 'POD'").select(*_DOC, "checksum"))
register("case_customer_po", "SELECT c.id, c.case_id, min(checksum) AS po_checksum FROM cases c LEFT JOIN doc_files d ON d.case_id = c.id AND document_type = 'CUSTOMER_PO' GROUP BY 1, 2", lambda s, d: K.customer_po(cases(s, d), doc_files(s, d)))
register("docs_for_case_month", f"SELECT {_DOC_AT} FROM doc_files WHERE case_id = 42 AND (sales_order_id IN (SELECT id FROM sales_orders WHERE case_id = 42 AND so_month = (SELECT max(so_month) FROM sales_orders WHERE case_id = 42)) OR document_type = 'CUSTOMER_PO')", lambda s, d: _docs_last_month(s, d))
register("docs_by_case_key", f"SELECT {', '.join(f'd.{c}' for c in _DOC)}, checksum FROM doc_files d JOIN cases c ON d.case_id = c.id WHERE c.case_id = 'CASE-2026-0042'", lambda s, d: L.documents_by_case_key(doc_files(s, d), cases(s, d), "CASE-2026-0042").select(*_DOC, "checksum"))
register(
    "case_detail", f"""SELECT c.id, c.case_id, opportunity_id, customer_name, case_type, status, (SELECT min(checksum) FROM doc_files p WHERE p.case_id = c.id AND document_type = 'CUSTOMER_PO') AS po_checksum,
    l.id AS so_id, so_number, so_month, document_count, {', '.join(f'has_{t.lower()}' for t in ORDER_TYPES)} FROM cases c LEFT JOIN ({listed(ORDER_TYPES)}) l ON l.case_id = c.id""",
    lambda s, d: K.case_detail(cases(s, d), sales_orders(s, d), doc_files(s, d)),
)
register(
    "document_table", f"SELECT checksum, {_map_sql('document_type', S.TYPE_LABELS)} AS type, original_filename, coalesce(nullif(reference_number, ''), '-') AS reference, CASE WHEN file_size < 1024 THEN CAST(file_size AS VARCHAR) || ' B' WHEN file_size < 1048576 THEN printf('%.1f KB', round(file_size / 1024.0, 1)) ELSE printf('%.1f MB', round(file_size / 1048576.0, 1)) END AS size, strftime(uploaded_at, '%b %-d, %Y') AS uploaded FROM doc_files",
    lambda s, d: doc_files(s, d).select("checksum", S.type_label(F.col("document_type")).alias("type"), "original_filename", F.coalesce(F.nullif(F.col("reference_number"), F.lit("")), F.lit("-")).alias("reference"), S.size_label(F.col("file_size")).alias("size"), S.date_label(F.col("uploaded_at")).alias("uploaded")),
)


def _docs_last_month(s: SparkSession, d: str) -> DataFrame:
    """The documents of a case in its last month."""
    month = sales_orders(s, d).where("case_id = 42").agg(F.max("so_month").alias("so_month"))
    return L.documents_of_months(doc_files(s, d), sales_orders(s, d), 42, month).select(*_DOC, "checksum", _AT("uploaded_at"))


# Pages.
register("audit_page", f"SELECT {_LOG.replace('AS created_at', 'AS created_at')} FROM (SELECT * FROM audit_logs ORDER BY audit_logs.created_at DESC, id DESC LIMIT 50 OFFSET 100)", lambda s, d: P.audit_page(audit_logs(s, d), 50, 100).select(*_LOG_COLS, _AT("created_at")))
register("audit_page_window", "SELECT count(*) AS total, CAST(101 AS BIGINT) AS first, least(150, count(*)) AS last, true AS has_previous, 150 < count(*) AS has_next FROM audit_logs", lambda s, d: P.page_window(audit_logs(s, d), 50, 100))
_ENTRY = "id := id, case_id := case_id, document_id := document_id, sales_order_id := sales_order_id, action := action, actor := actor, details := CAST(details AS JSON), created_at := strftime(created_at, '%Y-%m-%d %H:%M:%S')"
register(
    "audit_envelope", f"""SELECT (SELECT count(*) FROM audit_logs) AS total, 50 AS "limit", 100 AS "offset", CAST(to_json(list(struct_pack({_ENTRY}) ORDER BY created_at DESC, id DESC)) AS VARCHAR) AS logs
    FROM (SELECT * FROM audit_logs ORDER BY audit_logs.created_at DESC, id DESC LIMIT 50 OFFSET 100)""",
    lambda s, d: P.envelope(audit_logs(s, d).select("id", "case_id", "document_id", "sales_order_id", "action", "actor", "details", "created_at"), 50, 100).withColumn("logs", F.to_json(F.transform("logs", lambda x: x.withField("details", F.parse_json(x["details"])).withField("created_at", F.date_format(x["created_at"], "yyyy-MM-dd HH:mm:ss"))), {"ignoreNullFields": "false"})),
)

# Integrity and commands. Batches are made from the tables, so that they grow with them.
register("duplicate_files", "SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", lambda s, d: raw(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("checksum")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1"))
register(
    "so_case_mismatch", "SELECT d.checksum FROM doc_files d JOIN sales_orders s ON s.id = d.sales_order_id WHERE s.case_id <> d.case_id + CASE WHEN d.rotation = 180 THEN 1 ELSE 0 END",
    lambda s, d: order_files(s, d).withColumn("_claimed", F.col("case_id") + F.when(F.col("rotation") == 180, 1).otherwise(0)).join(sales_orders(s, d).select(F.col("id").alias("_so"), F.col("case_id").alias("_owner")), F.col("sales_order_id") == F.col("_so")).where("_owner <> _claimed").select("checksum"),
)
register("orphans_check", "SELECT (SELECT count(*) FROM sales_orders s WHERE NOT EXISTS (SELECT 1 FROM cases c WHERE c.id = s.case_id)) AS orders_without_case, (SELECT count(*) FROM doc_files d WHERE sales_order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sales_orders s WHERE s.id = d.sales_order_id)) AS documents_without_order", lambda s, d: C.orphans(sales_orders(s, d), doc_files(s, d), cases(s, d)))


def _cascade(s: SparkSession, d: str) -> DataFrame:
    orders, documents = C.cascade(sales_orders(s, d), doc_files(s, d), cases(s, d).where("status = 'CLOSED'"))
    return orders.groupBy("case_id").agg(F.count("*").alias("orders")).join(documents.groupBy("case_id").agg(F.count("*").alias("documents")), "case_id", "full")


register("cascade_delete", "SELECT coalesce(o.case_id, d.case_id) AS case_id, orders, documents FROM (SELECT case_id, count(*) AS orders FROM sales_orders WHERE case_id NOT IN (SELECT id FROM cases WHERE status = 'CLOSED') GROUP BY 1) o FULL JOIN (SELECT case_id, count(*) AS documents FROM doc_files WHERE case_id NOT IN (SELECT id FROM cases WHERE status = 'CLOSED') GROUP BY 1) d ON o.case_id = d.case_id", _cascade)
register("audit_set_null", "SELECT id, CASE WHEN case_id IN (SELECT id FROM cases WHERE status = 'CLOSED') THEN NULL ELSE case_id END AS case_id, action FROM audit_logs", lambda s, d: C.set_null(audit_logs(s, d), cases(s, d).where("status = 'CLOSED'")).select("id", "case_id", "action"))


def _new_cases(s: SparkSession, d: str) -> DataFrame:
    """A request per supplier: every third repeats an opportunity that exists, every fifth one of the batch."""
    key = F.col("s_suppkey")
    opportunity = F.when(key % 3 == 0, F.concat(F.lit("sky"), (key % 10).cast("string"))).when(key % 5 == 0, F.lit("SKY-900000001")).otherwise(F.concat(F.lit("SKY-8"), F.lpad(key.cast("string"), 8, "0")))
    batch = raw(s, d, "supplier").select(key.alias("seq"), opportunity.alias("opportunity_id"), F.col("s_name").alias("customer_name"), F.when(key % 7 == 0, "OTHER").otherwise("HARDWARE").alias("case_type"))
    return C.create_cases(cases(s, d), batch, YEAR)


_NEW_CASES = f"""b AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 3 = 0 THEN 'SKY-' || CAST(s_suppkey % 10 AS VARCHAR) WHEN s_suppkey % 5 = 0 THEN 'SKY-900000001' ELSE 'SKY-8' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS normalized, CASE WHEN s_suppkey % 7 = 0 THEN 'OTHER' ELSE 'HARDWARE' END AS case_type FROM supplier),
r1 AS (SELECT *, CASE WHEN case_type = 'OTHER' THEN 'case_type' WHEN normalized IN (SELECT opportunity_id FROM cases) THEN 'opportunity exists' END AS r FROM b),
r2 AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY normalized, r IS NULL ORDER BY seq) > 1 THEN 'opportunity exists' ELSE r END AS reject_reason FROM r1),
n AS (SELECT *, CASE WHEN reject_reason IS NULL THEN (SELECT max(id) FROM cases) + row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY seq) END AS number FROM r2)
SELECT seq, normalized, reject_reason, 'CASE-{YEAR}-' || CASE WHEN number < 10000 THEN lpad(CAST(number AS VARCHAR), 4, '0') ELSE CAST(number AS VARCHAR) END AS case_id FROM n"""
register("cmd_create_cases", "", lambda s, d: _new_cases(s, d).select("seq", "normalized", "reject_reason", "case_id"))
SQL["cmd_create_cases"] = f"WITH {VIEWS}, {_NEW_CASES}"


def _new_orders(s: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    number = F.when(key % 4 == 0, F.concat(F.lit("10TM"), F.lpad(key.cast("string"), 10, "0"))).otherwise(F.concat(F.lit("NEW-"), F.floor(key / 2).cast("string")))
    month = F.when(key % 9 == 0, "2026-13").otherwise("2026-01")
    batch = raw(s, d, "part").select(key.alias("seq"), F.when(key % 11 == 0, F.lit(-1)).otherwise(key % 100).cast("long").alias("case_id"), number.alias("so_number"), month.alias("so_month"))
    return C.create_sales_orders(cases(s, d), sales_orders(s, d), batch)


register("cmd_create_sales_orders", "", lambda s, d: _new_orders(s, d).select("seq", "so_number", "reject_reason"))
SQL["cmd_create_sales_orders"] = f"""WITH {VIEWS}, b AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey % 100 END AS case_id, CASE WHEN p_partkey % 4 = 0 THEN '10TM' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') ELSE 'NEW-' || CAST(p_partkey // 2 AS VARCHAR) END AS so_number, p_partkey % 9 = 0 AS bad FROM part),
r AS (SELECT seq, so_number, CASE WHEN bad THEN 'so_month' WHEN so_number IN (SELECT so_number FROM sales_orders) THEN 'sales order exists' WHEN case_id NOT IN (SELECT id FROM cases) THEN 'case not found' END AS r FROM b)
SELECT seq, so_number, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY so_number, r IS NULL ORDER BY seq) > 1 THEN 'sales order exists' ELSE r END AS reject_reason FROM r"""


def _uploads(s: SparkSession, d: str) -> DataFrame:
    """A request per event: some for no case, no order, another case's order, with a file that is there or repeated."""
    key = F.col("event_id")
    checksum = F.when(key % 6 == 0, F.lit("same")).otherwise(F.sha2(key.cast("string"), 256))
    batch = raw(s, d, "events").select(key.alias("seq"), F.when(key % 13 == 0, F.lit(-5)).otherwise(F.col("user_id")).cast("long").alias("case_id"), F.when(key % 5 != 0, key % 1000).alias("sales_order_id"), F.when(key % 17 == 0, "a.txt").otherwise("a.PDF").alias("original_filename"), checksum.alias("checksum"))
    return C.upload_documents(cases(s, d), sales_orders(s, d), doc_files(s, d), batch)


register("cmd_upload_documents", "", lambda s, d: _uploads(s, d).select("seq", "reject_reason"))
SQL["cmd_upload_documents"] = f"""WITH {VIEWS}, b AS (SELECT event_id AS seq, CASE WHEN event_id % 13 = 0 THEN -5 ELSE user_id END AS case_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 1000 END AS so, event_id % 17 = 0 AS txt, CASE WHEN event_id % 6 = 0 THEN 'same' ELSE sha256(CAST(event_id AS VARCHAR)) END AS checksum FROM events),
r AS (SELECT b.*, CASE WHEN txt THEN 'not a PDF' WHEN c.id IS NULL THEN 'case not found' WHEN so IS NULL THEN 'sales order required' WHEN s.id IS NULL THEN 'sales order not found' WHEN s.case_id <> b.case_id THEN 'sales order of another case' WHEN EXISTS (SELECT 1 FROM doc_files f WHERE f.case_id = b.case_id AND f.checksum = b.checksum) THEN 'duplicate file' END AS r
  FROM b LEFT JOIN cases c ON c.id = b.case_id LEFT JOIN sales_orders s ON s.id = so)
SELECT seq, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY case_id, checksum, r IS NULL ORDER BY seq) > 1 THEN 'duplicate file' ELSE r END AS reject_reason FROM r"""

register(
    "upload_acknowledgement", "", lambda s, d: C.acknowledged(_uploads(s, d).withColumn("document_type", F.lit("POD")), sales_orders(s, d), cases(s, d), BASE),
)
SQL["upload_acknowledgement"] = f"""{SQL["cmd_upload_documents"].rpartition("SELECT seq, CASE")[0]}, a AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY case_id, checksum, r IS NULL ORDER BY seq) > 1 THEN 'duplicate file' ELSE r END AS reason FROM r)
SELECT seq, 'Document uploaded successfully' AS message, substr(md5(a.checksum), 1, 8) || '_a.PDF' AS filename, '{BASE}/' || c.case_id || '/' || s.so_month || '/SO-' || s.so_number || '/POD/' || substr(md5(a.checksum), 1, 8) || '_a.PDF' AS storage_path, a.checksum
FROM a JOIN sales_orders s ON s.id = a.so JOIN cases c ON c.id = a.case_id WHERE reason IS NULL"""


def _patches(s: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    fields = F.when(key % 4 == 0, F.array(F.lit("status"))).when(key % 4 == 1, F.array(F.lit("customer_name"))).otherwise(F.array(F.lit("notes"), F.lit("case_type")))
    batch = raw(s, d, "supplier").select(
        key.alias("id"), fields.alias("set"), F.when(key % 8 != 1, F.col("s_name")).alias("customer_name"), F.when(key % 5 == 0, "OTHER").otherwise("SERVICES").alias("case_type"), F.when(key % 8 != 0, F.when(key % 12 == 0, "LOST").otherwise("CLOSED")).alias("status"), F.lit("note").alias("notes")
    )
    return C.update_cases(cases(s, d), batch)


register("cmd_update_cases", "", _patches)
SQL["cmd_update_cases"] = f"""WITH {VIEWS}, b AS (SELECT s_suppkey AS k, s_suppkey % 4 = 0 AS set_status, s_suppkey % 4 = 1 AS set_name, s_suppkey % 4 > 1 AS set_rest, CASE WHEN s_suppkey % 8 <> 1 THEN s_name END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'OTHER' ELSE 'SERVICES' END AS kind, CASE WHEN s_suppkey % 8 <> 0 THEN CASE WHEN s_suppkey % 12 = 0 THEN 'LOST' ELSE 'CLOSED' END END AS st FROM supplier),
r AS (SELECT b.*, c.customer_name, c.case_type, c.status, c.notes, CASE WHEN c.id IS NULL THEN 'case not found' WHEN set_name AND name IS NULL THEN 'customer_name' WHEN set_rest AND kind = 'OTHER' THEN 'case_type' WHEN set_status AND st = 'LOST' THEN 'status' END AS reject_reason FROM b LEFT JOIN cases c ON c.id = k)
SELECT k AS id, reject_reason, CASE WHEN set_name AND reject_reason IS NULL THEN name ELSE customer_name END AS new_customer_name, CASE WHEN set_rest AND reject_reason IS NULL THEN kind ELSE case_type END AS new_case_type, CASE WHEN set_status AND reject_reason IS NULL THEN st ELSE status END AS new_status, CASE WHEN set_rest AND reject_reason IS NULL THEN 'note' ELSE notes END AS new_notes FROM r"""
register(
    "cmd_rotate_documents", "SELECT id, n, CASE WHEN deg NOT IN (0, 90, 180, 270) THEN 'rotation' END AS reject_reason FROM (SELECT id, unnest([0, 1]) AS n, unnest([90, file_size % 100]) AS deg FROM doc_files)",
    lambda s, d: C.judged_turns(doc_files(s, d).select("id", F.posexplode(F.array(F.lit(90), F.col("file_size") % 100)).alias("n", "degrees"))).select("id", "n", "reject_reason"),
)
register("cmd_delete_documents", "SELECT checksum FROM doc_files WHERE NOT (document_type = 'POD' AND rotation = 180)", lambda s, d: C.delete(doc_files(s, d), doc_files(s, d).where("document_type = 'POD' and rotation = 180").select("checksum"), "checksum").select("checksum"))

# Queries of other modules register themselves.
from docketry.plans import extended  # noqa: E402

__all__ = ["extended", "oracle_sql", "queries"]
