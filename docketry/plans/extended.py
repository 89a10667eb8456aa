"""Queries of searches through an index, rows that commands make, the audit trail, cascades and nested documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import scalars as S
from docketry.operators import cascade as D
from docketry.operators import checklist as K
from docketry.operators import commands as C
from docketry.operators import nested as N
from docketry.operators.deltas import Statistics
from docketry.operators.paging import PagedLog
from docketry.operators.trigrams import TrigramIndex
from docketry.plans.registry import listed, register
from docketry.sources import clustered
from docketry.sources.store import StoredTable, scratch
from docketry.sources.tables import BASE, CASES, DOCUMENT_TYPES, ORDER_TYPES, audit_logs, cases, doc_files, doc_keys, doc_lines, documents_of, raw, sales_orders

YEAR, AT = 2026, "2026-02-01 00:00:00"
_now = lambda: F.lit(AT).cast("timestamp_ntz")
_TEXT = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
_TEXT_SQL = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"

# Searches through an index, which is built in a scratch folder from the whole table.
_CASE, _SO = ("id", "case_id", "opportunity_id", "customer_name", "case_type", "status", "notes"), ("id", "case_id", "so_number", "so_month")


def _index(s: SparkSession, table: DataFrame, key: str, *fields: str) -> TrigramIndex:
    index = TrigramIndex(s, scratch(s, "trigrams"), key, fields)
    index.add(0, table)
    return index


def _found(s: SparkSession, table: DataFrame, key: str, query: str, *fields: str, limit: int = 20) -> DataFrame:
    return _index(s, table, key, *fields).search(table, query, limit)


register("trigram_opportunity", f"SELECT {', '.join(_CASE)} FROM cases WHERE opportunity_id ILIKE '%ky-12%' ORDER BY opportunity_id LIMIT 20", lambda s, d: _found(s, cases(s, d), "opportunity_id", "ky-12", "opportunity_id").select(*_CASE))
register("trigram_so_global", f"SELECT {', '.join(_SO)} FROM sales_orders WHERE so_number ILIKE '%0tm%012%' ORDER BY so_number LIMIT 20", lambda s, d: _found(s, sales_orders(s, d), "so_number", "0tm%012", "so_number").select(*_SO))
register(
    "trigram_cases_any", f"SELECT {', '.join(_CASE)} FROM cases WHERE opportunity_id ILIKE '%0099%' OR customer_name ILIKE '%0099%' OR case_id ILIKE '%0099%' ORDER BY case_id LIMIT 20",
    lambda s, d: _found(s, cases(s, d), "case_id", "0099", "opportunity_id", "customer_name", "case_id").select(*_CASE),
)
_SEARCHED = f"""SELECT l.id, l.case_id, so_number, so_month, document_count, {', '.join(f'has_{t.lower()}' for t in DOCUMENT_TYPES)}, c.case_id AS case_key, opportunity_id, customer_name, '/nas/cases/' || c.case_id || '/' || so_month || '/SO-' || so_number AS folder_path
FROM ({listed(DOCUMENT_TYPES)}) l LEFT JOIN cases c ON l.case_id = c.id WHERE so_number ILIKE '%1234%' ORDER BY so_number LIMIT 20"""
register("trigram_so_search", _SEARCHED, lambda s, d: K.order_search(sales_orders(s, d), cases(s, d), doc_files(s, d), "1234", hits=_found(s, sales_orders(s, d), "so_number", "1234", "so_number")))
register(
    "trigram_audit_actor", f"SELECT id, case_id, action, actor, {_TEXT_SQL('created_at')} AS created_at FROM audit_logs WHERE actor ILIKE '%SER_10%'",
    lambda s, d: _index(s, audit_logs(s, d), "id", "actor").matching(audit_logs(s, d), "SER_10").select("id", "case_id", "action", "actor", _TEXT("created_at")),
)

# Rows that commands make.


def _case_requests(s: SparkSession, d: str) -> DataFrame:
    """A request per supplier: every third repeats an opportunity that exists, every fifth one of the batch."""
    key = F.col("s_suppkey")
    opportunity = F.when(key % 3 == 0, F.concat(F.lit("sky"), (key % 10).cast("string"))).when(key % 5 == 0, F.lit("SKY-900000001")).otherwise(F.concat(F.lit("SKY-8"), F.lpad(key.cast("string"), 8, "0")))
    name, notes = F.concat(F.lit(" "), F.col("s_name"), F.lit("\t")), F.when(key % 2 == 0, "  ").otherwise(F.concat(F.lit(" note "), key.cast("string")))
    batch = raw(s, d, "supplier").select(key.alias("seq"), opportunity.alias("opportunity_id"), name.alias("customer_name"), F.when(key % 7 == 0, "OTHER").otherwise("HARDWARE").alias("case_type"), notes.alias("notes"))
    return C.create_cases(cases(s, d), C.trimmed(batch), YEAR)


_CASE_REQUESTS = f"""b AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 3 = 0 THEN 'SKY-' || CAST(s_suppkey % 10 AS VARCHAR) WHEN s_suppkey % 5 = 0 THEN 'SKY-900000001' ELSE 'SKY-8' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS opportunity_id,
  s_name AS customer_name, CASE WHEN s_suppkey % 7 = 0 THEN 'OTHER' ELSE 'HARDWARE' END AS case_type, CASE WHEN s_suppkey % 2 <> 0 THEN 'note ' || CAST(s_suppkey AS VARCHAR) END AS notes FROM supplier),
r1 AS (SELECT *, case_type = 'OTHER' OR opportunity_id IN (SELECT opportunity_id FROM cases) AS bad FROM b), r2 AS (SELECT *, row_number() OVER (PARTITION BY opportunity_id, bad ORDER BY seq) AS k FROM r1),
made AS (SELECT *, (SELECT max(id) FROM cases) + row_number() OVER (ORDER BY seq) AS id FROM r2 WHERE NOT bad AND k = 1),
rows AS (SELECT seq, id, 'CASE-{YEAR}-' || CASE WHEN id < 10000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS case_id, opportunity_id, customer_name, case_type, 'OPEN' AS status, notes, '{AT}' AS created_at, '{AT}' AS updated_at FROM made)"""


def _with(ctes: str, select: str) -> str:
    """A statement after the domain tables."""
    return f", {ctes} {select}"


_new_cases = lambda s, d: C.case_rows(_case_requests(s, d), cases(s, d), _now())
register("cmd_insert_cases", _with(_CASE_REQUESTS, "SELECT * FROM rows"), lambda s, d: _new_cases(s, d).withColumns({"created_at": _TEXT("created_at"), "updated_at": _TEXT("updated_at")}))
_TRAIL = "NULL::BIGINT AS document_id, NULL::BIGINT AS sales_order_id"
register("cmd_audit_rows", _with(_CASE_REQUESTS, f"SELECT seq, id AS case_id, {_TRAIL}, 'CASE_CREATED' AS action, 'System' AS actor, CAST(to_json(struct_pack(case_id := case_id, opportunity_id := opportunity_id)) AS VARCHAR) AS details FROM rows"), lambda s, d: C.audit_new_cases(_new_cases(s, d)))


def _order_requests(s: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    number = F.when(key % 4 == 0, F.concat(F.lit("10TM"), F.lpad(key.cast("string"), 10, "0"))).otherwise(F.concat(F.lit("NEW-"), F.floor(key / 2).cast("string")))
    batch = raw(s, d, "part").select(key.alias("seq"), F.when(key % 11 == 0, F.lit(-1)).otherwise(key % 100 + 1).cast("long").alias("case_id"), number.alias("so_number"), F.when(key % 9 == 0, "2026-13").otherwise("2026-01").alias("so_month"))
    return C.create_sales_orders(cases(s, d), sales_orders(s, d), batch)


_ORDER_REQUESTS = f"""b AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey % 100 + 1 END AS case_id, CASE WHEN p_partkey % 4 = 0 THEN '10TM' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') ELSE 'NEW-' || CAST(p_partkey // 2 AS VARCHAR) END AS so_number, p_partkey % 9 = 0 AS odd FROM part),
r AS (SELECT *, odd OR so_number IN (SELECT so_number FROM sales_orders) OR case_id NOT IN (SELECT id FROM cases) AS bad FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY so_number, bad ORDER BY seq) AS k FROM r),
rows AS (SELECT seq, (SELECT max(id) FROM sales_orders) + row_number() OVER (ORDER BY seq) AS id, case_id, so_number, '2026-01' AS so_month, '{AT}' AS created_at, '{AT}' AS updated_at FROM k WHERE NOT bad AND k = 1)"""
_new_orders = lambda s, d: C.order_rows(_order_requests(s, d), sales_orders(s, d), _now())
register("cmd_insert_orders", _with(_ORDER_REQUESTS, "SELECT * FROM rows"), lambda s, d: _new_orders(s, d).withColumns({"created_at": _TEXT("created_at"), "updated_at": _TEXT("updated_at")}))
register("cmd_audit_orders", _with(_ORDER_REQUESTS, "SELECT seq, case_id, NULL::BIGINT AS document_id, id AS sales_order_id, 'SO_CREATED' AS action, 'System' AS actor, CAST(to_json(struct_pack(so_number := so_number, so_month := so_month)) AS VARCHAR) AS details FROM rows"), lambda s, d: C.audit_new_orders(_new_orders(s, d)))


def _filings(s: SparkSession, d: str) -> DataFrame:
    """A request per order, for its case and most of them right, and one that files a document of every fourth kind again."""
    key = F.col("o_orderkey")
    customer = F.when(key % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    checksum = F.when(key % 3 == 0, F.concat(F.lit("dup-"), F.col("o_custkey").cast("string"))).otherwise(F.sha2(key.cast("string"), 256))
    new = raw(s, d, "orders").select(
        (key * 2).alias("seq"), customer.alias("case_id"), F.when(key % 11 != 0, key).alias("sales_order_id"), F.when(key % 2 == 0, "POD").otherwise("VENDOR_DC").alias("document_type"),
        F.when(key % 13 == 0, "scan 1.txt").otherwise("scan 1.PDF").alias("original_filename"), checksum.alias("checksum"), (key % 5000).alias("file_size"), F.when(key % 10 == 0, "me").alias("uploaded_by"),
    )
    again = doc_files(s, d).where("document_type = 'POD'").select((F.col("id") * 2 + 1).alias("seq"), "case_id", "sales_order_id", "document_type", "original_filename", "checksum", F.col("file_size").cast("long").alias("file_size"), F.lit(None).cast("string").alias("uploaded_by"))
    return C.upload_documents(cases(s, d), sales_orders(s, d), doc_files(s, d), new.unionByName(again))


_FILINGS = f"""b AS (SELECT o_orderkey * 2 AS seq, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS case_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS sales_order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'POD' ELSE 'VENDOR_DC' END AS document_type,
  CASE WHEN o_orderkey % 13 = 0 THEN 'scan 1.txt' ELSE 'scan 1.PDF' END AS original_filename, CASE WHEN o_orderkey % 3 = 0 THEN 'dup-' || CAST(o_custkey AS VARCHAR) ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS checksum, o_orderkey % 5000 AS file_size, CASE WHEN o_orderkey % 10 = 0 THEN 'me' END AS uploaded_by FROM orders
  UNION ALL SELECT id * 2 + 1, case_id, sales_order_id, document_type, original_filename, checksum, file_size, NULL FROM doc_files WHERE document_type = 'POD'),
r AS (SELECT b.*, CASE WHEN NOT lower(original_filename) LIKE '%.pdf' THEN 'not a PDF' WHEN c.id IS NULL THEN 'case not found' WHEN sales_order_id IS NULL THEN 'sales order required' WHEN s.id IS NULL THEN 'sales order not found' WHEN s.case_id <> b.case_id THEN 'sales order of another case'
    WHEN f.checksum IS NOT NULL THEN 'duplicate file' END AS why, c.case_id AS case_key, s.so_number, s.so_month
  FROM b LEFT JOIN cases c ON c.id = b.case_id LEFT JOIN sales_orders s ON s.id = sales_order_id LEFT JOIN (SELECT DISTINCT case_id, checksum FROM doc_files) f ON f.case_id = b.case_id AND f.checksum = b.checksum),
judged AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY case_id, checksum, why IS NULL ORDER BY seq) > 1 THEN 'duplicate file' ELSE why END AS reject_reason FROM r),
named AS (SELECT *, (SELECT max(id) FROM doc_files) + row_number() OVER (ORDER BY seq) AS id, substr(md5(CAST(case_id AS VARCHAR) || '-' || checksum), 1, 8) || '_' || replace(original_filename, ' ', '_') AS filename FROM judged WHERE reject_reason IS NULL),
rows AS (SELECT seq, id, case_id, sales_order_id, document_type, filename, original_filename, NULL::VARCHAR AS reference_number, '{BASE}/' || case_key || '/' || so_month || '/SO-' || so_number || '/' || document_type || '/' || filename AS storage_path,
  checksum, CAST(file_size AS INTEGER) AS file_size, 0 AS rotation, '{AT}' AS uploaded_at, coalesce(uploaded_by, 'Anonymous') AS uploaded_by FROM named)"""
_new_documents = lambda s, d: C.document_rows(_filings(s, d), cases(s, d), sales_orders(s, d), doc_keys(s, d), BASE, _now())
register("cmd_judge_uploads", _with(_FILINGS, "SELECT seq, reject_reason FROM judged"), lambda s, d: _filings(s, d).select("seq", "reject_reason"))
register("cmd_insert_documents", _with(_FILINGS, "SELECT * FROM rows"), lambda s, d: _new_documents(s, d).withColumn("uploaded_at", _TEXT("uploaded_at")))
register("cmd_upload_replies", _with(_FILINGS, "SELECT seq, id, 'Document uploaded successfully' AS message, filename, storage_path, checksum FROM rows"), lambda s, d: C.upload_replies(_new_documents(s, d)))
register(
    "cmd_audit_uploads", _with(_FILINGS, "SELECT seq, case_id, id AS document_id, sales_order_id, 'DOCUMENT_UPLOADED' AS action, uploaded_by AS actor, CAST(to_json(struct_pack(document_type := document_type, original_filename := original_filename, file_size := file_size)) AS VARCHAR) AS details FROM rows"),
    lambda s, d: C.audit_new_documents(_new_documents(s, d)),
)


def _patches(s: SparkSession, d: str) -> DataFrame:
    """Three patches for each supplier's case: of its status, of its name, of notes and type; some can't be accepted."""
    key, n = F.col("s_suppkey"), F.col("n")
    fields = F.when(n == 0, F.array(F.lit("status"))).when(n == 1, F.array(F.lit("customer_name"), F.lit("status"))).otherwise(F.array(F.lit("notes"), F.lit("case_type")))
    status = F.when(key % 8 != 0, F.when((key + n) % 12 == 0, "LOST").otherwise(F.when(n == 0, "CLOSED").otherwise("OPEN")))
    return raw(s, d, "supplier").select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")).select(
        (key * 3 + n).alias("seq"), key.alias("id"), fields.alias("set"), F.when(key % 8 != 1, F.col("s_name")).alias("customer_name"), F.when(key % 5 == 0, "OTHER").otherwise("SERVICES").alias("case_type"), status.alias("status"), F.when(key % 2 == 0, "note").alias("notes")
    )


_PATCHES = """b AS (SELECT s_suppkey * 3 + n AS seq, s_suppkey AS id, n, CASE WHEN s_suppkey % 8 <> 1 THEN s_name END AS customer_name, CASE WHEN s_suppkey % 5 = 0 THEN 'OTHER' ELSE 'SERVICES' END AS case_type,
  CASE WHEN s_suppkey % 8 <> 0 THEN CASE WHEN (s_suppkey + n) % 12 = 0 THEN 'LOST' WHEN n = 0 THEN 'CLOSED' ELSE 'OPEN' END END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'note' END AS notes FROM supplier, (SELECT unnest([0, 1, 2]) AS n)),
j AS (SELECT b.*, CASE WHEN c.id IS NULL THEN 'case not found' WHEN n = 1 AND b.customer_name IS NULL THEN 'customer_name' WHEN n = 2 AND b.case_type = 'OTHER' THEN 'case_type' WHEN n < 2 AND b.status = 'LOST' THEN 'status' END AS reject_reason FROM b LEFT JOIN cases c USING (id)),
ok AS (SELECT * FROM j WHERE reject_reason IS NULL)"""
register(
    "cmd_patched_cases", _with(_PATCHES, f"""SELECT c.id, CASE WHEN p1.id IS NOT NULL THEN p1.customer_name ELSE c.customer_name END AS customer_name, CASE WHEN p2.id IS NOT NULL THEN p2.case_type ELSE c.case_type END AS case_type,
    CASE WHEN p1.id IS NOT NULL THEN p1.status WHEN p0.id IS NOT NULL THEN p0.status ELSE c.status END AS status, CASE WHEN p2.id IS NOT NULL THEN p2.notes ELSE c.notes END AS notes,
    CASE WHEN coalesce(p0.id, p1.id, p2.id) IS NOT NULL THEN '{AT}' ELSE {_TEXT_SQL('c.updated_at')} END AS updated_at
    FROM cases c LEFT JOIN ok p0 ON p0.id = c.id AND p0.n = 0 LEFT JOIN ok p1 ON p1.id = c.id AND p1.n = 1 LEFT JOIN ok p2 ON p2.id = c.id AND p2.n = 2"""),
    lambda s, d: C.patched_cases(cases(s, d), C.judged_patches(cases(s, d), _patches(s, d)), _now()).select("id", "customer_name", "case_type", "status", "notes", _TEXT("updated_at")),
)
register(
    "cmd_audit_updates", _with(_PATCHES, """SELECT seq, id AS case_id, NULL::BIGINT AS document_id, NULL::BIGINT AS sales_order_id, 'CASE_UPDATED' AS action, 'System' AS actor, CAST(CASE n WHEN 0 THEN to_json(struct_pack(status := status)) WHEN 1 THEN to_json(struct_pack(customer_name := customer_name, status := status)) ELSE to_json(struct_pack(case_type := case_type, notes := notes)) END AS VARCHAR) AS details FROM ok"""),
    lambda s, d: C.audit_patches(C.judged_patches(cases(s, d), _patches(s, d))),
)


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Two turns for each POD, the second of which may be none that is taken."""
    n = F.col("n")
    degrees = F.when(n == 0, 90).otherwise(F.when(F.col("file_size") % 3 == 0, 45).otherwise(270))
    return doc_files(s, d).where("document_type = 'POD'").select("id", "file_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select((F.col("id") * 2 + n).alias("seq"), "id", degrees.alias("degrees"))


register(
    "cmd_audit_rotations", """SELECT id * 2 + n AS seq, case_id, id AS document_id, sales_order_id, 'DOCUMENT_ROTATED' AS action, 'System' AS actor, '{"degrees":' || CAST(deg AS VARCHAR) || ',"new_rotation":' || CAST((coalesce(rotation, 0) + CASE WHEN n = 0 THEN 90 ELSE 360 END) % 360 AS VARCHAR) || '}' AS details
    FROM (SELECT *, CASE WHEN n = 0 THEN 90 WHEN file_size % 3 = 0 THEN 45 ELSE 270 END AS deg FROM (SELECT *, unnest([0, 1]) AS n FROM doc_files WHERE document_type = 'POD')) WHERE deg <> 45""",
    lambda s, d: C.audit_rotations(C.judged_rotations(doc_files(s, d), _turns(s, d))),
)
register(
    "cmd_rotated_rows", "SELECT id, CASE WHEN document_type = 'POD' THEN (coalesce(rotation, 0) + CASE WHEN file_size % 3 = 0 THEN 90 ELSE 360 END) % 360 ELSE rotation END AS rotation FROM doc_files",
    lambda s, d: C.rotate(doc_files(s, d), _turns(s, d), "id").select("id", "rotation"),
)
register(
    "cmd_audit_deletes", """SELECT id AS seq, case_id, NULL::BIGINT AS document_id, sales_order_id, 'DOCUMENT_DELETED' AS action, CASE WHEN id % 2 = 0 THEN 'me' ELSE 'System' END AS actor, CAST(to_json(struct_pack(document_type := document_type, original_filename := original_filename)) AS VARCHAR) AS details FROM doc_files WHERE document_type = 'POD' AND rotation = 180""",
    lambda s, d: C.audit_deletions(C.judged_deletions(doc_files(s, d), doc_files(s, d).where("document_type = 'POD' and rotation = 180").select(F.col("id").alias("seq"), "id", F.when(F.col("id") % 2 == 0, "me").alias("deleted_by")))),
)

# A stored table after three batches.


def _stored_cases(s: SparkSession, d: str) -> DataFrame:
    stored = StoredTable(s, scratch(s, "stored-cases"), CASES.replace("?", ""), "id", 8)
    stored.upsert(0, cases(s, d))
    judged = C.judged_patches(cases(s, d), _patches(s, d))
    stored.apply(1, judged.where("reject_reason is null").select("id"), lambda old: C.patched_cases(old, judged, _now()))
    stored.remove(2, cases(s, d).where("id % 10 = 3").select("id"))
    stored.upsert(3, _new_cases(s, d))
    return stored.read().select("id", "case_id", "customer_name", "status")


register(
    "stored_cases", _with(_PATCHES, f"""SELECT c.id, case_id, CASE WHEN p1.id IS NOT NULL THEN p1.customer_name ELSE c.customer_name END AS customer_name, CASE WHEN p1.id IS NOT NULL THEN p1.status WHEN p0.id IS NOT NULL THEN p0.status ELSE c.status END AS status
    FROM cases c LEFT JOIN ok p0 ON p0.id = c.id AND p0.n = 0 LEFT JOIN ok p1 ON p1.id = c.id AND p1.n = 1 WHERE c.id % 10 <> 3 UNION ALL SELECT id, case_id, customer_name, status FROM (WITH {_CASE_REQUESTS} SELECT * FROM rows)"""),
    _stored_cases,
)

# Deletions along the declared keys: cases, orders of other cases, and what depends on both.


def _deletion(s: SparkSession, d: str) -> tuple[D.Deletion, DataFrame]:
    tables = {"cases": cases(s, d), "sales_orders": sales_orders(s, d), "documents": doc_keys(s, d), "audit_logs": audit_logs(s, d)}
    return D.delete(tables, {"cases": tables["cases"].where("id % 10 = 0"), "sales_orders": tables["sales_orders"].where("id % 7 = 0")}), doc_files(s, d)


def _left(s: SparkSession, d: str) -> DataFrame:
    left = _deletion(s, d)[0].left
    orders = left["sales_orders"].select(F.lit("sales_orders").alias("table"), "id", "case_id")
    return orders.unionByName(left["documents"].select(F.lit("documents").alias("table"), "id", "case_id")).unionByName(left["audit_logs"].select(F.lit("audit_logs").alias("table"), "id", F.col("case_id") * 1_000_000 + F.coalesce("sales_order_id", F.lit(-1))).toDF("table", "id", "case_id"))


_GONE = "gone_orders AS (SELECT id FROM sales_orders WHERE id % 7 = 0 OR case_id % 10 = 0), gone_docs AS (SELECT id FROM doc_files WHERE case_id % 10 = 0 OR sales_order_id IN (SELECT id FROM gone_orders))"
register(
    "cascade_left", _with(_GONE, """SELECT 'sales_orders' AS "table", id, case_id FROM sales_orders WHERE id NOT IN (SELECT id FROM gone_orders) UNION ALL SELECT 'documents', id, case_id FROM doc_files WHERE id NOT IN (SELECT id FROM gone_docs)
    UNION ALL SELECT 'audit_logs', id, CASE WHEN case_id IN (SELECT id FROM cases WHERE id % 10 = 0) THEN NULL ELSE case_id END * 1000000 + coalesce(CASE WHEN sales_order_id IN (SELECT id FROM gone_orders) THEN NULL ELSE sales_order_id END, -1) FROM audit_logs"""),
    _left,
)
register("cascade_files", _with(_GONE, "SELECT id, storage_path FROM doc_files WHERE id IN (SELECT id FROM gone_docs)"), lambda s, d: D.files(*reversed(_deletion(s, d))))

# Nested documents.
_FILE = ", ".join(f"{S.camel(c)} := {_TEXT_SQL(c) if c in N.TIMES else c}" for c in N.FILE)
_CHECK = lambda types, column: "struct_pack(" + ", ".join(f"{t} := list_contains({column}, '{t}')" for t in types) + ")"
_FILES = f"files AS (SELECT sales_order_id, list(struct_pack({_FILE}) ORDER BY id) AS documents, list(document_type) AS types FROM doc_files WHERE sales_order_id IS NOT NULL GROUP BY 1)"
_TIMED = lambda c, alias: f"{S.camel(c)} := {_TEXT_SQL(f'{alias}.{c}') if c in N.TIMES else f'{alias}.{c}'}"
register(
    "case_detail_json", _with(f"""{_FILES}, entries AS (SELECT s.case_id, list(struct_pack({', '.join(_TIMED(c, 's') for c in N.ORDER)}, documentCount := coalesce(len(documents), 0), checklist := {_CHECK(ORDER_TYPES, 'coalesce(types, [])')}, documents := coalesce(documents, [])) ORDER BY so_month, so_number) AS orders
      FROM sales_orders s LEFT JOIN files f ON f.sales_order_id = s.id GROUP BY 1),
    po AS (SELECT case_id, arg_min(struct_pack({_FILE}), checksum) AS po FROM doc_files WHERE document_type = 'CUSTOMER_PO' GROUP BY 1)""",
    f"SELECT c.id, CAST(to_json(struct_pack({', '.join(_TIMED(c, 'c') for c in N.CASE)}, customerPo := po, salesOrders := coalesce(orders, []))) AS VARCHAR) AS body FROM cases c LEFT JOIN entries e ON e.case_id = c.id LEFT JOIN po ON po.case_id = c.id"),
    lambda s, d: (df := N.case_documents(cases(s, d), sales_orders(s, d), doc_files(s, d))).select("id", N.body(df).alias("body")),
)
register(
    "so_search_json", _with(_FILES, f"""SELECT so_number, CAST(to_json(struct_pack(soNumber := so_number, soMonth := so_month, caseId := c.case_id, opportunityId := opportunity_id, customerName := customer_name, documentCount := coalesce(len(documents), 0), checklist := {_CHECK(DOCUMENT_TYPES, 'coalesce(types, [])')},
      folderPath := '/nas/cases/' || c.case_id || '/' || so_month || '/SO-' || so_number, documents := coalesce(documents, []))) AS VARCHAR) AS body
    FROM (SELECT * FROM sales_orders WHERE so_number ILIKE '%123%' ORDER BY so_number LIMIT 20) s LEFT JOIN cases c ON c.id = s.case_id LEFT JOIN files f ON f.sales_order_id = s.id"""),
    lambda s, d: (df := N.found_orders(_found(s, sales_orders(s, d), "so_number", "123", "so_number"), cases(s, d), doc_files(s, d))).select("so_number", N.body(df).alias("body")),
)
register(
    "json_listed_orders", _with(_FILES, f"SELECT s.id, CAST(to_json(struct_pack(id := s.id, caseId := s.case_id, soNumber := so_number, soMonth := so_month, createdAt := {_TEXT_SQL('created_at')}, updatedAt := {_TEXT_SQL('updated_at')}, documentCount := coalesce(len(documents), 0), checklist := {_CHECK(ORDER_TYPES, 'coalesce(types, [])')})) AS VARCHAR) AS body FROM sales_orders s LEFT JOIN files f ON f.sales_order_id = s.id"),
    lambda s, d: (df := N.listed_orders(sales_orders(s, d).withColumns({"created_at": _TEXT("created_at"), "updated_at": _TEXT("updated_at")}), doc_files(s, d))).select("id", N.body(df).alias("body")),
)

# What is kept beside the tables: statistics as deltas, the trail in ranges, cases and orders in clustered files.
AS_OF = "1998-08-20"


def _kept_statistics(s: SparkSession, d: str) -> DataFrame:
    """All rows in a first batch; then deletions, new cases and closed ones."""
    stats, documents = Statistics(s, scratch(s, "statistics")), doc_files(s, d)
    stats.add(0, {"cases": cases(s, d), "sales_orders": sales_orders(s, d), "documents": documents})
    stats.add(1, went={"documents": documents.where("document_type = 'POD' and rotation = 180")})
    stats.compact(1)
    closed = cases(s, d).where("id % 4 = 0")
    stats.add(2, {"cases": closed.withColumn("status", F.lit("CLOSED"))}, {"cases": closed})
    return stats.overview(AS_OF)


_LEFT = "docs AS (SELECT * FROM doc_files WHERE NOT (document_type = 'POD' AND rotation = 180)), now AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'CLOSED' ELSE status END AS status FROM cases)"
_EACH = ", ".join(f"count(*) FILTER (document_type = '{t}') AS n_{t.lower()}" for t in DOCUMENT_TYPES)
register(
    "stats_from_deltas", _with(_LEFT, f"""SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (status = 'OPEN') AS open_cases, count(*) FILTER (status = 'IN_PROGRESS') AS in_progress_cases, count(*) FILTER (status = 'CLOSED') AS closed_cases FROM now), (SELECT count(*) AS total_sales_orders FROM sales_orders),
    (SELECT count(*) AS total_documents, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_bytes, count(*) FILTER (uploaded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS recent_uploads, {_EACH}, coalesce(round_even(CAST(sum(file_size) AS DOUBLE) / 1048576, 2), 0) AS total_mb FROM docs)"""),
    _kept_statistics,
)


def _deep_page(s: SparkSession, d: str) -> DataFrame:
    """The page at nine tenths of the trail."""
    log, rows = PagedLog(s, scratch(s, "trail"), range_rows=1000), audit_logs(s, d)
    log.add(0, rows)
    return log.page(50, int(log.total() * 9 // 10)).select("id", "case_id", "action", "actor", _TEXT("created_at"))


register("audit_deep_page", f"SELECT id, case_id, action, actor, {_TEXT_SQL('created_at')} AS created_at FROM (SELECT * FROM audit_logs ORDER BY audit_logs.created_at DESC, id DESC LIMIT 50 OFFSET (SELECT count(*) * 9 // 10 FROM audit_logs))", _deep_page)


def _clustered(s: SparkSession, table: DataFrame, key: str, **how) -> str:
    path = scratch(s, "clustered")
    clustered.write(table, path, key, ("id",), **how)
    return path


def _clustered_documents(s: SparkSession, d: str) -> str:
    """Every document, whole, by its order. Lines are dealt out, and made into documents where they are written."""
    return _clustered(s, doc_lines(s, d), "sales_order_id", made=documents_of, rows=raw(s, d, "lineitem").count())


register("lookup_case_by_key", f"SELECT {', '.join(_CASE)} FROM cases WHERE case_id = 'CASE-2026-0042'", lambda s, d: clustered.find(s, _clustered(s, cases(s, d), "case_id"), "case_id", "CASE-2026-0042").select(*_CASE))
register("lookup_case_by_id", f"SELECT {', '.join(_CASE)} FROM cases WHERE id = 42", lambda s, d: clustered.find(s, _clustered(s, cases(s, d), "case_id"), "id", 42).select(*_CASE))
register("lookup_so_by_number", f"SELECT {', '.join(_SO)} FROM sales_orders WHERE so_number = '10TM0000000077'", lambda s, d: clustered.find(s, _clustered(s, sales_orders(s, d), "so_number"), "so_number", "10TM0000000077").select(*_SO))
register(
    "lookup_docs_of_orders", "SELECT id, sales_order_id, document_type, checksum FROM doc_files WHERE sales_order_id IN (1, 77, 1234)",
    lambda s, d: clustered.find_many(s, _clustered_documents(s, d), "sales_order_id", [1, 77, 1234]).select("id", "sales_order_id", "document_type", "checksum"),
)
