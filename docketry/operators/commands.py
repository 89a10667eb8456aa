"""Changes in batches: validated, joined against the current state, turned into rows, and audited.

Each command takes the state and a batch of requests with a unique `seq`, the order of arrival, and gives the
batch with `reject_reason` (null where accepted) and what the accepted rows become. `*_rows` gives the new rows with their
defaults, `audit_*` what the trail says of them. plans.records applies both to stored tables.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.scalars import case_number, case_suffix, is_month, normalize_opportunity, optional, rotated, storage_path, stored_filename, strip
from docketry.sources.store import kept
from docketry.sources.tables import CASE_TYPES, ROTATIONS, STATUSES

#: What a patch may set, in the order that it is validated and audited.
FIELDS = ("customer_name", "case_type", "status", "notes")


def _first(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds."""
    reason = F.lit(None).cast("string")
    for broken, why in reversed(rules):
        reason = F.when(broken, F.lit(why)).otherwise(reason)
    return reason


def _without_repeats(judged: DataFrame, why: str, *keys: str) -> DataFrame:
    """Requests so far accepted are rejected where an earlier one of these has the same keys.

    The first of each key is a minimum that is taken before the shuffle, so no task holds all requests of one key.
    """
    first = judged.where("reject_reason is null").groupBy(*keys).agg(F.min("seq").alias("_first")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.equal_null(k, f"_{k}")
    late = F.col("reject_reason").isNull() & (F.col("seq") > F.col("_first"))
    return judged.join(first, same, "left").withColumn("reject_reason", F.when(late, why).otherwise(F.col("reject_reason"))).drop("_first", *[f"_{k}" for k in keys])


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with `nth`, from 1 on, by a unique column: ranges of it are counted, and each begins where those before it end.

    A window over a range, not over all rows; the starts are one row for each range.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(order)
    return ranged.join(F.broadcast(starts), "_part").withColumn("nth", F.col("_start") + F.row_number().over(within)).drop("_part", "_start")


def create_cases(cases: DataFrame, batch: DataFrame, year: int) -> DataFrame:
    """Requests (seq, opportunity_id, customer_name, case_type) with reason and the new case_id.

    Numbers go on from the year's largest, by arrival; only the accepted requests are numbered, by `nth` from 1 on.
    """
    wanted = batch.withColumn("normalized", normalize_opportunity(F.col("opportunity_id")))
    taken = cases.select(F.col("opportunity_id").alias("normalized"), F.lit(True).alias("_taken"))
    bad = _first(
        (~F.coalesce(F.length("customer_name").between(1, 255), F.lit(False)), "customer_name"), (~F.coalesce(F.col("case_type").isin(*CASE_TYPES), F.lit(False)), "case_type"),
        (~F.coalesce(F.length("opportunity_id").between(1, 20), F.lit(False)), "opportunity_id"), (F.length("normalized") > 20, "opportunity_id"), (F.col("_taken").isNotNull(), "opportunity exists"),
    )
    judged = wanted.join(taken, "normalized", "left").withColumn("reject_reason", bad).drop("_taken")
    judged = _without_repeats(judged, "opportunity exists", "normalized")
    prefix = f"CASE-{year}-"
    largest = cases.where(F.col("case_id").startswith(prefix)).agg(F.coalesce(F.max(case_suffix(F.col("case_id"))), F.lit(0)).alias("_n"))
    accepted = numbered(judged.where("reject_reason is null").select("seq"), "seq").crossJoin(largest).select(F.col("seq").alias("_seq"), case_number(F.lit(prefix), F.col("_n") + F.col("nth")).alias("case_id"), "nth")
    return judged.join(accepted, F.col("seq") == F.col("_seq"), "left").drop("_seq")


def create_sales_orders(cases: DataFrame, orders: DataFrame, batch: DataFrame) -> DataFrame:
    """Requests (seq, case_id, so_number, so_month) with reason."""
    wanted = batch.join(orders.select("so_number", F.lit(True).alias("_taken")), "so_number", "left").join(cases.select(F.col("id").alias("case_id"), F.lit(True).alias("_case")), "case_id", "left")
    bad = _first(
        (~F.coalesce(F.length("so_number").between(1, 50), F.lit(False)), "so_number"), (~is_month(F.col("so_month")), "so_month"), (F.col("_taken").isNotNull(), "sales order exists"), (F.col("_case").isNull(), "case not found"),
    )
    return _without_repeats(wanted.withColumn("reject_reason", bad).drop("_taken", "_case"), "sales order exists", "so_number")


def upload_reason(known: Column) -> Column:
    """Why an upload is rejected, in the order of the original's checks, given _case, _owner and whether its file is known."""
    return _first(
        (~F.coalesce(F.lower("original_filename").endswith(".pdf"), F.lit(False)), "not a PDF"), (F.col("_case").isNull(), "case not found"), (F.col("sales_order_id").isNull(), "sales order required"),
        (F.col("_owner").isNull(), "sales order not found"), (F.col("_owner") != F.col("case_id"), "sales order of another case"), (known, "duplicate file"),
    )


def _file_key(checksum: Column) -> Column:
    """128 bits of a checksum's SHA-256, in place of 64 characters: equal for equal checksums, and for no others short of a collision of SHA-256's half."""
    return F.unhex(F.substring(F.sha2(checksum, 256), 1, 32))


def upload_documents(cases: DataFrame, orders: DataFrame, documents: DataFrame, batch: DataFrame) -> DataFrame:
    """Requests (seq, case_id, sales_order_id, original_filename, checksum) with reason, checked in the order of the original.

    Only seq, what is checked, and a key of the file in place of its checksum go through the joins. What passes the other checks is kept in the shared folder;
    one aggregation over its files and those of the documents, partly done before the shuffle, tells which are there already and which request asks for each first.
    The verdicts are kept too, so whatever follows reads them and judges nothing again.
    """
    pdf = F.coalesce(F.lower("original_filename").endswith(".pdf"), F.lit(False))
    asked = batch.select("seq", "case_id", "sales_order_id", F.when(pdf, ".pdf").alias("original_filename"), _file_key(F.col("checksum")).alias("_file"))
    known = asked.join(cases.select(F.col("id").alias("case_id"), F.lit(True).alias("_case")), "case_id", "left")
    known = known.join(orders.select(F.col("id").alias("sales_order_id"), F.col("case_id").alias("_owner")), "sales_order_id", "left")
    judged = kept(known.select("seq", "case_id", "_file", upload_reason(F.lit(False)).alias("reject_reason")), "judged")
    fine = judged.where("reject_reason is null").drop("reject_reason")
    none = F.lit(None).cast(batch.schema["seq"].dataType)
    # Of the documents only those of files that the batch asks for are shuffled, where Spark can broadcast these.
    stored = documents.select("case_id", _file_key(F.col("checksum")).alias("_file")).join(fine.select("case_id", "_file"), ["case_id", "_file"], "left_semi")
    files = fine.withColumn("_stored", F.lit(False)).unionByName(stored.select("case_id", "_file", none.alias("seq"), F.lit(True).alias("_stored")))
    firsts = files.groupBy("case_id", "_file").agg(F.min("seq").alias("_first"), F.max("_stored").alias("_stored")).withColumnsRenamed({"case_id": "_c", "_file": "_f"})
    late = F.col("_stored") | (F.col("seq") > F.col("_first"))
    repeated = fine.join(firsts, F.equal_null("case_id", "_c") & F.equal_null("_file", "_f")).where(late).select("seq", F.lit("duplicate file").alias("reject_reason"))
    verdicts = kept(judged.where("reject_reason is not null").select("seq", "reject_reason").unionByName(repeated), "verdicts")
    return batch.join(verdicts, "seq", "left")


def acknowledged(judged: DataFrame, orders: DataFrame, cases: DataFrame, base: str) -> DataFrame:
    """What the caller is told of each accepted upload: (seq, message, filename, storage_path, checksum)."""
    named = judged.where("reject_reason is null").join(orders.select(F.col("id").alias("sales_order_id"), "so_number", "so_month"), "sales_order_id").join(cases.select(F.col("id").alias("case_id"), F.col("case_id").alias("case_key")), "case_id")
    stored = stored_filename(F.col("checksum"), F.col("original_filename"))
    path = storage_path(F.lit(base), F.col("case_key"), F.col("so_month"), F.col("so_number"), F.col("document_type"), stored)
    return named.select("seq", F.lit("Document uploaded successfully").alias("message"), stored.alias("filename"), path.alias("storage_path"), "checksum")


def judged_patches(cases: DataFrame, batch: DataFrame) -> DataFrame:
    """Patches (id, set: array of field names, customer_name, case_type, status, notes) with reason and the case's old values.

    A field counts as set by its name, not by its value: an explicit null is a value, and rejected where
    the column can't be null.
    """
    joined = batch.join(cases.select("id", *[F.col(c).alias(f"old_{c}") for c in FIELDS], F.lit(True).alias("_case")), "id", "left")
    bad = _first(
        (F.col("_case").isNull(), "case not found"), (_given("customer_name") & ~F.coalesce(F.length("customer_name").between(1, 255), F.lit(False)), "customer_name"),
        (_given("case_type") & ~F.coalesce(F.col("case_type").isin(*CASE_TYPES), F.lit(False)), "case_type"), (_given("status") & F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "status"),
    )
    return joined.withColumn("reject_reason", bad).drop("_case")


def _given(field: str) -> Column:
    return F.array_contains("set", field)


def update_cases(cases: DataFrame, batch: DataFrame) -> DataFrame:
    """Patches with reason and what the case is after each of them: they are applied by `seq`, which a batch of one patch per case may leave out.

    A rejected patch changes nothing; each field has the value of the last accepted patch that set it.
    """
    seq = ["seq"] if "seq" in batch.columns else []
    so_far = Window.partitionBy("id").orderBy(*(seq or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A value in a struct: a null that was set is told from one that wasn't.
    last = lambda f: F.last(F.when(_given(f) & F.col("reject_reason").isNull(), F.struct(F.col(f).alias("value"))), ignorenulls=True).over(so_far)
    after = judged_patches(cases, batch).withColumns({f"_{f}": last(f) for f in FIELDS})
    return after.select("id", *seq, "reject_reason", *[F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f"old_{f}")).alias(f"new_{f}") for f in FIELDS])


def patched_cases(cases: DataFrame, judged: DataFrame, at: Column) -> DataFrame:
    """All cases, with the accepted patches of judged_patches folded by seq; those that have any get a new updated_at.

    The last value of each field is picked before the shuffle, so no task holds all patches of one case.
    """
    accepted = judged.where("reject_reason is null")
    set_last = [F.max_by(F.when(_given(f), F.struct(F.col(f).alias("value"))), F.when(_given(f), F.col("seq"))).alias(f"_{f}") for f in FIELDS]
    folded = accepted.groupBy("id").agg(*set_last, F.lit(True).alias("_hit"))
    new = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in FIELDS}
    return cases.join(folded, "id", "left").withColumns({**new, "updated_at": F.when(F.col("_hit"), at).otherwise(F.col("updated_at"))}).drop("_hit", *[f"_{f}" for f in FIELDS])


def trimmed(batch: DataFrame) -> DataFrame:
    """Requests as a client sends them: names and numbers without white space around them, empty notes and references as none."""
    there = lambda names, f: {c: f(F.col(c)) for c in names if c in batch.columns}
    return batch.withColumns(there(("opportunity_id", "customer_name", "so_number"), strip) | there(("notes", "reference_number"), optional))


def _new_ids(accepted: DataFrame, table: DataFrame) -> DataFrame:
    """(_seq, new_id) of accepted requests: ids after the table's largest, by arrival."""
    largest = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_most"))
    return numbered(accepted.select("seq"), "seq").crossJoin(largest).select(F.col("seq").alias("_seq"), (F.col("_most") + F.col("nth")).alias("new_id"))


def _next_ids(judged: DataFrame, table: DataFrame) -> DataFrame:
    """Accepted requests with their `new_id`."""
    accepted = judged.where("reject_reason is null")
    return accepted.drop("nth").join(_new_ids(accepted, table), F.col("seq") == F.col("_seq")).drop("_seq")


def case_rows(judged: DataFrame, cases: DataFrame, at: Column) -> DataFrame:
    """seq and the rows of accepted create_cases requests: open, with an id after the largest."""
    notes = F.col("notes") if "notes" in judged.columns else F.lit(None)
    return _next_ids(judged, cases).select(
        "seq", F.col("new_id").alias("id"), "case_id", F.col("normalized").alias("opportunity_id"), "customer_name", "case_type", F.lit("OPEN").alias("status"), notes.cast("string").alias("notes"), at.alias("created_at"), at.alias("updated_at")
    )


def order_rows(judged: DataFrame, orders: DataFrame, at: Column) -> DataFrame:
    """seq and the rows of accepted create_sales_orders requests."""
    return _next_ids(judged, orders).select("seq", F.col("new_id").alias("id"), "case_id", "so_number", "so_month", at.alias("created_at"), at.alias("updated_at"))


def document_rows(judged: DataFrame, cases: DataFrame, orders: DataFrame, documents: DataFrame, base: str, at: Column) -> DataFrame:
    """seq and the rows of accepted upload_documents requests: not rotated, filed under their case and order. Of the documents the largest id is read."""
    text = lambda c, default: (F.coalesce(F.col(c), F.lit(default)) if c in judged.columns else F.lit(default)).cast("string")
    of_order = orders.select(F.col("id").alias("sales_order_id"), "so_number", "so_month")
    of_case = cases.select(F.col("id").alias("case_id"), F.col("case_id").alias("case_key"))
    # Ids, orders and cases are found for the keys alone; the rest of a request is shuffled once, by seq.
    accepted = kept(judged.where("reject_reason is null").select("seq", "sales_order_id", "case_id"), "accepted")
    places = accepted.join(of_order, "sales_order_id").join(of_case, "case_id").join(_new_ids(accepted, documents), F.col("seq") == F.col("_seq")).select("seq", "new_id", "so_number", "so_month", "case_key")
    stored = stored_filename(F.concat_ws("-", "case_id", "checksum"), F.col("original_filename"))
    path = storage_path(F.lit(base), F.col("case_key"), F.col("so_month"), F.col("so_number"), F.col("document_type"), stored)
    return judged.join(places, "seq").select(
        "seq", F.col("new_id").alias("id"), "case_id", "sales_order_id", "document_type", stored.alias("filename"), "original_filename", text("reference_number", None).alias("reference_number"), path.alias("storage_path"),
        "checksum", F.col("file_size").cast("int").alias("file_size"), F.lit(0).alias("rotation"), at.alias("uploaded_at"), text("uploaded_by", "Anonymous").alias("uploaded_by"),
    )


def upload_replies(rows: DataFrame) -> DataFrame:
    """What the caller is told of each document row: (seq, id, message, filename, storage_path, checksum)."""
    return rows.select("seq", "id", F.lit("Document uploaded successfully").alias("message"), "filename", "storage_path", "checksum")


def judged_turns(batch: DataFrame) -> DataFrame:
    """A batch with `degrees` and reject_reason: only quarter turns are taken."""
    return batch.withColumn("reject_reason", _first((~F.coalesce(F.col("degrees").isin(*ROTATIONS), F.lit(False)), "rotation")))


def rotate(documents: DataFrame, batch: DataFrame, key: str = "checksum") -> DataFrame:
    """Documents with the accepted turns of the batch's (key, degrees) added up; judged_turns tells the others."""
    turns = judged_turns(batch).where("reject_reason is null").groupBy(key).agg(F.sum("degrees").alias("_d"))
    return documents.join(turns, key, "left").withColumn("rotation", F.when(F.col("_d").isNotNull(), rotated(F.col("rotation"), F.col("_d")).cast("int")).otherwise(F.col("rotation"))).drop("_d")


def delete(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    return df.join(keys, list(columns), "left_anti")


def cascade(orders: DataFrame, documents: DataFrame, deleted_cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of orders and documents when cases (id) go."""
    gone = deleted_cases.select(F.col("id").alias("case_id"))
    return orders.join(gone, "case_id", "left_anti"), documents.join(gone, "case_id", "left_anti")


def set_null(logs: DataFrame, deleted_cases: DataFrame) -> DataFrame:
    """Audit rows outlive their case, with a null in its place."""
    gone = deleted_cases.select(F.col("id").alias("case_id"), F.lit(True).alias("_gone"))
    return logs.join(gone, "case_id", "left").withColumn("case_id", F.when(F.col("_gone").isNull(), F.col("case_id"))).drop("_gone")


def orphans(orders: DataFrame, documents: DataFrame, cases: DataFrame) -> DataFrame:
    """How many orders have no case, and documents no order."""
    lost_orders = orders.join(cases.select(F.col("id").alias("case_id")), "case_id", "left_anti").agg(F.count("*").alias("orders_without_case"))
    wanted = documents.where("sales_order_id is not null").select("sales_order_id")
    lost = wanted.join(orders.select(F.col("id").alias("sales_order_id")), "sales_order_id", "left_anti").agg(F.count("*").alias("documents_without_order"))
    return lost_orders.crossJoin(lost)


def audit_rows(accepted: DataFrame, action: str, actor: Column, details: list[str | Column], **ids: Column) -> DataFrame:
    """(seq, action, actor, details) of accepted requests, details as JSON, with what `ids` names of case_id, document_id and sales_order_id."""
    return accepted.where("reject_reason is null").select("seq", F.lit(action).alias("action"), actor.alias("actor"), F.to_json(F.struct(*details)).alias("details"), *[c.alias(name) for name, c in ids.items()])


AUDIT = ("seq", "case_id", "document_id", "sales_order_id", "action", "actor", "details")


def _audit(rows: DataFrame, action: str, actor: Column, details: Column, case_id: Column, document_id: Column | None = None, sales_order_id: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    of = (case_id, none if document_id is None else document_id, none if sales_order_id is None else sales_order_id)
    return rows.select("seq", *[c.cast("long").alias(n) for c, n in zip(of, AUDIT[1:4], strict=True)], F.lit(action).alias("action"), actor.alias("actor"), details.alias("details"))


def _json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def audit_new_cases(rows: DataFrame) -> DataFrame:
    """Of case_rows."""
    return _audit(rows, "CASE_CREATED", F.lit("System"), _json("case_id", "opportunity_id"), F.col("id"))


def audit_new_orders(rows: DataFrame) -> DataFrame:
    """Of order_rows."""
    return _audit(rows, "SO_CREATED", F.lit("System"), _json("so_number", "so_month"), F.col("case_id"), sales_order_id=F.col("id"))


def audit_new_documents(rows: DataFrame) -> DataFrame:
    """Of document_rows."""
    return _audit(rows, "DOCUMENT_UPLOADED", F.col("uploaded_by"), _json("document_type", "original_filename", "file_size"), F.col("case_id"), F.col("id"), F.col("sales_order_id"))


def audit_patches(judged: DataFrame) -> DataFrame:
    """Of judged_patches with seq: the fields that each accepted patch set, explicit nulls included."""
    sent = F.filter(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in FIELDS]), lambda x: F.array_contains(F.col("set"), x["name"]))
    return _audit(judged.where("reject_reason is null"), "CASE_UPDATED", F.lit("System"), F.to_json(F.map_from_entries(sent), {"ignoreNullFields": "false"}), F.col("id"))


def judged_rotations(documents: DataFrame, batch: DataFrame) -> DataFrame:
    """Turns (seq, id, degrees) with reason and new_rotation, what the document is turned to after each, by seq."""
    known = batch.join(documents.select("id", "case_id", "sales_order_id", F.col("rotation").alias("_old"), F.lit(True).alias("_there")), "id", "left")
    judged = known.withColumn("reject_reason", _first((F.col("_there").isNull(), "document not found"), (~F.coalesce(F.col("degrees").isin(*ROTATIONS), F.lit(False)), "rotation")))
    turned = F.sum(F.when(F.col("reject_reason").isNull(), F.col("degrees")).otherwise(0)).over(Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return judged.withColumn("new_rotation", F.when(F.col("reject_reason").isNull(), rotated(F.col("_old"), turned).cast("int"))).drop("_old", "_there")


def audit_rotations(judged: DataFrame) -> DataFrame:
    """Of judged_rotations."""
    return _audit(judged.where("reject_reason is null"), "DOCUMENT_ROTATED", F.lit("System"), _json("degrees", "new_rotation"), F.col("case_id"), F.col("id"), F.col("sales_order_id"))


def judged_deletions(documents: DataFrame, batch: DataFrame) -> DataFrame:
    """Deletions (seq, id, deleted_by) with reason and what the document was; the second one of a document finds nothing."""
    known = batch.join(documents.select("id", "case_id", "sales_order_id", "document_type", "original_filename", "storage_path", F.lit(True).alias("_there")), "id", "left")
    return _without_repeats(known.withColumn("reject_reason", _first((F.col("_there").isNull(), "document not found"))).drop("_there"), "document not found", "id")


def audit_deletions(judged: DataFrame) -> DataFrame:
    """Of judged_deletions. The row outlives its document, so it names none."""
    return _audit(judged.where("reject_reason is null"), "DOCUMENT_DELETED", F.coalesce("deleted_by", F.lit("System")), _json("document_type", "original_filename"), F.col("case_id"), sales_order_id=F.col("sales_order_id"))
