"""Nested documents: a case with its orders and their files, an order as a search shows it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.scalars import camel, folder_path
from docketry.sources.tables import DOCUMENT_TYPES, ORDER_TYPES

#: Columns of a file in a nested document.
FILE = ("id", "case_id", "sales_order_id", "document_type", "filename", "original_filename", "reference_number", "storage_path", "file_size", "rotation", "uploaded_at", "uploaded_by")
CASE = ("id", "case_id", "opportunity_id", "customer_name", "case_type", "status", "notes", "created_at", "updated_at")
ORDER = ("id", "so_number", "so_month", "created_at", "updated_at")
TIMES = ("created_at", "updated_at", "uploaded_at")
#: What a file has of its own, once its case and order are known.
OWN = tuple(c for c in FILE if c not in ("case_id", "sales_order_id", "storage_path"))


def _shown(columns: tuple[str, ...]) -> list[Column]:
    """Columns of a nested entry; times as text."""
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in TIMES else F.col(c) for c in columns]


def _packed() -> Column:
    """A file as it is shuffled: times as they are, and its path without the filename where it ends with that."""
    ends = F.endswith("storage_path", F.col("filename"))
    folder = F.expr("left(storage_path, length(storage_path) - length(filename))")
    return F.struct(*OWN, F.coalesce(ends, F.lit(False)).alias("ends"), F.when(ends, folder).otherwise(F.col("storage_path")).alias("folder"))


def _unpacked(file: Column) -> Column:
    """The file of _packed, with the columns that the group around it has."""
    known = {"case_id": F.col("_case"), "sales_order_id": F.col("_order"), "storage_path": F.when(file["ends"], F.concat(file["folder"], file["filename"])).otherwise(file["folder"])}
    return F.struct(*[(F.date_format(file[c], "yyyy-MM-dd HH:mm:ss") if c in TIMES else known.get(c, file[c])).alias(c) for c in FILE])


def _checklist(types: Column, listed: tuple[str, ...]) -> Column:
    return F.struct(*[F.array_contains(types, t).alias(t) for t in listed])


def case_documents(cases: DataFrame, orders: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per case: its columns, customer_po (the customer PO of the least checksum, null without one) and sales_orders by month and number, each with document_count, checklist and documents by id.

    Rows of the three tables are dealt out by case once and then grouped twice, by order within the case, and by case: neither needs
    another shuffle, and nothing is joined. Files are shuffled without what their group and their filename say again. An order's documents are those of its own case, as uploads see to. A case's entries meet in one row, as they do in the document.
    """
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType)
    case = cases.select(F.col("id").alias("_case"), F.struct(*_shown(CASE)).alias("case"))
    order = orders.select(F.col("case_id").alias("_case"), F.col("id").alias("_order"), F.struct(*_shown(ORDER)).alias("order"))
    file = documents.select(F.col("case_id").alias("_case"), F.col("sales_order_id").alias("_order"), _packed().alias("file"), F.when(F.col("document_type") == "CUSTOMER_PO", F.col("checksum")).alias("_po"))
    every = (
        case.select("_case", none(order, "_order").alias("_order"), "case", none(order, "order").alias("order"), none(file, "file").alias("file"), none(file, "_po").alias("_po"))
        .unionByName(order.select("_case", "_order", none(case, "case").alias("case"), "order", none(file, "file").alias("file"), none(file, "_po").alias("_po")))
        .unionByName(file.select("_case", "_order", none(case, "case").alias("case"), none(order, "order").alias("order"), "file", "_po"))
    )
    by_order = every.repartition("_case").groupBy("_case", "_order").agg(
        F.first("case", ignorenulls=True).alias("case"), F.first("order", ignorenulls=True).alias("order"), F.collect_list("file").alias("files"), F.min_by(F.when(F.col("_po").isNotNull(), F.struct("_po", "file")), "_po").alias("po")
    )
    unpacked = F.when(F.col("po").isNotNull(), F.struct(F.col("po._po"), _unpacked(F.col("po.file")).alias("file")))
    by_order = by_order.withColumns({"files": F.transform("files", _unpacked), "po": unpacked})
    files = F.array_sort("files", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    entry = F.struct("order.*", F.size("files").alias("document_count"), _checklist(F.col("files.document_type"), ORDER_TYPES).alias("checklist"), files.alias("documents"))
    keyed = F.when(F.col("order").isNotNull(), F.struct(F.col("order.so_month"), F.col("order.so_number"), entry.alias("entry")))
    grouped = by_order.groupBy("_case").agg(F.first("case", ignorenulls=True).alias("case"), F.min_by("po", "po._po").alias("po"), F.collect_list(keyed).alias("orders"))
    before = lambda a, b: (a["so_month"] < b["so_month"]) | ((a["so_month"] == b["so_month"]) & (a["so_number"] < b["so_number"]))
    ordered = F.array_sort("orders", lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0))
    return grouped.where("case is not null").select("case.*", F.col("po.file").alias("customer_po"), F.transform(ordered, lambda x: x["entry"]).alias("sales_orders"))


def found_orders(hits: DataFrame, cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Orders that a search found, at most its limit: so_number, so_month, their case, document_count, checklist of all types, folder_path and documents by id."""
    known = cases.select(F.col("id").alias("_case"), F.col("case_id").alias("case_key"), "opportunity_id", "customer_name")
    ids = hits.select(F.col("id").alias("_order"))
    of_hits = documents.join(F.broadcast(ids), documents["sales_order_id"] == F.col("_order"))  # a row for each hit
    files = of_hits.groupBy("_order").agg(F.sort_array(F.collect_list(F.struct(*_shown(FILE)))).alias("documents"))
    joined = hits.join(known, hits["case_id"] == F.col("_case"), "left").join(files, hits["id"] == F.col("_order"), "left")
    empty = F.array().cast(files.schema["documents"].dataType)
    filled = joined.withColumn("documents", F.coalesce("documents", empty))
    return filled.select(
        "so_number", "so_month", F.col("case_key").alias("case_id"), "opportunity_id", "customer_name", F.size("documents").alias("document_count"), _checklist(F.col("documents.document_type"), DOCUMENT_TYPES).alias("checklist"),
        folder_path(F.col("case_key"), F.col("so_month"), F.col("so_number")).alias("folder_path"), "documents",
    )


def listed_orders(orders: DataFrame, documents: DataFrame) -> DataFrame:
    """Orders with document_count and checklist, the latter as one struct. Types are summed up before the shuffle."""
    types = documents.where("sales_order_id is not null").groupBy(F.col("sales_order_id").alias("_order")).agg(F.count("*").alias("_n"), F.collect_set("document_type").alias("_types"))
    joined = orders.join(types, orders["id"] == F.col("_order"), "left")
    seen = F.coalesce("_types", F.array().cast("array<string>"))
    return joined.select(*orders.columns, F.coalesce("_n", F.lit(0)).alias("document_count"), _checklist(seen, ORDER_TYPES).alias("checklist"))


def camelled(x: Column, kind) -> Column:
    """A nested value with the client's names; the keys of checklists, which are types, stay."""
    name = kind.typeName()
    if name == "array":
        return F.transform(x, lambda e: camelled(e, kind.elementType))
    if name == "struct":
        fields = F.struct(*[(x[f.name] if f.name == "checklist" else camelled(x[f.name], f.dataType)).alias(camel(f.name)) for f in kind.fields])
        return F.when(x.isNotNull(), fields)
    return x


def body(df: DataFrame) -> Column:
    """Each row as the client's nested JSON, nulls included."""
    return F.to_json(F.struct(*[(F.col(f.name) if f.name == "checklist" else camelled(F.col(f.name), f.dataType)).alias(camel(f.name)) for f in df.schema.fields]), {"ignoreNullFields": "false"})
