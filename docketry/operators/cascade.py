"""Deletions carried along declared foreign keys."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.sources.store import cut


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str  # CASCADE or SET NULL


# Fixed values of the data model.
FOREIGN_KEYS = (
    ForeignKey("sales_orders", "case_id", "cases", "CASCADE"),
    ForeignKey("documents", "case_id", "cases", "CASCADE"),
    ForeignKey("documents", "sales_order_id", "sales_orders", "CASCADE"),
    ForeignKey("audit_logs", "case_id", "cases", "SET NULL"),
    ForeignKey("audit_logs", "document_id", "documents", "SET NULL"),
    ForeignKey("audit_logs", "sales_order_id", "sales_orders", "SET NULL"),
)


@dataclass
class Deletion:
    """`gone`: the ids that go, by table. `left`: every table without them, and with nulls where a key says so."""

    gone: dict[str, DataFrame]
    left: dict[str, DataFrame]


def delete(tables: dict[str, DataFrame], start: dict[str, DataFrame], keys: tuple[ForeignKey, ...] = FOREIGN_KEYS) -> Deletion:
    """Delete rows of some tables (`start`: their ids) and what depends on them.

    A table at a time, parents before children: the children of what went of it, by a join for each key, less what is gone already, until no
    table has rows whose children are to be found. So without a ring of keys each key is followed once. A key that refers to its own table, or a ring of them, ends like any other. Only ids are kept between rounds.
    Ids are joined, each being there once, and not semi-joined: Spark would move a semi-join below the columns that a table derives, and shuffle what they are made of.
    """
    missing = {t for k in keys for t in (k.child, k.parent)} - set(tables)
    keys = tuple(k for k in keys if not {k.child, k.parent} & missing)
    rank = dict.fromkeys(tables, 0)
    for _ in tables:
        for k in keys:
            if k.on_delete == "CASCADE" and k.child != k.parent:
                rank[k.child] = min(max(rank[k.child], rank[k.parent] + 1), len(tables))
    gone: dict[str, DataFrame] = {}
    fresh = {t: cut(tables[t].select("id").join(ids.select("id"), "id", "left_semi").distinct()) for t, ids in start.items()}
    while fresh:
        parent = min(fresh, key=rank.__getitem__)
        parents = fresh.pop(parent)
        gone[parent] = gone[parent].unionByName(parents) if parent in gone else parents
        found: dict[str, DataFrame] = {}
        for k in keys:
            if k.on_delete == "CASCADE" and k.parent == parent:
                ids = tables[k.child].select("id", k.column).join(parents.select(F.col("id").alias(k.column)), k.column).select("id")
                found[k.child] = found[k.child].unionByName(ids) if k.child in found else ids
        for t, ids in found.items():
            for known in (gone.get(t), fresh.get(t)):
                ids = ids if known is None else ids.join(known, "id", "left_anti")
            new = cut(ids.distinct())
            if not new.isEmpty():
                fresh[t] = fresh[t].unionByName(new) if t in fresh else new
    left = {t: df.join(gone[t].withColumn("_gone", F.lit(True)), "id", "left").where("_gone is null").select(*df.columns) if t in gone else df for t, df in tables.items()}
    for k in keys:
        if k.on_delete == "SET NULL" and k.parent in gone:
            lost = gone[k.parent].select(F.col("id").alias("_lost"), F.lit(True).alias("_hit"))
            df = left[k.child]
            joined = df.join(lost, F.col(k.column) == F.col("_lost"), "left")
            left[k.child] = joined.withColumn(k.column, F.when(F.col("_hit").isNull(), F.col(k.column))).select(*df.columns)
    return Deletion(gone, left)


def files(documents: DataFrame, deletion: Deletion) -> DataFrame:
    """(id, storage_path) of the documents that go: the files to remove once their rows are."""
    if "documents" not in deletion.gone:
        return documents.select("id", "storage_path").limit(0)
    return documents.select("id", "storage_path").join(deletion.gone["documents"], "id", "left_semi")
