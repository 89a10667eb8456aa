"""Substring search through an inverted index of three-letter pieces, in place of a scan of every row."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.store import Folder

#: Letters of a piece; shorter queries are answered by a scan.
LENGTH = 3
#: Postings that one task sorts and writes.
TASK_POSTINGS = 1_000_000
#: Where even the rarest piece is in more than this share of rows, a scan reads less than the index.
COMMON = 0.5


def pieces_of(value: Column) -> Column:
    """The distinct three-letter pieces of a text in lower case."""
    low = F.lower(value)
    at = F.sequence(F.lit(1), F.length(low) - (LENGTH - 1))
    return F.when(F.length(low) >= LENGTH, F.array_distinct(F.transform(at, lambda i: F.substr(low, i, F.lit(LENGTH))))).otherwise(F.array().cast("array<string>"))


def pieces_in(query: str) -> list[str]:
    """The pieces that a value must hold to match the query; % and _ are wildcards and part it."""
    found = {run[i : i + LENGTH] for run in re.split("[%_]", query.lower()) for i in range(len(run) - LENGTH + 1)}
    return sorted(found)


@dataclass
class TrigramIndex:
    """Postings (field, piece, key, value) in Parquet, sorted by field and piece, a folder for each batch of rows that was added.

    A piece's postings lie side by side, so a search reads the row groups and pages that hold its pieces and nothing else. They carry the
    value, so hits are verified without the table. Common pieces are rows like others, not long arrays. Keys are unique in the table; a row that changed is removed and added.
    """

    spark: SparkSession
    path: str
    key: str
    fields: tuple[str, ...]
    page_rows: int = 1000  # what a reader skips or takes as one

    def __post_init__(self):
        self.folder = Folder(self.spark, self.path)

    def _batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names("added") if n.startswith("batch=") and self.folder.exists(f"added/{n}/pieces/_SUCCESS"))

    def add(self, number: int, rows: DataFrame) -> None:
        """Index the rows of a batch; one that is added again replaces itself."""
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in self.fields]))
        values = rows.select(F.col(self.key).alias("key"), each.alias("_e")).select("key", "_e.*").where("value is not null")
        postings = values.select("field", F.explode(pieces_of(F.col("value"))).alias("piece"), "key", "value")
        at = f"{self.path}/added/batch={number}"
        most = sum(F.coalesce(F.sum(F.greatest(F.length(F.col(f).cast("string")) - (LENGTH - 1), F.lit(0))), F.lit(0)) for f in self.fields)
        tasks = -(-rows.agg(most.alias("n")).first()["n"] // TASK_POSTINGS) or 1
        postings.repartitionByRange(tasks, "field", "piece", "key").sortWithinPartitions("field", "piece", "key").write.mode("overwrite").option("parquet.page.row.count.limit", self.page_rows).parquet(f"{at}/postings")
        rows.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/rows")
        counted = self.spark.read.parquet(f"{at}/postings").groupBy("field", "piece").agg(F.count("*").alias("n"))
        counted.repartitionByRange("field", "piece").sortWithinPartitions("field", "piece").write.mode("overwrite").parquet(f"{at}/pieces")

    def remove(self, number: int, keys: DataFrame) -> None:
        """Forget rows of batches before `number`."""
        keys.select(F.col(self.key).alias("key")).distinct().write.mode("overwrite").parquet(f"{self.path}/removed/batch={number}")

    def _read(self, what: str) -> DataFrame:
        """One part of every batch, with its number."""
        found = None
        for b in self._batches():
            one = self.spark.read.parquet(f"{self.path}/added/batch={b}/{what}").withColumn("batch", F.lit(b))
            found = one if found is None else found.unionByName(one)
        if found is None:
            raise ValueError("nothing was indexed")
        return found

    def rarest(self, field: str, query: str) -> list[tuple[int, str]]:
        """(rows, piece) of the query's pieces, those that the fewest rows hold first."""
        wanted = pieces_in(query)
        rows = self._read("pieces").where((F.col("field") == field) & _either("piece", wanted)).groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece of the query
        counts = {r.piece: r.n for r in rows}
        return sorted((counts.get(p, 0), p) for p in wanted)

    def size(self) -> int:
        return self._read("rows").agg(F.sum("n")).first()[0]

    def candidates(self, field: str, query: str, pieces: list[str]) -> DataFrame:
        """(key) of the rows whose field holds the query, out of the postings of the first of its pieces, which is to be the rarest.

        Each posting carries its value, so it is verified where it is read: nothing is grouped or sorted, and no other piece's postings are read.
        """
        lists = self._read("postings").where((F.col("field") == field) & (F.col("piece") == pieces[0]) & F.col("value").ilike(f"%{query}%".replace("\\", "\\\\")))
        if self.folder.exists("removed"):
            gone = self.spark.read.parquet(f"{self.path}/removed").groupBy("key").agg(F.max("batch").alias("_gone"))
            lists = lists.join(gone, "key", "left").where(F.col("_gone").isNull() | (F.col("batch") >= F.col("_gone")))
        return lists.select("key")

    def keys(self, query: str, fields: tuple[str, ...] | None = None) -> DataFrame | None:
        """(key) of the rows that have the query in one of the fields; None where a scan reads less: no piece of three letters, or only common ones."""
        if not pieces_in(query):
            return None
        most, found = COMMON * self.size(), None
        for field in fields or self.fields:
            rare = self.rarest(field, query)
            if rare[0][0] > most:
                return None
            hits = self.candidates(field, query, [p for _, p in rare])
            found = hits if found is None else found.unionByName(hits)
        return found.distinct() if len(fields or self.fields) > 1 else found

    def search(self, table: DataFrame, query: str, limit: int, fields: tuple[str, ...] | None = None) -> DataFrame:
        """The first `limit` rows by key that have the query in one of the fields.

        Only the hits' keys are sorted; at most `limit` of them go to the table as equalities, which its files are pruned by.
        """
        hits = self.keys(query, fields)
        if hits is None:
            return _scan(table, fields or self.fields, query).orderBy(self.key).limit(limit)
        first = [r.key for r in hits.orderBy("key").limit(limit).collect()]
        return table.where(_either(self.key, first)).orderBy(self.key)

    def matching(self, table: DataFrame, query: str, fields: tuple[str, ...] | None = None) -> DataFrame:
        """All rows that have the query in one of the fields."""
        hits = self.keys(query, fields)
        if hits is None:
            return _scan(table, fields or self.fields, query)
        return table.join(hits.withColumnRenamed("key", self.key), self.key, "left_semi").select(*table.columns)


def _either(column: str, values: list) -> Column:
    """Equalities, which Parquet's pages are pruned by, where a long list would only give its least and its largest value."""
    hit = F.lit(False)
    for v in values:
        hit = hit | (F.col(column) == F.lit(v))
    return hit


def _scan(table: DataFrame, fields: tuple[str, ...], query: str) -> DataFrame:
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.col(f).cast("string").ilike(f"%{query}%".replace("\\", "\\\\"))
    return table.where(hit)
