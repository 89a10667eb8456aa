"""Tables stored so that lookups skip most of them: sorted by a business key, with Bloom filters on their ids."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.lookups import by_key

#: Bytes of a row group: what a lookup reads or skips.
GROUP_BYTES = 8 << 20


def write(
    df: DataFrame, path: str, key: str, filtered: tuple[str, ...] = (), files: int | None = None, group_bytes: int = GROUP_BYTES, made: Callable[[DataFrame], DataFrame] | None = None, rows: int | None = None
) -> None:
    """Ranges of the key and then of `filtered`, sorted within, so rows of one key, or without one, are as many files as their number asks for: a file's and row group's least and largest key tell most lookups to pass it over.

    The columns in `filtered`, which lie about in that order, get a Bloom filter in each row group, sized for as many values as a file has rows.
    Where `made` is given, df has what the rows are made of, with the key and `filtered`; it makes each row out of one of df's after these are dealt and sorted, so that only they are shuffled.
    `rows` is about how many there are, where that is known without working df out; otherwise they are counted.
    """
    options = {"compression": "zstd", "parquet.block.size": str(group_bytes), "parquet.block.row.count.limit": "100000"}
    if filtered:
        rows = df.count() if rows is None else rows
        each = max(1, -(-rows // max(1, files or 1)))
        for c in filtered:
            options |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(min(each, 100_000))}
    order = (key, *(c for c in filtered if c != key))
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    lying = dealt.sortWithinPartitions(*order)
    (made(lying) if made else lying).write.mode("overwrite").options(**options).parquet(path)


def find(spark: SparkSession, path: str, column: str, value: object) -> DataFrame:
    """At most one row by a unique column: the comparison goes to the files as it is."""
    return by_key(spark.read.parquet(path), column, value)


def find_many(spark: SparkSession, path: str, column: str, values: list) -> DataFrame:
    """Rows of a few values, each an equality of its own, which Bloom filters and pages are asked for."""
    hit = F.lit(False)
    for v in values:
        hit = hit | (F.col(column) == F.lit(v))
    return spark.read.parquet(path).where(hit)
