"""What the text operators share: reading tables, scratch folders, size-checked broadcasts."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of the plain word rule.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows, and characters of their text form, up to which a table is broadcast once a count has found it so small.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and is a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder, in at most `parts` files.

    parts is 1 for tables of a row per group, and some cores() for narrow rows out of many small partitions. Rows are dealt out anew
    for it, so the work before runs in as many tasks as it would without.
    """
    shared_dir(df.sparkSession)
    return (df if parts is None else df.repartition(parts)).checkpoint()


def cores(spark: SparkSession) -> int:
    """Tasks that can run at once: it grows with the cluster."""
    return spark.sparkContext.defaultParallelism


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether a count finds df's rows and their sizes small enough for a broadcast."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return n <= rows and size <= chars


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it fits; otherwise Spark picks a shuffled join."""
    return F.broadcast(df) if fits(df) else df


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column, separators: str = SPACE) -> Column:
    """The non-empty pieces between separators; null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), separators)
    return F.array_remove(pieces, "")
