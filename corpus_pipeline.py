"""A training corpus from `documents`: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on every row that it is given; all but the last return the
columns that they were given, whatever these are called. Decisions are joined back by id and a hash of the text, so rows of equal id and
different texts have decisions of their own, and null ids are like any other; null and empty texts fail the quality rules, and texts of any
length are taken whole; an empty table gives an empty one. Each stage's output is written as Parquet and read again, which cuts lineage and lets a failed run go on from there.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import discard, scratch, table
from docketry.llm.decontamination import judged, overlap
from docketry.llm.mixing import mix, word_count
from docketry.llm.near_dedup import near_duplicates
from docketry.llm.quality import judge
from docketry.llm.sharding import assign_shards

SHARDS = 24


def _kept(docs: DataFrame, found: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs joined with decisions of (doc_id, text_hash, ...): `row`, the whole row in a struct, so that no column's name can clash, id and hash, and what `how` keeps of the decisions."""
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    known = found.withColumnsRenamed({"doc_id": "known_id", "text_hash": "known_hash"})
    return keyed.join(known, F.equal_null("id", "known_id") & (F.col("hash") == F.col("known_hash")), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Rows equal in id and text have one decision; no documents give none."""
    decided = judge(docs).where("kept").select("doc_id", "text_hash")
    return _kept(docs, decided).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one of rows equal in id and text, null ids included."""
    kept = near_duplicates(docs).where("kept").select("doc_id", "text_hash")
    return _kept(docs, kept).groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate. Rows equal in id and text have one decision."""
    found = judged(overlap(docs, table(spark, sf_dir, "benchmark")))
    return _kept(docs, found.where("not contaminated").select("doc_id", "text_hash")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows equal in id and text, of which near_dedup leaves one, get as many copies each, rounded up."""
    mixed = mix(docs, word_count(F.col("text")), tag=F.xxhash64("text"))
    taken = mixed.groupBy("doc_id", F.col("tag").alias("text_hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    spread = F.ceil(F.col("copies") / F.col("rows")).cast("int")
    return _kept(docs, taken.where("copies > 0"), "inner").withColumn("copy", F.explode(F.sequence(F.lit(1), spread))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every copy."""
    return assign_shards(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Minimum-covariance-determinant steps, MinHash links and error-diffused copies have no SQL form. The tests
#: hold each stage on its own input: near-duplicates against brute force, decontamination against OP1_SQL, mixing against
#: targets worked out plainly, quality rules and sharding against their operators, whose own tests have a brute force each, and
#: run() against the stages one after the other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                discard(spark, before)
            before = path
    return docs
