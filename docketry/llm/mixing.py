"""Mixing sources to target weights by entropy balancing."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import SPACE, cores, cut, small, table

#: Rows (each of some alike) of a source that are rounded together; a source has as many blocks as it needs.
BLOCK_ROWS = 4096


def word_count(text: Column) -> Column:
    """The number of runs of anything but ASCII white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def water_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """`target` for each row of (source, source_size): a share of all sizes by weight, at most cap * size.

    Sources get the weights in turn, by code point, null last. What a capped source leaves is shared out
    by weight among the others until none is above its cap: the level at which min(cap * size,
    level * weight) adds up to the whole. Works on one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("_w", weight).withColumn("_cap", F.lit(float(cap)) * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy()
    below = Window.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # If all sources before this one in the order of filling are full, the rest share what is left.
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))
    open_ = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(below), F.lit(0.0))
    levels = ranked.withColumn("_level", F.greatest(left, F.lit(0.0)) / open_)
    # Right at the first source that its level doesn't fill; after it, where full sources are taken for
    # granted that aren't, levels only fall.
    level = F.max(F.when(F.col("_level") < F.col("_full"), F.col("_level"))).over(whole)
    return levels.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))).select("source", "source_size", "target")


def tilt(documents: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-9, steps: int = 100) -> DataFrame:
    """(source, tilt, scale): the dual variables of entropy balancing, found by Newton steps summed over all documents.

    `documents` has source, prior (positive), size, n (documents alike in these). Among all rates, those nearest to the
    priors by relative entropy that meet the token constraints sum(n * rate * size) = target are
    prior * exp(tilt of the source * size / scale), at most cap; scale is the source's mean size. A constraint concerns the
    documents of one source, so the Hessian is diagonal and a step is two sums per source. Raises ValueError if a source hasn't
    converged after `steps`.
    """
    documents = cut(documents, cores(documents.sparkSession))
    filled = F.when(F.col("size") > 0, F.col("size"))
    spans = documents.groupBy("source").agg(
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("size")), F.sum(F.when(F.col("size") > 0, F.col("n")))), F.lit(1.0)).alias("scale"), F.coalesce(F.min(filled), F.lit(1)).alias("_least"),
        F.min("prior").alias("_low"), F.sum(F.col("prior") * F.col("n") * F.col("size")).alias("_all"),
    )
    # Where all documents are at the cap, and where even the smallest ones leave no more than the target.
    hi = F.greatest(F.lit(0.0), F.log(F.lit(cap) / F.col("_low")) * F.col("scale") / F.col("_least") * (1 + 1e-12))
    lo = F.least(F.lit(0.0), F.coalesce(F.log(F.try_divide(F.col("target"), F.col("_all"))) * F.col("scale") / F.col("_least"), F.lit(0.0)))
    first = targets.join(spans.withColumnRenamed("source", "_s"), F.equal_null("source", "_s"))
    full = F.col("target") >= F.lit(cap) * F.col("source_size")
    dual = cut(first.select("source", "target", "scale", F.when(full, hi).otherwise(0.0).alias("tilt"), lo.alias("lo"), hi.alias("hi")), 1)
    for _ in range(steps):
        raw = F.col("prior") * F.exp(F.col("tilt") * F.col("size") / F.col("scale"))
        words = F.col("n") * F.col("size")
        slope = F.when(raw < cap, raw * words * F.col("size") / F.col("scale")).otherwise(0.0)
        known = small(dual.withColumnRenamed("source", "_s"))
        sums = documents.join(known, F.equal_null("source", "_s")).groupBy("source", "target", "scale", "tilt", "lo", "hi").agg(F.sum(F.least(raw, F.lit(cap)) * words).alias("_f"), F.sum(slope).alias("_h"))
        gap = F.col("target") - F.col("_f")
        step = F.col("tilt") + F.when(F.col("_h") > 0, gap / F.col("_h")).otherwise(F.lit(float("inf")))
        # The sum grows with the tilt, so each step also narrows where the root is; a step out of there halves it.
        new_lo, new_hi = F.when(gap > 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap < 0, F.col("tilt")).otherwise(F.col("hi"))
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        new = F.when(off <= tolerance, F.col("tilt")).when((step > new_lo) & (step < new_hi), step).otherwise((new_lo + new_hi) / 2)
        moved = cut(sums.select("source", "target", "scale", new.alias("tilt"), new_lo.alias("lo"), new_hi.alias("hi"), off.alias("_off")), 1)
        most = moved.agg(F.max("_off")).first()[0]
        dual = moved.drop("_off")
        if most is None or most <= tolerance:
            return dual.select("source", "tilt", "scale")
    raise ValueError(f"a source misses its target by a share of {most} after {steps} steps")


def rounded(size: np.ndarray, rate: np.ndarray, n: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies of rows in falling order of size, each standing for n alike, in sum over these.

    Copies are the rate rounded down or up, by what rows before it were rounded off; what is owed in the end is made good by
    the largest rows that are no larger than that.
    """
    copies, owed = np.where(size > 0, 0, n), 0.0
    for i in np.flatnonzero(size > 0):
        owed += size[i] * rate[i] * n[i]
        copies[i] = min(math.ceil(rate[i] * n[i] - 1e-9), max(math.floor(rate[i] * n[i] + 1e-9), round(owed / size[i])))
        owed -= size[i] * copies[i]
    for i in np.flatnonzero(size > 0):
        more = min(cap * n[i] - copies[i], max(-copies[i], round(owed / size[i])))
        copies[i] += more
        owed -= size[i] * more
    return copies


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", prior: Column | None = None, tag: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per input row: id, tag (if given), size, source_size, target, rate, copies, taken (copies * size).

    Rates are the entropy-balancing ones of `tilt`, so each document has its own; they are rounded to whole copies in blocks of a
    source by `rounded`, so a block misses its part by about its smallest document and no task ever holds a whole
    source. A null source is a source; a document without words takes part with size 0 and is kept once. Ids of any type may be null or
    repeat: rows alike in id, tag, source, size and prior are counted first, so they never meet in one task, and share their copies
    as evenly as may be. Texts of any length, other columns of any name; an empty table gives an empty result.
    The same rows give the same result in any order.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), (F.lit(1.0) if prior is None else prior.cast("double")).alias("prior"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
    alike = cut(rows.groupBy("source", "id", "tag", "size", "prior").agg(F.count("*").alias("n")), 2 * cores(docs.sparkSession))
    documents = alike.groupBy("source", "prior", "size").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    sizes = cut(documents.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("rows").alias("rows")), 1)
    targets = cut(water_targets(sizes.select("source", "source_size"), weights, share, cap), 1)
    duals = tilt(documents.drop("rows"), targets, float(cap))
    blocks = sizes.select(F.col("source").alias("_b"), F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"))
    known = targets.join(blocks, F.equal_null("source", "_b")).drop("_b").join(duals.withColumnRenamed("source", "_s"), F.equal_null("source", "_s")).drop("_s").withColumnRenamed("source", "_source")
    rated = alike.join(small(cut(known, 1)), F.equal_null(F.col("source"), F.col("_source"))).withColumn("rate", F.least(F.col("prior") * F.exp(F.col("tilt") * F.col("size") / F.col("scale")), F.lit(float(cap))))
    block = F.pmod(F.xxhash64("id", "tag"), F.col("blocks")).cast("long")
    kind = rows.schema["id"].dataType.simpleString()

    def copied(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("h", "ascending"), ("id", "ascending"), ("tag", "ascending"), ("prior", "ascending")])
        of = lambda c: group.column(c).to_numpy()
        return group.select(["id", "tag", "size", "source_size", "target", "rate", "n"]).append_column("copies", pa.array(rounded(of("size"), of("rate"), of("n"), cap)))

    placed = rated.select("source", block.alias("block"), "id", "tag", "size", F.xxhash64("id").alias("h"), "source_size", "target", "rate", "n", "prior")
    out = placed.groupBy("source", "block").applyInArrow(copied, f"id {kind}, tag long, size long, source_size long, target double, rate double, n long, copies long")
    # As many rows again as there were, in runs of bounded length.
    runs = out.withColumn("_run", F.explode(F.sequence(F.lit(0), F.expr("(n - 1) div 4096"))))
    each = runs.withColumn("_i", F.explode(F.expr("sequence(_run * 4096, least(n, (_run + 1) * 4096) - 1)")))
    copies = F.expr("copies div n") + F.when(F.col("_i") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return each.select(F.col("id").alias(id_col), *([] if tag is None else ["tag"]), "size", "source_size", "target", "rate", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), word_count(F.col("text")), tag=F.xxhash64("text")).drop("tag", "rate", "copies")
