"""Quality rules: base statistics and robust multivariate outliers, with DataFrame functions only."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import BROADCAST_ROWS, cores, cut, table, words

#: A window's place in its text takes so many bits of a sorted long, the rest are of its hash. No text has more
#: words: Spark's strings have 2^31 bytes at most.
PLACE_BITS = 30
#: Share of a group's rows that the minimum covariance determinant is taken over.
COVERAGE = 0.6
#: So many rows of its language stand beside a group's own: small groups are close to their language, large ones to themselves.
SHRINK = 20
#: The chance that a row of a normal population is rejected.
REJECT = 1e-5
#: Share of a normal population that the last estimate is made from.
REWEIGHTED = 0.975
#: A group's concentration ends with the step by which its determinant's root falls by less than this, on a log scale. It can't fall below
#: that of the least spreads, so every group ends.
SETTLED = 1e-3
#: The statistics that are compared. Least spread of each: in most groups most documents have no symbols or repeats at all, and a
#: covariance of these is singular. Sampling spread of a document of one word, which falls with the root of its length: symbols come as a
#: Poisson count, whose square root has spread 1/2; repeats come some words at a time; word lengths differ by about half, on a log scale.
SPREADS = {"word_length": (0.02, 0.5), "symbol_rate": (0.03, 0.5), "line_repeats": (0.1, 1.0), "word_repeats": (0.1, 2.2)}


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word).

    Words in three-word windows found twice or more: the windows' hashes are sorted together with their
    places, equal neighbours mark places, and the marked windows are added up without their overlaps.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    split = docs.withColumns({"_w": words(text), "_l": lines, "n_symbols": symbols.cast("long")}).drop(text_col)
    w, n = F.col("_w"), F.size("_w")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashed = split.select("*", F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))).alias("_h"))
    mask = (1 << PLACE_BITS) - 1
    h = F.col("_h")
    sorted_ = hashed.select("*", F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, PLACE_BITS), PLACE_BITS) + i)).alias("_s"))
    s = F.col("_s")
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    same = lambda x, y: (F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)) & (F.get(h, place(x)) == F.get(h, place(y)))
    twice = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
    marked = sorted_.select("*", F.sort_array(F.transform(twice, place)).alias("_p"))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + (p + 3 - F.greatest(p, a["end"]))).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )
    known = [c for c in docs.columns if c != text_col]
    return marked.select(
        *known, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"), F.size("_l").cast("long").alias("n_lines"),
    )


def _chi2_cdf(x: float, df: float) -> float:
    """The lower regularized gamma function of df / 2 at x / 2, by its series."""
    a, x = df / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, df: float) -> float:
    lo, hi = 1e-9, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < p else (lo, mid)
    return lo


def _factor(names: list[str], spread: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Of a covariance c_j_i with the least variances added: v_i, its diagonal, and l_i_j, its lower factor."""
    v = {(i, j): F.col(f"c_{j}_{i}") + (F.lit(spread[a][0] ** 2) if i == j else F.lit(0.0)) for i, a in enumerate(names) for j in range(i + 1)}
    low: dict[tuple[int, int], Column] = {}
    for i in range(len(names)):
        for j in range(i + 1):
            x = v[i, j]
            for k in range(j):
                x = x - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(x, F.lit(1e-12))) if i == j else x / low[j, j]
    return {f"v_{i}": v[i, i] for i in range(len(names))} | {f"l_{i}_{j}": x for (i, j), x in low.items()}


def _distance(names: list[str], spread: dict[str, tuple[float, float]], length: Column) -> Column:
    """The squared Mahalanobis distance, by forward substitution in the columns of _factor.

    A statistic's difference counts by the root of the share that its group's variance has of this and of the sampling variance at the row's length.
    """
    y: list[Column] = []
    for i, a in enumerate(names):
        x = (F.col(a) - F.col(f"m_{i}")) * F.sqrt(F.col(f"v_{i}") / (F.col(f"v_{i}") + F.lit(spread[a][1] ** 2) / length))
        for j in range(i):
            x = x - F.col(f"l_{i}_{j}") * y[j]
        y.append(x / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in y[1:]), y[0] * y[0])


def outliers(rows: DataFrame, groups: list[str], spread: dict[str, tuple[float, float]], length: str = "n_words", coverage: float = COVERAGE) -> DataFrame:
    """rows with `distance`: the squared robust Mahalanobis distance from the row's group; null where the group has no fitted row.

    `fit` (boolean) says which rows an estimate is made from, the keys of `spread` are the statistics, each with its least and its sampling spread.
    The minimum covariance determinant is approached by concentration: take the `coverage` share of rows nearest to the current
    estimate, estimate their mean and covariance, and repeat until the group's determinant falls no more. It starts from the medians and absolute deviations and from
    the mean and covariance of all rows; of both ends the one of the smaller determinant counts, and is estimated once more from all rows within the
    REWEIGHTED quantile. Estimates are made of each group and of its first column's group, and a
    group's own, by its rows, is averaged with that of the latter, by SHRINK rows. Everything is sums and sketched quantiles by group; a group's
    parameters are one row.
    """
    names, key = list(spread), ["_k0", "_k1", "_start"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    text = lambda g: F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit(""))
    keyed = cut(rows.withColumns({"_k0": text(groups[0]), "_k1": text(groups[1])}), 2 * cores(rows.sparkSession))
    # Each fitted row in its group and in the whole of its first column's, for either start.
    levels = keyed.where("fit").select("_k0", F.explode(F.array(F.col("_k1"), F.lit("*"))).alias("_k1"), length, *names)
    fitted = levels.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1))))
    means, covs = [F.avg(a).alias(f"m_{i}") for i, a in enumerate(names)], [F.covar_pop(names[j], names[i]).alias(f"c_{j}_{i}") for i, j in pairs]
    # A row of parameters for each group and start: their number, and so whether they are broadcast, is found once.
    few = 4 * keyed.select("_k0", "_k1").distinct().count() <= BROADCAST_ROWS
    hinted = lambda df: F.broadcast(df) if few else df
    # Expressions go by names, so they are put together once for all steps.
    away, factored = _distance(names, spread, F.col(length)), _factor(names, spread)
    near = lambda df, params, on: df.join(hinted(params), on).withColumn("_d", away)
    consistent = lambda factor: {f"c_{j}_{i}": factor * F.col(f"c_{j}_{i}") for i, j in pairs}

    det = sum((F.log(f"l_{i}_{i}") for i in range(1, len(names))), F.log("l_0_0"))

    def determined(params: DataFrame, scaled: dict[str, Column]) -> DataFrame:
        """params with their covariances made consistent, factored, and `det`, the logarithm of the determinant's root."""
        return cut(params.withColumns(scaled).withColumns(factored).withColumn("det", det), 1)

    middle = cut(levels.groupBy("_k0", "_k1").agg(*[F.percentile_approx(a, 0.5, 10000).alias(f"m_{i}") for i, a in enumerate(names)]), 1)
    off = levels.join(hinted(middle), ["_k0", "_k1"]).groupBy("_k0", "_k1").agg(*[F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{i}")), 0.5, 10000).alias(f"d_{i}") for i, a in enumerate(names)])
    first = off.join(middle, ["_k0", "_k1"]).select("_k0", "_k1", F.lit(0).alias("_start"), *[f"m_{i}" for i in range(len(names))], *[(F.pow(1.4826 * F.col(f"d_{i}"), 2) if i == j else F.lit(0.0)).alias(f"c_{j}_{i}") for i, j in pairs])
    params = determined(first.unionByName(levels.groupBy("_k0", "_k1").agg(F.lit(1).alias("_start"), *means, *covs)), consistent(1.0))
    # Of a normal population's covariance, the nearest share shows this part.
    part = lambda share: share / _chi2_cdf(chi2_quantile(share, len(names)), len(names) + 2)
    settled, step, core = None, 0, consistent(part(coverage))
    while step == 0 or not params.isEmpty():  # only groups that still fall are in params, and only their rows are joined
        limit = cut(near(fitted, params, key).groupBy(*key).agg(F.percentile_approx("_d", coverage, 10000).alias("_limit")), 1)
        inside = near(fitted, params.join(limit, key), key).where("_d <= _limit").groupBy(*key)
        moved = determined(inside.agg(*means, *covs, F.any_value("det").alias("_before")), core)
        fell = F.col("_before") - F.col("det")
        falls = F.lit(step == 0) | F.coalesce((fell >= SETTLED) & ~F.isnan(fell), F.lit(False))
        ended = moved.where(~falls).drop("_before")
        settled, params, step = ended if settled is None else settled.unionByName(ended), moved.where(falls).drop("_before"), step + 1
    params = cut(settled, 1)
    held = [c for c in params.columns if c not in (*key, "det")]
    best = params.groupBy("_k0", "_k1").agg(F.min_by(F.struct(*held), F.struct("det", "_start")).alias("_p")).select("_k0", "_k1", "_p.*")
    inside = near(levels, cut(best, 1), ["_k0", "_k1"]).where(F.col("_d") <= chi2_quantile(REWEIGHTED, len(names)))
    moments = [f"m_{i}" for i in range(len(names))] + [f"c_{j}_{i}" for i, j in pairs]
    last = cut(inside.groupBy("_k0", "_k1").agg(F.count("*").alias("_n"), *means, *covs).withColumns(consistent(part(REWEIGHTED))), 1)
    whole = last.where("_k1 = '*'").select(F.col("_k0").alias("_w"), *[F.col(c).alias(f"_{c}") for c in moments])
    share = F.col("_n") / (F.col("_n") + SHRINK)
    mixed = last.where("_k1 <> '*'").join(whole, F.col("_k0") == F.col("_w")).select("_k0", "_k1", *[(share * F.col(c) + (1 - share) * F.col(f"_{c}")).alias(c) for c in moments])
    final = cut(mixed.withColumns(factored), 1)
    found = keyed.join(hinted(final), ["_k0", "_k1"], "left")
    return found.select(*rows.columns, _distance(names, spread, F.greatest(F.col(length), F.lit(1))).alias("distance"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reject: float = REJECT) -> DataFrame:
    """One row per input row: id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. Other rows are
    kept unless their squared distance from their language's and source's robust centre is beyond the
    chi-square quantile of 1 - reject. Null and empty texts have no words and fail; null languages and
    sources are groups of their own; a language's single row is its own centre; ids of any type may be null or repeat; other
    columns are ignored; texts of any length are taken whole; an empty table gives an empty result. text_hash tells rows of equal id apart.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    counted = statistics(raw)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    rows = counted.withColumns({
        "base_failed": failed, "fit": ~failed,
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "symbol_rate": F.sqrt(F.col("n_symbols") / n),
        "line_repeats": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), "word_repeats": F.sqrt(F.col("n_repeat_words") / n),
    })
    scored = outliers(cut(rows), ["lang", "source"], SPREADS)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - reject, len(SPREADS)), F.lit(True))
    return scored.select(F.col("id").alias(id_col), "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("text_hash", "distance")
