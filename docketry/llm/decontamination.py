"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower, cut, fits, table, words

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A fingerprint packs a gram hash of HASH_BITS over its position in POSITION_BITS, which is enough for any text: Spark's strings
#: have 2^31 bytes at most.
POSITION_BITS, HASH_BITS = 30, 33


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), SEPARATORS)


def _packed(hashes: str, k: int) -> Column:
    """Array of packed fingerprints of all k-grams, from the array column of word hashes."""
    h = F.col(hashes)
    n = F.size(h) - (k - 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    gram = lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)])
    return F.transform(starts, lambda i: F.shiftleft(F.shiftrightunsigned(gram(i), 64 - HASH_BITS), POSITION_BITS) + i)


def fingerprints(rows: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """rows, which have the array of words `w`, with `fp`: the packed fingerprints that are kept.

    Winnowing: of every `window - k + 1` k-grams in a row the least hash is kept, the leftmost of equal
    ones, so two texts that share `window` words in a row keep the same gram of them. For each length in
    `short` all grams of that length are kept: no shorter span is sure to hold a winnowed one.
    """
    span = window - k + 1
    grammed = rows.withColumn("_h", F.transform("w", lambda x: F.xxhash64(x)))
    grammed = grammed.withColumn("_g", _packed("_h", k))
    g = F.col("_g")
    n = F.size(g) - (span - 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    least = F.transform(starts, lambda i: F.least(*[F.get(g, i + j) for j in range(span)]))
    kept = F.array_distinct(least)
    return grammed.withColumn("fp", F.concat(kept, *[_packed("_h", m) for m in short]) if short else kept).drop("_h", "_g")


def _exploded(rows: DataFrame, *more: Column) -> DataFrame:
    """A row for each fingerprint: `h` and its position `p`; nulls where there is none.

    (A plain explode would have its input evaluated once more, in a filter for empty arrays.)
    """
    mask = (1 << POSITION_BITS) - 1
    return rows.withColumn("_f", F.explode_outer(F.concat("fp", *more) if more else F.col("fp"))).withColumns({
        "h": F.shiftright("_f", POSITION_BITS), "p": F.col("_f").bitwiseAND(F.lit(mask)).cast("int"),
    }).drop("_f", "fp")


def overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5) -> DataFrame:
    """One row per input row: id, text_hash, n_words, spans, items.

    `spans` are the word ranges [lo, hi) of the document that are in occurrences of an item's windows
    (`window` words in a row, or the whole of a shorter item), as an array of disjoint structs; `items` the ids of those
    items, without null ids. Null and empty texts have no words; items without words never occur.
    Equal ids with different texts are told apart, equal rows each get a row; other columns are ignored.

    Texts of any length are taken whole; an empty table gives an empty result.

    Fingerprints are joined by hash, then each hit is extended word by word as far as a window around it
    can reach, and kept if a whole window matches. The benchmark's side is broadcast if a count finds it small; documents are read once then.
    Otherwise hashes alone are shuffled to find which of them the benchmark has, and the documents that have some are read again: of a
    hit only the words that a window can reach travel to the benchmark's.
    """
    reach = window - k
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), item_words(F.col(item_text)).alias("w")).withColumn("n", F.size("w"))
    short = sorted(r.n for r in items.where((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect())  # below `window`
    near = lambda at, width, lead: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.get("w", at - lead + j))
    sides = [
        _exploded(fingerprints(items.where(F.col("n") >= window), window, k, [])).select("h", F.lit(k).alias("k"), F.lit(reach).alias("r"), near(F.col("p"), window + reach, reach).alias("c"), "item")
    ] + [
        _exploded(items.where(F.col("n") == m).withColumn("fp", F.transform("w", lambda x: F.xxhash64(x))).withColumn("fp", _packed("fp", m))).select("h", F.lit(m).alias("k"), F.lit(0).alias("r"), F.col("w").alias("c"), "item")
        for m in short
    ]
    known = sides[0]
    for side in sides[1:]:
        known = known.unionByName(side)
    # Items that share a passage share a row, so what many items repeat is extended once.
    known = known.where(F.col("h").isNotNull()).groupBy("h", "k", "r", "c").agg(F.collect_set("item").alias("items")).withColumnRenamed("h", "_h")
    broadcast = fits(known)

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    worded = lambda df: df.withColumn("w", item_words(F.col("text"))).drop("text")
    # A negative fingerprint stands for the row itself.
    itself = F.array(-F.lit(1 << POSITION_BITS) * (F.pmod("t", F.lit(1 << 20)) + 1))
    if broadcast:
        grams = _exploded(fingerprints(worded(texts), window, k, short).withColumn("n", F.size("w")), itself)
        near_words = lambda j: F.get("w", F.col("p") - F.col("r") + j)
        known = F.broadcast(known)
    else:
        hashes = _exploded(fingerprints(worded(texts), window, k, short)).where(F.col("h").isNotNull()).select("id", "t", "h")
        shared = cut(hashes.join(known.select("_h").distinct(), F.col("h") == F.col("_h"), "left_semi").groupBy("id", "t").agg(F.collect_set("h").alias("hs")).withColumnsRenamed({"id": "_i", "t": "_t"}))
        found = worded(texts.join(shared, F.equal_null("id", "_i") & (F.col("t") == F.col("_t")), "left").drop("_i", "_t"))
        printed = fingerprints(found, window, k, short).withColumn("fp", F.coalesce(F.filter("fp", lambda x: F.array_contains("hs", F.shiftright(x, POSITION_BITS))), F.array().cast("array<long>")))
        grams = _exploded(printed.withColumn("n", F.size("w")).drop("hs"), itself)
        # The words from `reach` before the gram to the end of a window that begins with it.
        from_ = F.greatest(F.col("p") - reach, F.lit(0))
        grams = grams.select("id", "t", "n", "h", "p", from_.alias("f"), F.slice("w", from_ + 1, F.lit(window + reach)).alias("w"))
        near_words = lambda j: F.get("w", F.col("p") - F.col("r") + j - F.col("f"))
    joined = grams.join(known, F.col("h") == F.col("_h"), "left").where((F.col("h") < 0) | F.col("_h").isNotNull())
    same = F.transform(F.sequence(F.lit(0), F.size("c") - 1), lambda j: F.coalesce((near_words(j) == F.get("c", j)) & (F.col("p") - F.col("r") + j >= 0), F.lit(False)))
    extended = joined.select("id", "t", "n", "h", "p", "k", "r", "items", F.when(F.col("h") >= 0, same).alias("e"))
    run = lambda part: F.when(F.array_position(part, False) > 0, F.array_position(part, False) - 1).otherwise(F.size(part)).cast("int")
    left, right = run(F.reverse(F.slice("e", 1, F.col("r")))), run(F.slice("e", F.col("r") + F.col("k") + 1, F.col("r")))
    core = F.forall(F.slice("e", F.col("r") + 1, F.col("k")), lambda x: x)
    # Where no more than k words are asked for, the gram is the window.
    whole = core & (left + right + F.col("k") >= F.when(F.col("r") > 0, window).otherwise(F.col("k")))
    found = extended.select("id", "t", "n", "h", "items", F.when((F.col("h") >= 0) & whole, F.struct((F.col("p") - left).alias("lo"), (F.col("p") + F.col("k") + right).alias("hi"))).alias("span"))
    summed = found.groupBy("id", "t").agg(
        F.max("n").alias("n_words"), F.count_if(F.col("h") < 0).alias("copies"), F.array_sort(F.collect_set("span")).alias("raw"), F.collect_set(F.when(F.col("span").isNotNull(), F.col("items"))).alias("sets")
    )
    merged = F.aggregate(
        "raw", F.array().cast("array<struct<lo:int,hi:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["hi"] >= s["lo"]), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["lo"].alias("lo"), F.greatest(F.element_at(done, -1)["hi"], s["hi"]).alias("hi"))))
        ).otherwise(F.concat(done, F.array(s))),
    )
    rows = summed.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), F.col("n_words").cast("long").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"), "copies")
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_", "copies")


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """overlap()'s rows with n_hit, the words inside spans, and contaminated: a hit, and share * n_hit >= n_words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["hi"] - s["lo"]))
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b) WHERE n > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
