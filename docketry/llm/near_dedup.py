"""MinHash near-duplicates: banded candidates, odd sketches to sift them, full sets to confirm them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import cores, cut, discard, scratch, table

SHINGLE = 5
#: BANDS * ROWS MinHash samples. Two sets of similarity s share a band with probability
#: 1 - (1 - s ** ROWS) ** BANDS: all but 5 in a million at 0.75.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch. A pair at 0.75 differs in 64 of 2 * SAMPLES sampled elements on average.
SKETCH_BITS = 512
#: Pairs whose sketches say less than this go no further; 5 standard deviations below 0.75.
SIFT = 0.55
#: Rows of a bucket whose sketches are compared at a time; larger buckets are compared in blocks.
BLOCK = 2048
#: Shingles of a bucket's sets that are compared at a time; larger buckets are compared in blocks.
BLOCK_SHINGLES = 1 << 20
#: Rounds that take the best partner of each document, before the one that compares all that are left.
BEST_ROUNDS = 3


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SALTS = (_mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLACES = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


_IN_WORD = _mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word between ASCII white space: its bytes weighed by their places, summed and mixed."""
    b = np.frombuffer(text, np.uint8)
    inside = (b != 32) & ((b < 9) | (b > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    b, inside = b[starts[0] :], inside[starts[0] :]
    starts -= starts[0]
    place = np.arange(len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
    longest = int((place * inside).max())
    weights = _IN_WORD if longest < len(_IN_WORD) else _mix(np.arange(1, longest + 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    value = b.astype(np.uint64) + inside
    value *= weights[place * inside]
    value *= inside
    return _mix(np.add.reduceat(value, starts))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles (of the whole sequence if it is shorter)."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # ASCII letters only
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    sums = np.full(n, np.uint64(k))
    for j in range(k):
        sums += h[j : j + n] * _PLACES[j]
    return np.unique(_mix(sums))


def signature(items: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a non-empty set: the least products with each salt, in 32 bits."""
    items = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(items), 1024):
        np.minimum(least, (items[None, at : at + 1024] * _SALTS[:, None]).min(axis=1), out=least)
    return least.astype(np.uint64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity of the number of samples at each of SKETCH_BITS places, as 64-bit words."""
    places = (_mix(samples + (_SALTS.astype(np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = (np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """The similarity that differing bits of two odd sketches stand for.

    Each of the 2 * SAMPLES * (1 - s) samples that differ flips a random bit.
    """
    share = np.minimum(differing / SKETCH_BITS, 0.4999)
    return 1 + SKETCH_BITS / 2 * np.log1p(-2 * share) / (2 * SAMPLES)


#: The most differing bits that a pair of similarity SIFT is expected to have.
MOST_BITS = int(np.searchsorted(-similarity(np.arange(SKETCH_BITS // 2)), -SIFT, side="right")) - 1


def sketches(docs: DataFrame) -> DataFrame:
    """id, t, n_shingles, set (16 bytes standing for the whole set), bands, sketch for each row of (id, text, t)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, bands, sketch = [], [], [], []
            for text in batch.column(1).to_pylist():
                items = shingle_set(text)
                sizes.append(len(items))
                if not len(items):
                    sets.append(None), bands.append(None), sketch.append(None)
                    continue
                least = signature(items)
                sets.append(xxhash.xxh3_128_digest(items.tobytes()))
                rows = least.reshape(BANDS, ROWS)
                keys = np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    keys = _mix(keys + rows[:, j] * _PLACES[j])
                bands.append(keys.view(np.int64))
                sketch.append(odd_sketch(least).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["id", "t", "n_shingles", "set", "bands", "sketch"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(compute, f"id {kind}, t long, n_shingles long, set binary, bands array<long>, sketch binary")


class Members:
    """Rows of buckets, those of a group (bucket, lo, hi) next to each other, and pairs among them.

    A pair is of one group, of two classes, of both blocks where a group has two, has sizes of which the smaller may be
    `percent` of the larger, and has sketches alike.
    """

    def __init__(self, batches: list[pa.RecordBatch], percent: int):
        table = pa.Table.from_batches(batches)
        self.table, self.percent = table, percent
        self.group = np.stack([table.column(c).to_numpy() for c in ("bucket", "lo", "hi")], axis=1)
        self.block, self.rep, self.comp, self.size = (table.column(c).to_numpy() for c in ("block", "rep", "comp", "n_shingles"))
        self.bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(table), -1)
        self.starts = np.concatenate([[0], np.flatnonzero((self.group[1:] != self.group[:-1]).any(axis=1)) + 1, [len(table)]])

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j are of two classes and of sizes that a link allows."""
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        return (self.comp[i] != self.comp[j]) & (100 * small >= self.percent * large)

    def best(self) -> pa.RecordBatch:
        """The most similar partner of each row in its group, as pairs of reps; not of rows of the bucket's large class, which the others find."""
        sizes = np.diff(self.starts)
        found = [self.few(sizes)] + [self.many(a, a + n) for a, n in zip(self.starts[:-1], sizes, strict=True) if n > 32]
        rest = ~self.table.column("is_main").to_numpy()
        a, b = (np.concatenate([self.rep[f[i][rest[f[0]]]] for f in found]) for i in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def open(self) -> pa.RecordBatch:
        """The rows that have a partner in their group."""
        sizes = np.diff(self.starts)
        found = [self.few(sizes)] + [self.many(a, a + n) for a, n in zip(self.starts[:-1], sizes, strict=True) if n > 32]
        rows = np.unique(np.concatenate([f[i] for f in found for i in (0, 1)]))
        return self.table.select(["bucket", "rep", "comp", "n_shingles"]).take(pa.array(rows)).combine_chunks().to_batches(len(rows) or 1)[0] if len(rows) else pa.RecordBatch.from_pylist([], self.table.select(["bucket", "rep", "comp", "n_shingles"]).schema)

    def few(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all groups of up to 32 rows at once: rows one apart, two apart and so on."""
        ends = np.repeat(np.where(sizes <= 32, self.starts[1:], 0), sizes)
        nearest, partner = np.full(len(ends), MOST_BITS + 1), np.full(len(ends), -1)
        rows = np.arange(len(ends))
        for apart in range(1, 32):
            i = rows[rows + apart < ends]
            if not len(i):
                break
            j = i + apart
            fit = self.fit(i, j) & ((self.group[i, 1] == self.group[i, 2]) | (self.block[i] != self.block[j]))
            i, j = i[fit], j[fit]
            differ = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1)
            for x, y in ((i, j), (j, i)):
                closer = differ < nearest[x]
                nearest[x[closer]], partner[x[closer]] = differ[closer], y[closer]
        return np.flatnonzero(partner >= 0), partner[partner >= 0]

    def many(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of one larger group: all rows against all, or the first block against the second, 256 at a time."""
        _, lo, hi = self.group[start]
        rows = np.arange(start, end)
        one, other = (rows, rows) if lo == hi else (rows[self.block[rows] == lo], rows[self.block[rows] == hi])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        nearest, partner = np.full(len(other), MOST_BITS + 1), np.full(len(other), -1)
        for at in range(0, len(one) if len(other) else 0, 256):
            part = one[at : at + 256]
            differ = np.zeros((len(part), len(other)), np.int16)
            for w in range(self.bits.shape[1]):
                differ += np.bitwise_count(self.bits[part, w, None] ^ self.bits[None, other, w])
            differ[~self.fit(part[:, None], other[None, :])] = SKETCH_BITS
            column = differ.argmin(axis=1)
            near = differ[np.arange(len(part)), column] <= MOST_BITS
            left.append(part[near]), right.append(other[column[near]])
            row = differ.argmin(axis=0)
            closer = differ[row, np.arange(len(other))] < nearest
            nearest[closer], partner[closer] = differ[row[closer], np.flatnonzero(closer)], part[row[closer]]
        left.append(other[partner >= 0]), right.append(partner[partner >= 0])
        return np.concatenate(left), np.concatenate(right)


def _dealt(members: DataFrame, weight: str, most: int) -> DataFrame:
    """members, which have bucket, rep, comp, dealt out to groups (bucket, lo, hi) of one block or two.

    Buckets within one class have nothing to find. In the others the rows of the class that has most of them, which need
    not be compared with each other, and the rest are dealt to blocks of a summed weight of `most` on average, by a
    hash of rep. Each block of the rest meets itself, the other blocks of the rest, and those of the large class.
    """
    classes = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    sizes = classes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max(F.struct("n", "comp", "w"))["w"].alias("w"), F.sum("w").alias("all"), F.count("*").alias("classes"))
    sizes = sizes.where("classes > 1").select("bucket", "main", F.ceil(F.col("w") / most).cast("int").alias("mains"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("w")) / most)).cast("int").alias("rests"))
    joined = members.join(sizes, "bucket").withColumn("is_main", F.col("comp") == F.col("main"))
    # Blocks of the rest are 0..rests-1, those of the large class follow.
    block = F.when(F.col("is_main"), F.col("rests") + F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rests"))).cast("int")
    others = F.sequence(F.lit(0), F.col("rests") + F.when(F.col("is_main"), 0).otherwise(F.col("mains")) - 1)
    paired = joined.withColumn("block", block).withColumn("o", F.explode(others))
    kept = [c for c in members.columns if c != "bucket"]
    return paired.select("bucket", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "is_main", *kept).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _by_group(grouped: DataFrame, percent: int, step: str, schema: str) -> DataFrame:
    """Members.best or Members.open of rows that _dealt has sorted by group, some thousand rows at a time."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) < 20_000:
                continue
            members = Members(held, percent)
            if (last := int(members.starts[-2])) == 0:
                continue  # one group that goes on
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield getattr(Members([whole.slice(0, last)], percent), step)()
            held = [whole.slice(last)]
        if held:
            yield getattr(Members(held, percent), step)()

    return grouped.mapInArrow(find, schema)


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of reps in a shared bucket, in different classes, each the other's or its own best by sketch.

    `members` has bucket, rep, comp, n_shingles, sketch. At most one pair comes from a row of a group.
    """
    return _by_group(_dealt(members.withColumn("one", F.lit(1)), "one", BLOCK), percent, "best", "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            good = []
            # The join leaves pairs sorted by b, so its set is made once for all of its partners.
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, other = shingle_set(x.as_py()), y.as_py()
                if other != last:
                    last, kept = other, shingle_set(other)
                common = len(np.intersect1d(one, kept, assume_unique=True))
                good.append(100 * common >= percent * (len(one) + len(kept) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    first, second = (texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def linked_in_blocks(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join up all classes of `members` with a link between them: every pair left is compared on full sets.

    First the sketches say which rows of a bucket have a partner in another class at all; these rows, not pairs of
    them, get their texts. Then the sets of a group are compared where they lie, each row of one class with
    all rows of others at once, and a group gives links until its linked classes hang together: fewer links than rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    found = _by_group(_dealt(members.withColumn("one", F.lit(1)), "one", BLOCK), percent, "open", ", ".join(f"{c} {kinds[c]}" for c in ("bucket", "rep", "comp", "n_shingles"))).distinct()
    open_ = cut(found, 2 * cores(members.sparkSession))
    grouped = _dealt(open_, "n_shingles", BLOCK_SHINGLES).join(texts, "rep").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lo", "hi", "block", "rep", "comp", "text")), strict=True):
                if row[:3] != group:
                    if rows:
                        yield spanning(rows, percent)
                    group, rows = row[:3], []
                rows.append((*row[1:6], shingle_set(row[6])))
        if rows:
            yield spanning(rows, percent)

    return grouped.select("bucket", "lo", "hi", "block", "rep", "comp", "text").mapInArrow(compare, "a long, b long").distinct()


def spanning(rows: list[tuple], percent: int) -> pa.RecordBatch:
    """Links (a, b) of a group's rows (lo, hi, block, rep, comp, set) that join what any links between its classes join."""
    lo, hi = rows[0][:2]
    block, rep, comp = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    size = np.array([len(r[5]) for r in rows])
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True)[1].ravel()
    mark = np.zeros(len(flat), np.int32)
    _, of = np.unique(comp, return_inverse=True)
    of = of.ravel().copy()
    links: list[tuple[int, int]] = []
    # The rows of one block against the other's; of a single block, each row against those after it.
    for i in np.flatnonzero(block == lo):
        other = of != of[i]
        if lo == hi:
            other[: i + 1] = False
        else:
            other &= block == hi
        if not other.any():
            continue
        mine = flat[ends[i] : ends[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[flat], ends[:-1])
        mark[mine] = 0
        near = np.flatnonzero(other & (100 * common >= percent * (size + size[i] - common)))
        for c, j in zip(*np.unique(of[near], return_index=True), strict=True):
            links.append((int(rep[i]), int(rep[near[j]])))
            of[of == c] = of[i]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of the edges (a, b) reaches; nodes without edges are left out.

    Alternates two steps until nothing changes: every node ties its larger neighbours to the smallest node
    it knows, then its smaller ones. Paths shorten by at least half a round; all sums are per node, and joins split hot nodes.
    """
    tasks = cores(edges.sparkSession)
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tasks)
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), tasks)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: id (a bigint), text_hash, n_shingles, component_id, kept (id = component_id).

    Rows are linked when their sets of 5-word shingles (ASCII lower case; a shorter text is one shingle)
    have a similarity of `percent` or more; component_id is the smallest id reachable over links. A null
    text, or one without words, has an empty set and is linked with nothing. Rows with a null id are not
    linked: their component is null and they are kept. Rows of equal id are told apart by their sets;
    sets with the same smallest id count as linked. Other columns are ignored.

    Rows of equal sets become one representative, named by its smallest id. Representatives are banded,
    sifted by odd sketches and confirmed on full sets. Rounds that take each one's best partner in another
    class come first, so that a large group of near copies is joined up with few pairs; the last round
    compares, block by block, all that are left in different classes, and makes no rows of pairs. Texts of any length
    are taken whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tasks = cores(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    known = cut(sketches(rows))
    sets = known.where("set is not null and id is not null").groupBy("set").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    sets = cut(sets, 2 * tasks)
    banded = sets.select("rep", F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = cut(banded.join(shared, "bucket"), 2 * tasks)
    path = scratch(spark, "texts")
    rows.join(buckets.select(F.col("rep").alias("id")).distinct(), "id").select(F.col("id").alias("rep"), "text").dropDuplicates(["rep", "text"]).repartition(2 * tasks).write.parquet(path)
    texts = spark.read.parquet(path)

    links, tried, classes = None, None, None

    def members() -> DataFrame:
        named = sets.select("rep", "n_shingles", "sketch")
        if classes is None:
            return buckets.join(named.withColumn("comp", F.col("rep")), "rep")
        return buckets.join(named.join(classes, F.col("rep") == F.col("node"), "left").select("rep", "n_shingles", "sketch", F.coalesce("comp", "rep").alias("comp")), "rep")

    for best in [True] * BEST_ROUNDS + [False]:
        if best:
            found = candidates(members(), percent)
            found = cut(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), 2 * tasks)
            new = cut(confirmed(found, texts, percent), tasks)
            tried = found if tried is None else tried.union(found)
        else:
            new = cut(linked_in_blocks(members(), texts, percent), tasks)
        if new.isEmpty():
            continue
        links = new if classes is None else new.union(classes.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        classes = components(links)
    discard(spark, path)
    named = sets.select("set", "rep")
    if classes is not None:
        named = named.join(classes, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("comp", "rep").alias("component"))
    else:
        named = named.withColumnRenamed("rep", "component")
    out = known.select("id", "t", "n_shingles", "set").join(named, "set", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
