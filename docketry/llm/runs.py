"""Periodic runs in texts: Lyndon arrays by Baier's grouping of suffixes, their roots extended into runs."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table, words

#: A run repeats its period this often at least and has this many words at least.
LEAST_EXPONENT, LEAST_LENGTH = 4, 6
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position, by the first phase of Baier's suffix sorter.

    Suffixes are grouped by their first letter, and groups taken from the highest down. Each suffix of a group belongs to the
    nearest one before it that is in a lower group; those that own equally many are moved to a group of their own just above the one they
    were in, whose prefix grows by as many copies of the taken group's prefix. A group's prefix is final, and is
    the longest Lyndon word at its suffixes, when the group is taken. Linear but for the path halving.
    """
    n = len(codes)
    letters = sorted(set(codes))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in codes]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    length, lower = [1] * len(letters), [g - 1 for g in range(len(letters))]
    above = [g + 1 for g in range(len(letters))]  # the next higher group; beyond the highest it is never read
    before = list(range(n + 1))  # of i + 1: leads to j + 1 of the nearest j <= i that isn't taken, 0 if there is none
    found = [0] * n
    g = len(letters) - 1
    while g >= 0:
        size = length[g]
        taken = [i for i in members[g] if group[i] == g]
        for i in taken:
            found[i] = size
            before[i + 1] = i
        owned = Counter()
        for i in taken:
            at = i
            while before[at] != at:
                before[at] = before[before[at]]
                at = before[at]
            if at:
                owned[at - 1] += 1
        if owned:
            by_count: dict[int, list[int]] = {}
            for j, times in owned.items():
                by_count.setdefault(times, []).append(j)
            for times in sorted(by_count, reverse=True):
                fresh: dict[int, int] = {}
                for j in by_count[times]:
                    old = group[j]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        length.append(length[old] + times * size)
                        lower.append(old)
                        above.append(above[old])
                        lower[above[old]] = new
                        above[old] = new
                    group[j] = new
                    members[new].append(j)
        members[g] = []
        g = lower[g]
    return found


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements agree, looked up in steps that double."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        end = min(n, at + step)
        differ = np.flatnonzero(a[at:end] != b[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, step * 2
    return n


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal stretch of at least LEAST_EXPONENT periods and LEAST_LENGTH letters.

    A run's Lyndon roots are the longest Lyndon words at their positions under the order of letters or under its inverse. In
    a run of four periods three of them follow each other, and the first of these is extended to both sides; roots inside a stretch that is
    known have the same extension.
    """
    n, found = len(codes), set()
    codes = np.asarray(codes)
    for order in (codes, -codes):
        lam = np.asarray(lyndon_array(order.tolist()), np.int64)
        i = np.arange(n)
        second = i + lam
        ok = second + 2 * lam <= n
        i, second = i[ok], second[ok]
        period = lam[i]
        chained = (lam[second] == period) & (lam[second + period] == period)
        i, period = i[chained], period[chained]
        same = (codes[i] == codes[i + period]) & (codes[i] == codes[i + 2 * period])
        reached: dict[int, int] = {}  # by period: where the last stretch of it ends
        for start, p in zip(i[same].tolist(), period[same].tolist(), strict=True):
            if start + p <= reached.get(p, 0):
                continue
            right = start + p + _matching(codes[start:], codes[start + p :])
            left = start - _matching(codes[:start][::-1], codes[: start + p][::-1])
            reached[p] = right
            if right - left >= max(LEAST_EXPONENT * p, LEAST_LENGTH):
                found.add((left, right - left, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches of a text that can hold runs; no run lies in two of them or leaves one.

    Every three letters of a run of four periods and six letters stand at least three times in it, no farther from each other than a
    period, and a period is at most a quarter of its run. What contradicts this cannot be in a run and is not sorted.
    """
    n = len(codes)
    if n < LEAST_LENGTH:
        return
    c = codes.astype(np.uint64)
    # Wrapping products may take different triples for equal ones, which only lets more through.
    key = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return
    gap = np.diff(order)
    far = np.int64(2 * n)
    ahead, behind = np.full(n - 2, far), np.full(n - 2, far)
    ahead[order[:-1][same]] = gap[same]
    behind[order[1:][same]] = gap[same]
    times = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]])))
    often = np.empty(n - 2, bool)
    often[order] = np.repeat(times >= 3, times)
    near = np.minimum(ahead, behind)
    keep = often
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]])))
        starts, ends = edges[::2], edges[1::2]
        size = ends - starts
        room = np.zeros(n - 2, np.int64)
        room[keep] = np.repeat((size + 2) // LEAST_EXPONENT, size)
        closer = keep & (near <= room)
        if closer.sum() == keep.sum():
            break
        keep = closer
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a + 2 >= LEAST_LENGTH:
            yield a, b + 2


def runs_in(tokens: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a sequence of words, by start, then period."""
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in tokens], np.int64)
    return [(a + s, length, p) for a, b in stretches(codes) for s, length, p in runs_of(codes[a:b])]


def _collapsed(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that a run holds beyond its first period."""
    if not runs:
        return b" ".join(tokens)
    drop = np.zeros(len(tokens), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return b" ".join([w for w, gone in zip(tokens, drop.tolist(), strict=True) if not gone])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (by start, then period; words numbered from 0), and collapsed, the text with each run cut to its first period.

    Words are what ASCII white space parts. A null or empty text has no words, no runs and an empty collapsed
    text; texts of any length are taken whole; repeated rows and null ids are like any other; other columns are ignored; an
    empty table gives no rows. Nothing is shuffled, and a task holds one batch of rows and one text's words.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            sizes, runs, left = [], [], []
            for text in batch.column(1):
                tokens = (text.as_py() or "").encode().split()
                found = runs_in(tokens)
                sizes.append(len(tokens))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                left.append(_collapsed(tokens, found).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(left, pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {kind}, n_words long, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def looped(doc_id: Column, text: Column) -> Column:
    """The text, with the words from one on repeated periodically in the documents whose id's checksum is divisible by 10; a null id leaves the text as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(tokens: Column) -> Column:
        n = F.size(tokens).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        turned = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(tokens, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise(text)

    # transform over an array of one: the words are worked out once.
    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(F.array(words(text)), repeated), F.lit(0))).otherwise(text)


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    # The greatest length / period: fractions are compared by cross products, which are exact.
    first = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, run: F.when(first(run, best), run).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
