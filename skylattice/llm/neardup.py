"""Near-duplicate records: an exact Jaccard join over word sets.

Texts with the same word set form a class; the join runs over classes. Jaccard distance is a metric, so the classes can
be cut into Voronoi regions of pivots; a class x of region p is replicated to region q if d(x, q) <= d(x, p) + 2r and
d(x, q) <= r plus q's radius, which by the triangle inequality loses no pair within r = 1 - threshold. Unrelated texts lie at nearly the same distance from
everything (see the README for figures), so pivots drawn from all classes would replicate every class everywhere. The
pivots therefore divide regions that share something already:

1. Word regions: words are ordered by frequency, and a pair within r shares one of each side's rarest words. A class
   enters the region of each such word that at most `cap` classes have.
2. Where the shared words are all more frequent than that, the pair shares three of them among slightly longer prefixes:
   the class enters the region of each such triple. Texts of LONG words and more, which would make too many triples, and
   those so short that two shared words suffice, enter the regions of their frequent words one by one.
3. Every region of more than LEAF classes is joined by pivots: Voronoi regions with triangle-inequality windows, again
   and again while that divides it; what it doesn't divide is compared block by block. Regions of more than `cap` classes
   are cut so by Spark first, so that no task holds more than `cap` classes of a region.

In the last regions pairs are compared through 128-bit signatures, which never miss a pair, and those that pass by their
whole word sets (64-bit hashes). Nothing is capped: every step is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.chunks import by_chunk, changes, codes, whole_chunks
from skylattice.session import materialize

THRESHOLD = Fraction(7, 10)
#: Classes of a region that are compared in one task; also the most classes that a word may have to form a region.
CAP = 5_000
PIVOTS = 16
DEPTH = 8
#: Regions of up to this many classes are compared as they are; larger ones go through pivots inside the task.
LEAF = 32
#: Classes of a region by which it is judged whether its pivots divide it at all.
SOME = 64
#: From this many words on, a text's frequent words are taken one by one and not in threes (at most 969 at a threshold of 1/2).
LONG = 32
#: Word frequencies are kept as powers of two for hash buckets, one for every BUCKET_LOAD occurrences within these
#: bounds (a byte each); any total order of the words is exact.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_LOAD = 1 << 17, 1 << 24, 64
#: Copies of exactly one text are paired one by one up to this many; beyond, each is linked to the first copy, and two
#: such groups are linked by their first copies.
COPIES = 1_000
#: Pivot tables of up to this many regions (a few KB each) are broadcast.
BROADCAST_REGIONS = 1_000
ROWS = "region bigint, cid string, probe boolean, index boolean, hashes array<bigint>"


def word_set(text: str):
    """The distinct words, runs of a-z and 0-9 in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.expr(f"regexp_extract_all(lower({text}), '[a-z0-9]+', 0)")))


def instruction_records(episodes: DataFrame, filter_results: DataFrame) -> DataFrame:
    """key, text of all instructions and kept texts; repeated rows count once. Null texts and null ids give no record."""
    a = episodes.where("episode_id is not null and instruction is not null").select(F.concat(F.lit("e:"), F.col("episode_id").cast("string")).alias("key"), F.col("instruction").alias("text"))
    kept = filter_results.where("result_id is not null").select("result_id", F.posexplode("kept").alias("at", "text")).where("text is not null")
    b = kept.select(F.concat_ws(":", F.lit("k"), F.col("result_id").cast("string"), F.col("at").cast("string")).alias("key"), "text")
    return a.unionByName(b).groupBy("key").agg(F.min("text").alias("text"))


def members(records: DataFrame) -> DataFrame:
    """key, tid, cid, words: records of the same text have the same tid, those of the same word set the same cid. Texts
    without a word belong to no class."""
    sets = records.where("key is not null").select("key", F.md5("text").alias("tid"), word_set("text").alias("words")).where("size(words) > 0")
    return sets.select("key", "tid", F.md5(F.concat_ws(" ", "words")).alias("cid"), "words")


def lists_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists one after another, and the lists' lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def region_rows(batches: Iterable[pa.RecordBatch], levels: np.ndarray, t: Fraction, cap: int, frequent: bool) -> Iterator[pa.RecordBatch]:
    """The regions of rare words (or, with frequent, of frequent words and threes of them) that each class enters.
    levels: the power of two that bounds a bucket's frequency."""
    num, den = t.numerator, t.denominator
    rare_level = cap.bit_length() - 1
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            flat, n = lists_of(part.column(1))
            f = levels[(flat % np.uint64(len(levels))).astype(np.int64)]
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, f, row))
            h, rare = flat[order], f[order] <= rare_level
            start = np.cumsum(n) - n
            pos = np.arange(len(h)) - start[row]
            probe, index = n + num * n // -den + 1, n + 2 * num * n // -(den + num) + 1
            found = []  # (region, row, probe, index)
            if not frequent:
                at = np.flatnonzero(rare & (pos < probe[row]))
                found.append((h[at], row[at], np.ones(len(at), dtype=bool), pos[at] < index[row[at]]))
            else:
                long, meets_long = n >= LONG, n * den >= LONG * num
                at = np.flatnonzero(~rare & meets_long[row] & (pos < probe[row]))
                found.append((h[at], row[at], long[row[at]], pos[at] < index[row[at]]))
                few = num * n <= 2 * den  # two shared words may suffice here
                at = np.flatnonzero(~rare & few[row] & ~long[row] & (pos < probe[row]))
                found.append((h[at] ^ np.uint64(0x5851F42D4C957F2D), row[at], np.ones(len(at), dtype=bool), pos[at] < index[row[at]]))
                first = np.bincount(row[rare], minlength=len(n))
                tail = np.where(long | (first >= probe), 0, np.minimum(probe + 2, n) - first)
                for m in np.unique(tail[tail >= 3]):
                    of = np.flatnonzero(tail == m)
                    v = h[(start + first)[of][:, None] + np.arange(m)[None, :]]
                    picks = np.array(list(combinations(range(m), 3)))
                    with np.errstate(over="ignore"):
                        key = ((v[:, picks[:, 0]] * np.uint64(0x9E3779B97F4A7C15) ^ v[:, picks[:, 1]]) * np.uint64(0xBF58476D1CE4E5B9) ^ v[:, picks[:, 2]]) * np.uint64(0x94D049BB133111EB)
                    indexed = picks[None, :, 2] < (index + 2 - first)[of][:, None]
                    found.append((key.ravel(), np.repeat(of, len(picks)), np.ones(key.size, dtype=bool), indexed.ravel()))
            region, row, probes, indexed = (np.concatenate(c) for c in zip(*found))
            for a in range(0, len(region), 20_000):
                b = a + 20_000
                at = pa.array(row[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(region[a:b].view(np.int64)), part.column(0).take(at), pa.array(probes[a:b]), pa.array(indexed[a:b]), part.column(1).take(at)], ["region", "cid", "probe", "index", "hashes"])


class Sets:
    """The word sets of a table of region rows, with what the comparisons need of them."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, probe: np.ndarray, index: np.ndarray, t: Fraction):
        self.flat, self.size, self.probe, self.index, self.t = flat, size, probe, index, t
        self.start = np.cumsum(size) - size
        bit = (flat >> np.uint64(20)) & np.uint64(127)
        one = np.uint64(1) << (bit & np.uint64(63))
        none = np.uint64(0)
        self.s0, self.s1 = (np.bitwise_or.reduceat(np.where((bit >> np.uint64(6)) == k, one, none), self.start) if len(flat) else np.zeros(0, dtype=np.uint64) for k in (0, 1))

    def words(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of the rows one after another, and for each its place in rows."""
        n = self.size[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return self.flat[self.start[rows][of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], of

    def distances(self, rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Jaccard distances [pivot, row]."""
        words, of = self.words(rows)
        out = np.empty((len(pivots), len(rows)))
        for k, p in enumerate(pivots):
            own = np.sort(self.flat[self.start[p] : self.start[p] + self.size[p]])
            at = np.minimum(np.searchsorted(own, words), len(own) - 1)
            common = np.bincount(of[own[at] == words], minlength=len(rows))
            out[k] = 1 - common / (self.size[p] + self.size[rows] - common)
        return out

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the signatures leave it open that rows i and j are similar, and the region is one where they must meet:
        the larger one probes it and the smaller one is indexed (one of the two ways will do for equal sizes)."""
        apart = np.bitwise_count(self.s0[i] ^ self.s0[j]).astype(np.int64) + np.bitwise_count(self.s1[i] ^ self.s1[j])
        a, b = self.size[i], self.size[j]
        ok = (self.t.denominator + self.t.numerator) * apart <= (self.t.denominator - self.t.numerator) * (a + b)
        return ok & (((a >= b) & self.probe[i] & self.index[j]) | ((b >= a) & self.probe[j] & self.index[i]))

    def similar(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are at or above the threshold, and how many words those share."""
        (x, of_x), (y, of_y) = self.words(i), self.words(j)
        of, w = np.concatenate([of_x, of_y]), np.concatenate([x, y])
        order = np.lexsort((w, of))
        of, w = of[order], w[order]
        common = np.bincount(of[1:][(of[1:] == of[:-1]) & (w[1:] == w[:-1])], minlength=len(i))
        good = np.flatnonzero(common * self.t.denominator >= (self.size[i] + self.size[j] - common) * self.t.numerator)
        return good, common[good]


def voronoi_cells(sets: Sets, rows: np.ndarray, outside: np.ndarray, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, outside, divided) of the last regions that a region is cut into by pivots and windows, recursively. A pair
    needs comparing where the two rows' bits `outside` don't meet: bit k is set for rows that the window of level k let
    in from a region that will hold the pair as well. divided is False for parts that pivots don't divide further."""
    n = len(rows)
    if n <= LEAF or level == DEPTH:
        yield rows, outside, n <= LEAF
        return
    count = min(PIVOTS, int(n**0.5) + 1)
    pivots, window = rows[np.arange(count) * n // count], float(2 * (1 - sets.t)) + 1e-9
    some = sets.distances(rows[np.arange(SOME) * n // SOME], pivots) if n > 2 * SOME else None
    if some is not None and (some <= some.min(axis=0) + window).mean() > 0.8:
        yield rows, outside, False  # most classes would go to most regions
        return
    d = sets.distances(rows, pivots)
    home, near = np.argmin(d, axis=0), d.min(axis=0)
    radius = np.array([d[q][home == q].max(initial=-1) for q in range(count)])
    inside = d <= np.minimum(near + window, radius[:, None] + window / 2 + 1e-9)
    cells, work = [], 0.0
    for q in range(count):
        own, let_in = home == q, inside[q] & (home > q)  # a pair of two regions is compared in the lower one
        members = np.flatnonzero(own | let_in)
        inner = int(own.sum())
        work += inner * (len(members) - inner / 2)
        if inner:
            cells.append((rows[members], outside[members] | (let_in[members].astype(np.int64) << level)))
    if work > 0.7 * n * n / 2:
        yield rows, outside, False
        return
    for cell in cells:
        yield from voronoi_cells(sets, *cell, level + 1)


def compared(sets: Sets, cells: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of many small cells that the signatures let pass; all cells are compared at once."""
    if not cells:
        return
    rows, outside = (np.concatenate(c) for c in zip(*cells))
    of = np.repeat(np.arange(len(cells)), [len(c[0]) for c in cells])
    for k in range(1, LEAF):
        at = np.flatnonzero((of[k:] == of[:-k]) & (outside[k:] & outside[:-k] == 0)) if len(of) > k else []
        if not len(at):
            break
        i, j = rows[at], rows[at + k]
        ok = sets.fit(i, j)
        yield i[ok], j[ok]


def in_blocks(sets: Sets, rows: np.ndarray, outside: np.ndarray, block: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of one cell that the signatures let pass: blocks of probing rows of one size against the indexed rows
    of the sizes that can be similar."""
    t, size = sets.t, sets.size[rows]
    by_size = np.argsort(size, kind="stable")
    rows, outside, size = rows[by_size], outside[by_size], size[by_size]
    small = np.flatnonzero(sets.index[rows])
    small_size = size[small]
    big = np.flatnonzero(sets.probe[rows])
    cuts = np.append(np.flatnonzero(np.append(True, size[big][1:] != size[big][:-1])) if len(big) else [], len(big)).astype(np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        n = int(size[big[a]])
        lo, hi = np.searchsorted(small_size, -(-t.numerator * n // t.denominator)), np.searchsorted(small_size, n, side="right")
        other = small[lo:hi]
        limit = np.minimum((t.denominator - t.numerator) * (n + size[other]) // (t.denominator + t.numerator), 128).astype(np.uint8)
        for first in range(a, b, block):
            own = big[first : min(b, first + block)]
            for cut in range(0, len(other), 4096):
                at = other[cut : cut + 4096]
                apart = np.bitwise_count(sets.s0[rows[own]][:, None] ^ sets.s0[rows[at]][None, :]) + np.bitwise_count(sets.s1[rows[own]][:, None] ^ sets.s1[rows[at]][None, :])
                i, j = np.nonzero(apart <= limit[None, cut : cut + 4096])
                i, j = own[i], at[j]
                once = (size[i] != size[j]) | (i < j) | ~(sets.probe[rows[j]] & sets.index[rows[i]])
                ok = once & (i != j) & (outside[i] & outside[j] == 0)
                yield rows[i[ok]], rows[j[ok]]


def close_pairs(batches: Iterable[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), a < b, of a region's classes at or above the threshold, with common and united words. Pairs leave as
    they are found; nothing but one block of them is held."""
    for table in whole_chunks(batches, ["region"]):
        region = codes(table["region"])
        flat, size = lists_of(table["hashes"])
        probe, index = (table[c].to_numpy().astype(bool) for c in ("probe", "index"))
        sets = Sets(flat, size, probe, index, t)
        cid = table["cid"].combine_chunks()
        bounds = np.append(np.flatnonzero(changes([region])), table.num_rows)
        spans = [(a, b) for a, b in zip(bounds[:-1], bounds[1:]) if b - a > 1]
        everywhere = np.zeros(table.num_rows, dtype=np.int64)
        small, large = [], []
        for a, b in spans:
            for rows, outside, divided in voronoi_cells(sets, np.arange(a, b), everywhere[a:b]):
                (small if divided else large).append((rows, outside))
        parts = [compared(sets, small), *(in_blocks(sets, *c) for c in large)]
        for i, j in (p for part in parts for p in part):
            for lo in range(0, len(i), 50_000):
                x, y = i[lo : lo + 50_000], j[lo : lo + 50_000]
                good, common = sets.similar(x, y)
                if not len(good):
                    continue
                x, y = x[good], y[good]
                left, right = cid.take(pa.array(x)), cid.take(pa.array(y))
                swap = pc.greater(left, right)
                united = sets.size[x] + sets.size[y] - common
                yield pa.RecordBatch.from_arrays([pc.if_else(swap, right, left), pc.if_else(swap, left, right), pa.array(common.astype(np.int32)), pa.array(united.astype(np.int32))], ["a", "b", "common", "united"])


def jaccard_distance(a, b):
    both = F.size(F.array_intersect(a, b))
    return F.lit(1.0) - both / (F.size(a) + F.size(b) - both)


def tiles(rows: DataFrame, sizes: DataFrame, cap: int) -> DataFrame:
    """Cut regions of n classes into pairs of tiles of about cap classes; each pair of tiles becomes a region."""
    cells = F.ceil(F.col("n") / cap).cast("int")
    own = F.pmod(F.xxhash64("cid"), cells.cast("bigint")).cast("int")
    cut = rows.join(sizes, "region").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    return cut.withColumn("region", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))).select(*rows.columns)


def voronoi(rows: DataFrame, words: DataFrame, radius: float, cap: int, pivots: int = PIVOTS, depth: int = DEPTH) -> DataFrame:
    """Cut regions of more than cap classes by pivots until they fit; returns rows of regions that do, with every pair
    within radius together in at least one of them.

    Pivots are drawn by hash, about `pivots` per region. A class goes to its nearest pivot's region and, by the triangle
    inequality, to each q with d(x, q) <= d(x, p) + 2 * radius. Where the parts' squared sizes don't add up to clearly
    less than the region's own, its windows overlap too much for pivots to help, and it is cut into tiles instead."""
    todo = materialize(rows.join(words.select("cid", "words"), "cid").select(*rows.columns, "words"), "p2-hot")
    done = []
    for level in range(depth + 1):
        sizes = materialize(todo.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "p2-sizes")
        done.append(todo.join(sizes.where(F.col("n") <= cap), "region", "left_semi").select(*rows.columns))
        large = sizes.where(F.col("n") > cap)
        regions = large.count()
        if not regions:
            break
        if level == depth:
            done.append(tiles(todo.select(*rows.columns), large, cap))
            break
        few = F.broadcast if regions <= BROADCAST_REGIONS else (lambda df: df)
        sized = todo.join(few(large), "region")
        draw = F.pmod(F.xxhash64(F.lit(level), "region", "cid"), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.lit(2.0 * pivots) / F.col("n")
        chosen = sized.where(draw).groupBy("region").agg(F.slice(F.array_sort(F.collect_list(F.struct("cid", "words"))), 1, pivots).alias("pivots"))
        near = sized.join(few(chosen), "region")
        d = F.array_sort(F.transform(F.col("pivots"), lambda p: F.struct(jaccard_distance(F.col("words"), p["words"]).alias("d"), p["cid"].alias("p"))))
        near = near.withColumn("ds", d)
        inside = F.filter("ds", lambda p: p["d"] <= F.col("ds")[0]["d"] + F.lit(2 * radius + 1e-9))
        cut = near.withColumn("p", F.explode(F.transform(inside, lambda p: p["p"])))
        parts = cut.groupBy("region", "n", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("region", "n").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
        divided = materialize(parts.where(F.col("work") <= 0.7 * F.col("n") * F.col("n")).select("region"), "p2-divided")
        done.append(tiles(todo.select(*rows.columns), large.join(divided, "region", "left_anti"), cap))
        cut = cut.join(divided, "region", "left_semi").withColumn("region", F.xxhash64("region", "p", F.lit(level)))
        todo = materialize(cut.select(*rows.columns, "words"), f"p2-level{level}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def similar_classes(found: DataFrame, threshold: Fraction = THRESHOLD, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs). classes: cid, words, copies, one row per word set. pairs: a, b, common, united with a < b and
    common / united >= threshold. found: the result of members."""
    t = threshold
    classes = materialize(found.groupBy("cid").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies")), "p2-classes")
    spark = classes.sparkSession
    occurrences = classes.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (occurrences // BUCKET_LOAD).bit_length()))
    counts = classes.select(F.explode("words").alias("w")).groupBy(F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int").alias("b")).agg(F.ceil(F.log2(F.count(F.lit(1)))).cast("byte").alias("level")).toPandas()  # at most MOST_BUCKETS rows
    table = np.zeros(buckets, dtype=np.int8)
    # xxhash64 is signed; the task takes the unsigned remainder, which is the same for a power of two
    table[counts["b"].to_numpy(dtype=np.int64)] = counts["level"].to_numpy(dtype=np.int8)
    levels = spark.sparkContext.broadcast(table)
    hashed = classes.select("cid", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rare = hashed.mapInArrow(lambda b: region_rows(b, levels.value, t, cap, False), ROWS)
    common = materialize(hashed.mapInArrow(lambda b: region_rows(b, levels.value, t, cap, True), ROWS), "p2-frequent")
    hot = materialize(common.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("region"), "p2-hot-regions")
    if not hot.isEmpty():
        crowded = common.join(hot, "region", "left_semi").groupBy("region", "cid").agg(F.max("probe").alias("probe"), F.max("index").alias("index"), F.first("hashes").alias("hashes"))
        common = common.join(hot, "region", "left_anti").unionByName(voronoi(crowded, classes, float(1 - t), cap))
    pairs = by_chunk(rare.unionByName(common), ["region"], ["cid"]).mapInArrow(lambda b: close_pairs(b, t), "a string, b string, common int, united int")
    return classes, pairs.where("a <> b").distinct()


def reordered(texts: DataFrame, cap: int) -> DataFrame:
    """a, b, a < b: all pairs of different texts (tid) of one word set (cid), compared in pairs of tiles of about cap."""
    sizes = texts.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = F.ceil(F.col("n") / cap).cast("int")
    own = F.pmod(F.xxhash64("tid"), cells.cast("bigint")).cast("int")
    cut = texts.select("cid", "tid").join(sizes, "cid").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    cut = cut.select("cid", "tid", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    met = cut.alias("x").join(cut.alias("y"), ["cid", "lo", "hi"]).where("x.tid < y.tid and (x.own <> y.own or lo = hi)")
    return met.select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b"))


def similar_pairs(records: DataFrame, threshold: Fraction = THRESHOLD, cap: int = CAP, copies: int = COPIES) -> DataFrame:
    """rec_a, rec_b of all pairs of records at or above the threshold, rec_a < rec_b as strings.

    records: key, text. Null keys and texts, and texts without a word, give no pairs; a repeated key counts once (its
    first text stands); empty tables give no rows. Records of exactly the same text are paired up to `copies` of them; of
    more, each is linked to the first. Records of different texts are paired completely, whether their word sets are equal
    or not, unless both texts have more than `copies` records: then their first records stand for them."""
    found = materialize(members(records.groupBy("key").agg(F.min("text").alias("text"))), "p2-members")
    classes, pairs = similar_classes(found, threshold, cap)
    keyed = found.select("cid", "tid", "key")
    texts = materialize(keyed.groupBy("cid", "tid").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first")), "p2-texts")
    some = keyed.join(texts.where((F.col("copies") > 1) & (F.col("copies") <= copies)).select("tid"), "tid")
    same = some.alias("x").join(some.alias("y"), "tid").where("x.key < y.key").select(F.col("x.key").alias("rec_a"), F.col("y.key").alias("rec_b"))
    first = texts.where(F.col("copies") > copies).select("tid", F.col("first").alias("rec_a"))
    star = keyed.join(first, "tid").where("key <> rec_a").select("rec_a", F.col("key").alias("rec_b"))
    # links between different texts, of one word set or of similar ones
    of = lambda c, n: texts.select(F.col("cid").alias(c), F.col("tid").alias(f"t{n}"))
    across = pairs.select("a", "b").join(of("a", 1), "a").join(of("b", 2), "b").select("t1", "t2")
    links = across.unionByName(reordered(texts, cap).select(F.col("a").alias("t1"), F.col("b").alias("t2")))
    group = lambda n: texts.where(F.col("copies") > copies).select(F.col("tid").alias(f"t{n}"), F.col("first").alias(f"f{n}"))
    links = links.join(group(1), "t1", "left").join(group(2), "t2", "left")
    both = F.col("f1").isNotNull() & F.col("f2").isNotNull()
    ends = [F.least("k1", "k2").alias("rec_a"), F.greatest("k1", "k2").alias("rec_b")]
    k = lambda n: keyed.select(F.col("tid").alias(f"t{n}"), F.col("key").alias(f"k{n}"))
    whole = links.where(~both).select("t1", "t2").join(k(1), "t1").join(k(2), "t2").select(*ends)
    by_first = links.where(both).select(F.col("f1").alias("k1"), F.col("f2").alias("k2")).select(*ends)
    return same.unionByName(star).unionByName(whole).unionByName(by_first)


def record_classes(records: DataFrame, threshold: Fraction = THRESHOLD, cap: int = CAP) -> DataFrame:
    """One row per record with a word: key, class_id (of its word set), copies, links (other classes that are similar)."""
    found = materialize(members(records.groupBy("key").agg(F.min("text").alias("text"))), "p2-members")
    classes, pairs = similar_classes(found, threshold, cap)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    known = classes.select("cid", "copies").join(degree, "cid", "left")
    return found.select("key", "cid").join(known, "cid").select("key", F.col("cid").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
