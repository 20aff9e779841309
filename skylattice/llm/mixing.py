"""Mixing sources to target weights, measured in tokens of a public tokenizer.

Texts are tokenized once and packed per source into blocks of `block_tokens` tokens. A plan over the sources says how
many blocks each one owes; what a source can't give within its cap is drawn from the others. Each output shard draws its
source counts from the multinomial, conditioned on those totals (by halving the shards, so a shard's draw and the
offsets before it take a logarithmic number of steps and no other shard's work). The k-th slot of a source is mapped
through a pseudorandom permutation of the source's block numbers (a new one for each repetition), and slots and blocks
are joined by (source, block number), a key that no more than max_repeats slots share. Which sources fall short is
counted in the finished mix. A source with a third of all tokens is spread over all tasks: packing orders row numbers
and sizes in PARTS slices, and the token arrays join their places by row.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.session import materialize

TOKENIZERS = os.environ.get("SKYLATTICE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to the vocabulary file, and the id that ends a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
#: Each source's documents are packed in PARTS slices by hash; only their row numbers and sizes are sorted there.
PARTS = 4096
#: Slots of an output shard, and slots handed on at once.
SHARD_SLOTS, BATCH_SLOTS = 65_536, 16_384
#: target_weight tables are one row per source; more rows than this are refused.
MAX_SOURCES = 100_000


def normalized(source: str) -> Column:
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Longer texts are cut for the tokenizer at white space near this many characters, which keeps its time linear.
PIECE = 100_000


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def tokenized(documents: DataFrame, vocabulary: str) -> DataFrame:
    """row (unique), doc_id, source (normalized), tokens, n_tokens of all documents with a source; a null text has no tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                tokens = [[t for p in pieces(x) for t in encode(p)] if x else [] for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens, pa.list_(pa.int32())), pa.array([len(t) for t in tokens], pa.int64())], ["doc_id", "source", "tokens", "n_tokens"])

    texts = documents.select(F.col("doc_id").cast("bigint"), normalized("source").alias("source"), F.col("text").cast("string")).where("source <> ''")
    return texts.mapInArrow(run, "doc_id bigint, source string, tokens array<int>, n_tokens bigint").withColumn("row", F.monotonically_increasing_id())


def packed(tokens: DataFrame, block_tokens: int) -> DataFrame:
    """source, block (from 0), tokens: each source's texts one after another, an end mark after each, cut into blocks of
    block_tokens; a source's last block may be shorter. tokens: a written table, so that row numbers stand."""
    sizes = tokens.select("row", "source", (F.col("n_tokens") + 1).alias("n"), F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int").alias("part"))
    sums = sizes.groupBy("source", "part").agg(F.sum("n").alias("part_n"))
    base = sums.select("source", "part", (F.sum("part_n").over(Window.partitionBy("source").orderBy("part")) - F.col("part_n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("source", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = sizes.withColumn("upto", inside).join(base, ["source", "part"]).select("row", "n", (F.col("base") + F.col("upto") - F.col("n")).alias("at"))
    body = tokens.select("row", "source", F.concat("tokens", F.array(F.lit(END_OF_TEXT))).alias("tokens")).join(places, "row")

    def piece(block):
        first = F.greatest(F.lit(0), block * block_tokens - F.col("at"))
        last = F.least(F.col("n"), (block + 1) * block_tokens - F.col("at"))
        return F.struct(block.alias("block"), (F.col("at") + first).alias("at"), F.slice("tokens", (first + 1).cast("int"), (last - first).cast("int")).alias("tokens"))

    blocks = F.sequence(F.expr(f"at div {block_tokens}"), F.expr(f"(at + n - 1) div {block_tokens}"))
    rows = body.select("source", F.explode(F.transform(blocks, piece)).alias("p")).select("source", "p.block", F.struct("p.at", "p.tokens").alias("piece"))
    return rows.groupBy("source", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["tokens"])).alias("tokens"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network over an even number of bits, walked until the
    value falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            h = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 4 + r) * 0xBF58476D1CE4E5B9 & (2**64 - 1))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


@dataclass
class Source:
    """What the plan knows of a source: size in tokens and blocks, blocks wanted for its target and blocks drawn."""

    name: str
    weight: float
    repeats: int
    tokens: int
    blocks: int
    wanted: int = 0
    drawn: int = 0

    def cap(self) -> int:
        return self.repeats * self.blocks


def plan_slots(sources: list[Source], total: int) -> None:
    """Sets wanted (blocks that hold weight * total tokens of the source) and drawn: as many as its cap allows, plus what
    other sources can't give, shared out by weight among those with room."""
    missing = 0.0
    for s in sources:
        target = s.weight * total
        exact = target * s.blocks / s.tokens if s.tokens else float(target > 0)
        s.wanted = max(0, math.ceil(exact - 1e-9 - 1e-12 * exact))
        s.drawn = min(s.wanted, s.cap())
        missing += max(0.0, target - s.drawn * s.tokens / s.blocks) if s.blocks else target
    while missing >= 1 and (open_ := [s for s in sources if s.weight > 0 and s.tokens and s.drawn < s.cap()]):
        weight, given = sum(s.weight for s in open_), 0.0
        for s in open_:
            more = min(s.cap() - s.drawn, math.floor(missing * s.weight / weight * s.blocks / s.tokens))
            s.drawn += more
            given += more * s.tokens / s.blocks
        if not given:
            break
        missing -= given


def split(counts: np.ndarray, left: int, right: int, rng: np.random.Generator) -> np.ndarray:
    """The counts that fall to the left of two parts of the given sizes; the multinomial, given its totals. Where totals
    are beyond what the generator draws, whole proportional shares go left and only the rest is drawn."""
    total = left + right
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    sure = np.array([int(c) * left // total for c in counts], dtype=np.int64)
    rest = counts - sure
    few = np.minimum(rest, 1_000_000)
    return sure + rng.multivariate_hypergeometric(few, left - int(sure.sum()), method="marginals")


def shard_counts(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the shard, counts of all shards before it), by halving the range of shards."""
    size = lambda a, b: total * b // shards - total * a // shards
    total, lo, hi, before = int(counts.sum()), 0, shards, np.zeros(len(counts), dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(counts, size(lo, mid), size(mid, hi), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            counts, hi = left, mid
        else:
            before, counts, lo = before + left, counts - left, mid
    return counts, before


def slots(spark, sources: list[Source], shards: int | None, seed: int) -> DataFrame:
    """shard, source, repetition, block: what each slot of the mix takes."""
    counts = np.array([s.drawn for s in sources], dtype=np.int64)
    if not counts.sum():
        return spark.createDataFrame([], "shard int, source string, repetition int, block bigint")
    shards = shards or max(64, -(-int(counts.sum()) // SHARD_SLOTS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                own, before = shard_counts(counts, shards, shard, seed)
                for i, s in enumerate(sources):
                    for lo in range(0, int(own[i]), BATCH_SLOTS):
                        k = np.arange(before[i] + lo, before[i] + min(int(own[i]), lo + BATCH_SLOTS))
                        epoch = k // s.blocks
                        block = np.empty(len(k), dtype=np.int64)
                        for e in np.unique(epoch):
                            at = epoch == e
                            block[at] = permuted(k[at] % s.blocks, s.blocks, hash_key(seed, i, int(e)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard, dtype=np.int32)), pa.array([s.name] * len(k), pa.string()), pa.array(epoch.astype(np.int32)), pa.array(block)], ["shard", "source", "repetition", "block"])

    return spark.range(0, shards, 1, min(10_000, -(-shards // 4))).mapInArrow(run, "shard int, source string, repetition int, block bigint")


def hash_key(seed: int, source: int, epoch: int) -> int:
    return (seed * 1_000_003 + source) * 1_000_003 + epoch & (2**60 - 1)


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = 1024, shards: int | None = None, seed: int = 0, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    mix: shard, source, repetition, block, tokens, n_tokens (end marks are not counted); in all about as many tokens as
    the targets' weights ask of the documents' total, as far as the caps allow.
    report: one row per target with target_weight, max_repeats, own_tokens, total_tokens, target_tokens, wanted_blocks
    (blocks of the source's mean size that hold the target), mix_blocks and mix_tokens (both counted in the mix),
    actual_share and falls_short (the mix could not take all wanted blocks).

    Sources are compared trimmed and in lower case; null and blank ones are no source. Targets that then are equal are
    drawn once, with the sum of their weights and the largest number of repeats, and report the same figures; repeated
    rows count once. Documents whose source has no target count for the total and are not drawn. Null weights and repeats
    count as 0. Repeated documents are documents. An empty table gives an empty mix and a report of targets of which none
    has anything to reach."""
    spark = documents.sparkSession
    given = targets.where("source is not null").select("source", normalized("source").alias("name"), F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("repeats")).distinct()
    rows = given.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("targets must have one row per source")
    tokens = materialize(tokenized(documents, vocabulary or f"{TOKENIZERS}/{VOCABULARY}"), "p7-tokens")
    named = F.broadcast(given.select(F.col("name").alias("source")).distinct())  # at most MAX_SOURCES rows, see above
    own = {r.source: (r.n, r.marked) for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") + 1).alias("marked")).join(named, "source", "left_semi").collect()}
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    merged: dict[str, Source] = {}
    for _, name, weight, repeats in sorted(rows, key=lambda r: (r[1], r[0])):
        n, marked = own.get(name, (0, 0))
        s = merged.setdefault(name, Source(name, 0.0, 0, n, -(-marked // block_tokens) if n else 0))
        s.weight, s.repeats = s.weight + weight, max(s.repeats, repeats)
    sources = list(merged.values())
    plan_slots(sources, total)
    mixed = slots(spark, sources, shards, seed).join(packed(tokens, block_tokens), ["source", "block"])
    text_tokens = F.size(F.filter("tokens", lambda t: t != END_OF_TEXT)).alias("n_tokens")
    mixed = materialize(mixed.select("shard", "source", "repetition", "block", "tokens", text_tokens), "p7-mix")
    actual = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("mix_blocks")).withColumnRenamed("source", "name")
    share = F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(Window.partitionBy(F.lit(1))))  # one row per source
    actual = actual.withColumn("actual_share", share)
    plan = spark.createDataFrame([(r.source, r.name, (s := merged[r.name]).weight, s.repeats, s.tokens, total, s.weight * total, s.wanted) for r in rows], "source string, name string, target_weight double, max_repeats int, own_tokens bigint, total_tokens bigint, target_tokens double, wanted_blocks bigint")
    report = plan.join(actual, "name", "left").drop("name").fillna(0, ["mix_tokens", "mix_blocks", "actual_share"])
    return mixed, report.withColumn("falls_short", F.col("wanted_blocks") > F.col("mix_blocks"))
