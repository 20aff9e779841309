"""Evaluation texts inside training texts, found with suffix arrays over words.

Each task builds the suffix array of its shard of the corpus (the words of its documents in one sequence) by prefix
doubling, binary-searches every test suffix in it and so gets the longest verbatim match of each document and item and
its places. Words that no test item has can't be part of a match; they act as separators, and suffixes with fewer than
`least` test words ahead are left out of the array. The corpus is read once and not shuffled.

The test items are sent to all tasks in blocks of at most ITEM_BLOCK words, one block at a time, so the size of what is
held and broadcast is bounded. Matches are expanded EXPAND at a time and at once reduced to the longest one of each
document and item; only those that begin a match are measured.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.session import materialize

LEAST = 12
#: Words of test items handled at once, and words of documents in one suffix array.
ITEM_BLOCK = 2_000_000
SHARD_WORDS = 1_000_000
#: Pairs of matching suffixes that are expanded at once.
EXPAND = 500_000


def words(text) -> F.Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.expr(f"regexp_extract_all(lower({text}), '[a-z0-9]+', 0)")


def ranks_of_suffixes(x: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes of x that start at `at`, compared by their first `longest` (or more) words."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    n, step = len(x), 1
    while step < longest:
        pair = rank * (n + 2)
        pair[: n - step] += rank[step:] if step < n else 0
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        if rank.max(initial=0) == n:
            break
        step *= 2
    return at[np.argsort(rank[at], kind="stable")]


def compare(x: np.ndarray, at: np.ndarray, y: np.ndarray, start: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Common length of the suffixes x[at:] and y[start:] up to longest words, and whether x's is the smaller.
    Both arrays end with a sentinel that equals nothing."""
    length = np.zeros(len(at), dtype=np.int64)
    smaller = np.zeros(len(at), dtype=bool)
    live = np.arange(len(at))
    for k in range(longest):
        a, b = x[np.minimum(at[live] + k, len(x) - 1)], y[np.minimum(start[live] + k, len(y) - 1)]
        differ = a != b
        smaller[live[differ]] = (a < b)[differ]
        live = live[~differ]
        length[live] = k + 1
        if not len(live):
            break
    return length, smaller


def matches_in_shard(corpus: np.ndarray, tests: np.ndarray, least: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(corpus place, test place, common words), in parts, for all pairs of suffixes that share at least `least` words and
    whose words before them differ. Separators are negative and different in both sequences."""
    def starts(x: np.ndarray) -> np.ndarray:
        stops = np.append(np.flatnonzero(x < 0), len(x))
        return np.flatnonzero((stops[np.searchsorted(stops, np.arange(len(x)))] - np.arange(len(x))) >= least)

    at, queries = starts(corpus), starts(tests)
    if not len(at) or not len(queries):
        return
    x, y = np.append(corpus, -1), np.append(tests, -2)
    order = ranks_of_suffixes(x, at, least)
    bounds = []
    for upper in (False, True):  # the span of suffixes that share the first `least` words
        lo, hi = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(order), dtype=np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            length, smaller = compare(x, order[mid], y, queries[open_], least)
            right = smaller | (length >= least) if upper else smaller & (length < least)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        bounds.append(lo)
    counts = bounds[1] - bounds[0]
    ends = np.cumsum(counts)
    for lo in range(0, int(ends[-1]), EXPAND):
        k = np.arange(lo, min(int(ends[-1]), lo + EXPAND))
        which = np.searchsorted(ends, k, side="right")
        place, test = order[bounds[0][which] + k - (ends[which] - counts[which])], queries[which]
        # a pair whose words before agree continues a match that begins earlier; before the first word stands a separator
        begins = x[place - 1] != y[test - 1]
        place, test = place[begins], test[begins]
        yield place, test, compare(x, place, y, test, longest)[0]


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document and item that share `least` successive words: doc_id, item_id, match_words (the longest
    match), doc_word and item_word (its first places, in words from 0).

    Whole texts are searched. Null and empty texts match nothing, nor do texts of fewer than `least` words; repeated
    rows give one row; other columns are ignored; empty tables give no rows; null ids give none."""
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), words("text").alias("words"))
    found, blocks = None, item_blocks(items)
    block = next(blocks, None)
    while block is not None:
        part, shared = search(texts, *block, least)
        block = next(blocks, None)
        if found is not None or block is not None:  # several blocks: each is searched and let go before the next
            part = materialize(part, "p6-matches")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, match_words int, doc_word int, item_word int")
    best = F.max_by(F.struct("match_words", "doc_word", "item_word"), F.struct("match_words", -F.col("doc_word"), -F.col("item_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def item_blocks(items: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """The test items as word numbers, in blocks of bounded size, one at a time; a stated query set that is held against
    all rows."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), words("text")).toLocalIterator()
    ids, texts, size = [], [], 0

    def block() -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        flat = pa.array([w for t in texts for w in t], pa.string())
        vocabulary = flat.unique()
        numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + 1) - lengths - 1
        tests = np.full(int((lengths + 1).sum()), -2, dtype=np.int64)
        tests[np.delete(np.arange(len(tests)), starts + lengths)] = numbers
        return np.array(ids, dtype=np.int64), starts, vocabulary, tests

    for item_id, text in rows:
        if size + len(text) > ITEM_BLOCK and ids:
            yield block()
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text)
    if ids:
        yield block()


def search(texts: DataFrame, item_ids: np.ndarray, item_starts: np.ndarray, vocabulary: pa.Array, tests: np.ndarray, least: int) -> tuple[DataFrame, Broadcast]:
    """The matches of one block of items with all texts, and the broadcast that holds the block."""
    longest = int(np.diff(np.append(item_starts, len(tests))).max())
    shared = texts.sparkSession.sparkContext.broadcast((item_ids, item_starts, vocabulary.to_pylist(), tests))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        item_ids, item_starts, vocabulary, tests = shared.value
        vocabulary = pa.array(vocabulary, pa.string())
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            doc_ids, lengths, numbers = (np.concatenate(c) for c in zip(*held))
            starts = np.cumsum(lengths + 1) - lengths - 1
            corpus = np.full(len(numbers) + len(lengths), -1, dtype=np.int64)
            corpus[np.delete(np.arange(len(corpus)), starts + lengths)] = numbers
            # stretches without enough test words ahead can't match; their separators are merged away with them
            for place, test, length in matches_in_shard(corpus, tests, least, longest):
                doc, item = np.searchsorted(starts, place, side="right") - 1, np.searchsorted(item_starts, test, side="right") - 1
                doc_word, item_word = place - starts[doc], test - item_starts[item]
                order = np.lexsort((item_word, doc_word, -length, item, doc))
                doc, item = doc[order], item[order]
                first = np.ones(len(order), dtype=bool)
                first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                pick = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[doc[first]]), pa.array(item_ids[item[first]]), *(pa.array(v[pick].astype(np.int32)) for v in (length, doc_word, item_word))], ["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            numbers = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), lengths, numbers))
            size += len(numbers)
            if size >= SHARD_WORDS:
                yield from shard()
                held, size = [], 0
        if held:
            yield from shard()

    return texts.mapInArrow(run, "doc_id bigint, item_id bigint, match_words int, doc_word int, item_word int"), shared


def without_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents that share no passage with a test item; documents without an id stay."""
    return documents.join(leaked_passages(documents, items, least).select("doc_id").distinct(), "doc_id", "left_anti")
