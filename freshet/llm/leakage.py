"""Evaluation texts that leaked into a corpus, by greedy string tiling.

Words are hashed with prefix sums over code points, runs of words with a Karp-Rabin roll over the word hashes, all as
numpy arrays over each document. The hashed runs of the evaluation items are a table of seeds; the runs of the documents are
joined to it, and a document that shares seeds with an item is tiled against it: the longest run of matching words is
marked, then the next longest that overlaps no mark, down to the least length, so reordered passages are found as
several tiles. The words themselves are compared, so a hash collision gives no match.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import join_dictionary, reliable_checkpoint

#: Words of the shortest tile.
LEAST = 12
#: Bits of the filter of the items' seeds at most (32 MB), whatever the number of items.
MOST_BITS = 1 << 28
WORDS = re.compile(r"[^\W_]+")

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_C = np.uint64(0xD1B54A32D192ED03)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, without regard to case."""
    return WORDS.findall(text.lower())


def _letter_table() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]] = True
    return out


_LETTER: np.ndarray | None = None


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Powers:
    """Powers of the two bases, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            cls.up, cls.down = _powers(_B, n), _powers(_INVERSE, n)


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, end) of every word of a lower-cased text, positions in code points."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letter_table()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(codes) + 2, np.int8)
    letter[1:-1] = _LETTER[codes]
    step = np.diff(letter)
    first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    Powers.need(len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * Powers.up[: len(codes)], dtype=np.uint64)))
        h = (sums[end] - sums[first]) * Powers.down[first]
    return h ^ (h >> np.uint64(29)), first, end


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin values of all runs of ``n`` hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    Powers.need(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _C * Powers.up[: len(hashes)], dtype=np.uint64)))
        return (sums[n:] - sums[:-n]) * Powers.down[: len(hashes) - n + 1]


def seeds_of(text: str, least: int = LEAST) -> np.ndarray:
    """Distinct hashes of the runs of ``least`` words of a text, as signed numbers."""
    h, _, _ = word_hashes(text.lower())
    return np.unique(rolled(h, least)).view(np.int64)


def item_seeds(items: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """``seed, item``: every run of ``least`` words of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [seeds_of(t, least) for t in b.column(1).to_pylist()]
            if sum(map(len, found)):
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), b.column(0).take(pa.array(at))], ["seed", "item"])

    rows = items.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("item"), text)
    return rows.mapInArrow(run, f"seed bigint, item {items.schema[key].dataType.simpleString()}").distinct()


class Filter:
    """Bloom filter of two probes, at most ``MOST_BITS`` large whatever the number of seeds: what it holds always passes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @classmethod
    def of(cls, seeds: DataFrame) -> Filter:
        """From a written column ``seed``. The bits are set by all tasks; only the filter itself reaches the driver."""
        n = seeds.count()
        bits = min(MOST_BITS, max(1 << 16, 1 << (32 * n).bit_length()))
        low, high = F.col("seed").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(bits - 1))
        at = seeds.select(F.explode(F.array(low, high)).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("set"))
        rows = at.groupBy("word").agg(F.bit_or("set").alias("set")).toPandas()
        words = np.zeros(bits // 64, np.int64)
        words[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
        return cls(words.view(np.uint64))

    def passing(self, runs: np.ndarray) -> np.ndarray:
        """Which of the (unsigned) hashes may be among the seeds."""
        six, one, last = np.uint64(6), np.uint64(1), np.uint64(63)
        test = lambda k: (self.words[(k >> six).astype(np.int64)] >> (k & last)) & one
        out = test(runs & self.mask) == one
        some = np.flatnonzero(out)
        out[some] = test((runs[some] >> np.uint64(32)) & self.mask) == one
        return out


def tiles(document: list[str], item: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document word, item word, length) of the marked tiles, longest first.

    The longest runs of equal words are measured once, from seeds of ``least`` words found by their hash and verified word by
    word. The longest is marked first; one that overlaps a mark goes back as what is left of it, as long as that holds
    ``least`` words. Ties go to the earliest place.
    """
    index: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for j in range(len(item) - least + 1):
        index[tuple(item[j : j + least])].append(j)
    heap: list[tuple[int, int, int]] = []
    upto: dict[int, int] = {}  # by diagonal: the end in the document of the last run measured
    for i in range(len(document) - least + 1):
        for j in index.get(tuple(document[i : i + least]), ()):
            if upto.get(i - j, 0) >= i + least:
                continue
            k = least
            while i + k < len(document) and j + k < len(item) and document[i + k] == item[j + k]:
                k += 1
            upto[i - j] = i + k
            heap.append((-k, i, j))
    heapq.heapify(heap)
    doc_free, item_free = np.ones(len(document), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    while heap:
        k, i, j = heapq.heappop(heap)
        free = doc_free[i : i - k] & item_free[j : j - k]
        if free.all():
            doc_free[i : i - k] = False
            item_free[j : j - k] = False
            out.append((i, j, -k))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def leak(document: str, item: str, least: int = LEAST) -> tuple[int, int, float] | None:
    """(tiles, words of the longest, share of the item's words that is covered) of an item in a text; none where they share no run."""
    words = words_of(item)
    t = tiles(words_of(document), words, least)
    return (len(t), max(k for _, _, k in t), sum(k for _, _, k in t) / len(words)) if t else None


def leaked_items(docs: DataFrame, items: DataFrame, least: int = LEAST, min_coverage: float = 0.0, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item, n_tiles, longest_tile, coverage`` for every document and item that share a run of ``least`` words.

    The items' runs form a table of seeds. The corpus is read once: each text is tested against a filter of the seeds, of
    bounded size, and goes on only with the runs that pass. Those are joined to the table of seeds, and each candidate
    pair is tiled, word by word. ``min_coverage`` keeps pairs in which the tiles cover that share of the item's words.
    Whole texts are read. Null texts match nothing; copies of a document give rows of their own; an item shorter than
    ``least`` words never matches; nothing of the items but the filter is held whole anywhere.
    """
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    seeds = reliable_checkpoint(item_seeds(items, item_key, item_text, least))
    shipped = docs.sparkSession.sparkContext.broadcast(Filter.of(seeds))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for b in batches:
            hits, runs = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                h, _, _ = word_hashes(t.lower())
                r = rolled(h, least)
                r = r[known.passing(r)]
                if len(r):
                    hits.append(i)
                    runs.append(np.unique(r).view(np.int64).tolist())
            if hits:
                at = pa.array(hits)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(runs, pa.list_(pa.int64()))], ["key", "text", "seeds"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t) for i, (d, e) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist())) if (t := leak(d, e, least)) and t[2] >= min_coverage]
            if found:
                at = pa.array([i for i, _ in found])
                n, longest, share = zip(*[t for _, t in found])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(n, pa.int32()), pa.array(longest, pa.int32()), pa.array(share, pa.float64())], ["key", "item", "n_tiles", "longest_tile", "coverage"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") >= 2 * least - 1)
    hits = reliable_checkpoint(rows.mapInArrow(look, f"key {key_type}, text string, seeds array<bigint>").withColumn("uid", F.monotonically_increasing_id()))
    pairs = join_dictionary(hits.select("uid", F.explode("seeds").alias("seed")), seeds, ["seed"]).select("uid", "item").distinct()
    pairs = join_dictionary(hits.select("uid", "key", "text"), pairs, ["uid"])
    said = items.filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("item_text"))
    pairs = join_dictionary(pairs, said, ["item"]).select("key", "text", "item", "item_text")
    # Few in bytes but dear in CPU: spread over all cores.
    pairs = pairs.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    out = pairs.mapInArrow(tile, f"key {key_type}, item {item_type}, n_tiles int, longest_tile int, coverage double")
    return out.withColumnRenamed("key", key).withColumnRenamed("item", item_key)


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold at least twelve consecutive words of an item."""
    return leaked_items(docs, items).select("doc_id", "item_id")
