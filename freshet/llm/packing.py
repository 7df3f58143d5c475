"""Items of varying length packed into containers of fixed capacity.

Bounded-space online packing: each partition keeps a fixed number of open containers; an item goes to the fullest one
that still holds it; when none does, the fullest is emitted and a new one opened. What is still open at the end of the
partitions is merged in rounds of the same packing over whole containers, sixty-four partitions to a task at a time. No
item is divided unless it alone exceeds the capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.tokens import MEMO, VOCABULARY, tokenizer
from freshet.session import join_dictionary, reliable_checkpoint

CAPACITY = 2048
#: Open containers of a partition, and partitions whose open containers one merging task takes.
OPEN, FAN = 64, 64


class Packer:
    """Open containers in order of what they hold; closes them by number."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most = capacity, most_open
        self.open: list[tuple[int, int]] = []  # (held, number), ascending
        self.next = 0
        self.closed: set[int] = set()

    def add(self, size: int) -> int:
        """The number of the container that takes an item of ``size``."""
        k = bisect_left(self.open, (self.capacity - size + 1, -1)) - 1  # the fullest with room
        if k >= 0:
            held, number = self.open.pop(k)
        else:
            if len(self.open) >= self.most:
                self.closed.add(self.open.pop()[1])
            held, number = 0, self.next
            self.next += 1
        held += size
        if held >= self.capacity:
            self.closed.add(number)
        else:
            insort(self.open, (held, number))
        return number


def parts_of(size: int, capacity: int) -> list[int]:
    """Sizes of the parts of an item: itself, or, beyond the capacity, full parts and a rest."""
    return [size] if size <= capacity else [capacity] * (size // capacity) + ([size % capacity] if size % capacity else [])


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, n_tokens`` of each text; null texts have none and are left out, an empty text has 0."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for b in batches:
            n = [MEMO.get(("count", vocabulary), t, lambda t=t: tok.count(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, f"key {key_type}, n_tokens bigint").withColumnRenamed("key", key)


def _pack(capacity: int, most_open: int, label: str):
    """First round over ``key, size``: a row per part with its container, and at the end a row per container still open.

    The latter bear what the container holds in ``still_open`` and no part. Nothing but the open containers is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = TaskContext.get().partitionId()
        packer = Packer(capacity, most_open)
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            rows = [(key, k, part, f"{label}{where}-{packer.add(part)}") for key, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, part in enumerate(parts_of(size, capacity))]
            packer.closed.clear()
            if rows:
                yield _rows(*zip(*rows), [None] * len(rows), where, kind)
        if packer.open:
            n = len(packer.open)
            yield _rows([None] * n, [None] * n, [None] * n, [f"{label}{where}-{x}" for _, x in packer.open], [h for h, _ in packer.open], where, kind)

    return run


def _rows(key, part, size, container, still_open, where: int, kind: pa.DataType) -> pa.RecordBatch:
    n = len(container)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, kind), pa.array(part, pa.int32()), pa.array(size, pa.int64()), pa.array(container, pa.string()), pa.array(still_open, pa.int64()), pa.array([where] * n, pa.int32())],
        ["key", "part", "size", "container", "still_open", "lot"],
    )


def _merge(capacity: int, most_open: int, label: str):
    """A merging round over ``container, size`` sorted by size descending: each container with the one it goes into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = TaskContext.get().partitionId()
        packer = Packer(capacity, most_open)
        held: list[tuple[str, int, int]] = []
        for b in batches:
            held += [(c, s, packer.add(s)) for c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if held:
            c, s, n = zip(*held)
            ids = [f"{label}{where}-{x}" for x in n]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(s, pa.int64()), pa.array(ids), pa.array([where] * len(c), pa.int32())], ["container", "size", "into", "lot"])

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, most_open: int = OPEN, fan: int = FAN) -> DataFrame:
    """``key, part, size, container``: every item once, or, beyond the capacity, in parts of the capacity and a rest.

    No container exceeds the capacity. Items of size 0 take no room but get a container. Null and negative sizes are left out; an
    empty table gives an empty one. Repeated keys are separate items. The assignment is written once (reliable
    checkpoint), so the numbers hold when tasks are run again.
    """
    if capacity < 1:
        raise ValueError("capacity is at least 1")
    key_type = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")).filter(F.col("size") >= 0)
    first = reliable_checkpoint(rows.mapInArrow(_pack(capacity, most_open, "a"), f"key {key_type}, part int, size bigint, container string, still_open bigint, lot int"))
    left = first.filter(F.col("still_open").isNotNull()).select("container", "lot", F.col("still_open").alias("size"))
    lots = first.rdd.getNumPartitions()
    moves: list[DataFrame] = []
    for level in range(1, 20):
        groups = max(1, -(-lots // fan))
        ask = left.withColumn("to", F.floor(F.col("lot") / fan).cast("int")).repartition(groups, "to") if groups > 1 else left.coalesce(1)
        ask = ask.sortWithinPartitions(F.desc("size"), "container").select("container", "size")
        moved = reliable_checkpoint(ask.mapInArrow(_merge(capacity, most_open * fan if groups == 1 else most_open, chr(97 + level)), "container string, size bigint, into string, lot int"))
        moves.append(moved)
        if groups == 1:
            break
        left, lots = moved.groupBy(F.col("into").alias("container"), "lot").agg(F.sum("size").alias("size")), groups
    final = moves[0].select("container", "into")
    for m in moves[1:]:
        nxt = m.select(F.col("container").alias("into"), F.col("into").alias("further"))
        final = final.join(nxt, "into", "left").select("container", F.coalesce("further", "into").alias("into"))
    out = join_dictionary(first.filter(F.col("still_open").isNull()), final, ["container"], "left")
    return out.select(F.col("key").alias(key), "part", "size", F.coalesce("into", "container").alias("container"))


def pack_documents(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents in containers of ``capacity`` tokens."""
    return pack(token_counts(df, vocabulary=vocabulary), "doc_id", "n_tokens", capacity)
