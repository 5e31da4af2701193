"""Best-fit packing into sequences of several permitted lengths.

Lengths are packed in descending order. A piece goes into the open bin that
it leaves least room in. If none has room, a bin is opened: of the permitted
lengths that hold the piece, the one of least cost for each place that is
expected to be filled, given what is still to come. In the end every bin is
downsized to the shortest permitted length that holds its contents. A
sequence of c places costs c * (1 + c / ATTENTION) + OVERHEAD: its places,
attention between them, and a fixed part.

Documents are dealt to shards of bounded size and each shard packs its own
bins, so nothing grows with the corpus but the number of shards; a shard's
last bins are all that packing apart loses.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, word_count

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 20_000
ATTENTION = 32_768
OVERHEAD = 32


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION) + OVERHEAD


def pack_lengths(lengths, capacities=LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, and the capacity of each bin. Lengths are from 1 to the largest capacity, in descending order."""
    capacities = sorted(capacities)
    price = {c: cost(c) for c in capacities}
    bins: list[int] = []  # room taken
    size: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the rooms that some open bin has, ascending
    rest = sum(lengths)
    where, offset = [], []
    for n in lengths:
        i = bisect_left(rooms, n)
        if i < len(rooms):
            room = rooms[i]
            own = by_room[room]
            b = own.pop()
            if not own:
                del by_room[room]
                rooms.pop(i)
        else:
            fits = capacities[bisect_left(capacities, n):]
            c = min(fits, key=lambda c: (price[c] / min(c, rest), c))
            b, room = len(bins), c
            bins.append(0)
            size.append(c)
        where.append(b)
        offset.append(bins[b])
        bins[b] += n
        rest -= n
        room -= n
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return where, offset, [capacities[bisect_left(capacities, used)] for used in bins]


def _pack_shard(capacities):
    top = max(capacities)

    def run(table: pa.Table) -> pa.Table:
        row = table.column("_row").to_numpy()
        total = table.column("length").to_numpy()
        ids = table.column("doc_id")
        order_of = np.argsort(row, kind="stable")
        of, piece, length = [], [], []
        for i in order_of.tolist():
            left, k = int(total[i]), 0
            while left > 0:  # a document longer than the longest sequence is cut
                of.append(i)
                piece.append(k)
                length.append(min(left, top))
                left -= top
                k += 1
        order = sorted(range(len(of)), key=lambda j: -length[j])
        where, offset, size = pack_lengths([length[j] for j in order], capacities)
        of_sorted = [of[j] for j in order]
        shard = int(table.column("_shard")[0].as_py())
        return pa.table({
            "doc_id": ids.take(pa.array(of_sorted, pa.int64())).combine_chunks() if of_sorted else pa.array([], ids.type),
            "piece": pa.array([piece[j] for j in order], pa.int32()), "length": pa.array([length[j] for j in order], pa.int32()),
            "bin_id": pa.array([shard << 32 | b for b in where], pa.int64()), "bin_offset": pa.array(offset, pa.int32()),
            "bin_capacity": pa.array([size[b] for b in where], pa.int32())})
    return run


def pack(docs: DataFrame, capacities=LENGTHS, shard_rows: int = SHARD_ROWS, length: Column | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents packed into sequences: one row per piece of a document.

    Returns doc_id, piece (from 0), length, bin_id, bin_offset (place of its
    first token in the sequence) and bin_capacity. The length of a document
    is its number of words and one end mark, or the column ``length``; a
    document longer than the longest sequence is cut into pieces of that
    length and a rest. Documents of no words (null and empty texts) have
    nothing to pack and give no row. Rows that repeat an id, or have a null
    one, are packed each for itself. Other columns are ignored; an empty
    table gives no rows.
    """
    words = word_count(F.col(text_col))
    length = F.when(words > 0, words + 1).otherwise(0) if length is None else length
    sized = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("length"),
                              F.monotonically_increasing_id().alias("_row")).filter("length > 0"), "pack-lengths")
    shards = max(1, -(-sized.count() // shard_rows))
    return (sized.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("long")).groupBy("_shard")
            .applyInArrow(_pack_shard(tuple(capacities)), "doc_id long, piece int, length int, bin_id long, bin_offset int, bin_capacity int"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: bin_id, bin_capacity, used and its pieces in order (a sequence holds at most its capacity)."""
    return packed.groupBy("bin_id", "bin_capacity").agg(
        F.sum("length").alias("used"), F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id", "piece", "length"))).alias("pieces"))
