"""Bulk-synchronous best-fit packing of token sequences.

Documents are tokenised once into pieces of at most `capacity` tokens (only longer ones are cut). A full piece is a sequence
of its own, and so begins every piece longer than half the capacity. The others are placed band by band, the longest first
(`bands`); a band takes turns until all its pieces are placed:

1. pieces and gaps are range-sorted together, the largest first;
2. each range sweeps downwards: a piece takes the smallest gap of the range that holds it (best fit), and the gap is updated;
3. pieces that found no gap in their range are matched with the gaps that ranges above have left, the nearest first. Nobody
   sees them all: ranges tell how many they have of each size, conflicts are resolved by ranks (the r-th piece takes the r-th
   place), and pieces and gaps meet by an equi-join on range, size and rank;
4. a range above which no gap is left opens new sequences for its pieces, which lower bands go on to fill.

Scale: a turn moves two or three numbers a piece or gap, and only gaps that the band can use. Keys end in an id, so a length that
a third of all pieces have spreads over ranges. The driver holds counts by range and size only (at most `capacity` a range),
never a piece. A turn's tables are written, so a lost executor costs a turn's tasks. Offsets are running sums within a
sequence, which holds `capacity` pieces at the most.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, bounded_batches, table, tokenizer_file
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * bool(head) + [(s, capacity) for s in range(head, n, capacity)]


def bands(capacity: int) -> list[tuple[int, int]]:
    """(shortest, longest) of the bands below half the capacity: three halvings, and all the rest."""
    out, high = [], capacity // 2
    while high and len(out) < 3:
        low = high // 2 + 1 if len(out) < 2 else 1
        out.append((low, high))
        high = low - 1
    return out


class Gaps:
    """Sequences by what they have free; a bit for each size that some have."""

    def __init__(self):
        self.by_size: dict[int, list[int]] = {}
        self.open = 0

    def put(self, size: int, bin_: int) -> None:
        if size:
            self.by_size.setdefault(size, []).append(bin_)
            self.open |= 1 << size

    def take(self, length: int) -> tuple[int, int] | None:
        """(size, sequence) of the smallest gap that holds the length."""
        above = self.open >> length
        if not above:
            return None
        size = length + (above & -above).bit_length() - 1
        own = self.by_size[size]
        found = own.pop()
        if not own:
            self.open &= ~(1 << size)
        return size, found


PLACED, UNPLACED, LEFT, FRESH = range(4)
SWEPT = "what int, part int, size int, rank long, item long, bin long"


def sweep(rows: DataFrame, capacity: int) -> DataFrame:
    """A turn's sweep over (size, gap, id), gaps before pieces of their size. Rows of SWEPT:

    PLACED pieces with their sequence; UNPLACED ones with their rank in the range and the new sequence they would go to;
    LEFT gaps with their rank among those of a size; FRESH gaps of the new sequences.
    """

    def walk(batches):
        part, gaps, fresh, n = TaskContext.get().partitionId(), Gaps(), Gaps(), 0
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SWEPT.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for size, is_gap, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if is_gap:
                    gaps.put(size, own)
                elif found := gaps.take(size):
                    gaps.put(found[0] - size, found[1])
                    out.append((PLACED, part, size, 0, own, found[1]))
                else:
                    gap, bin_ = fresh.take(size) or (capacity, own)
                    fresh.put(gap - size, bin_)
                    out.append((UNPLACED, part, size, n, own, bin_))
                    n += 1
            if len(out) >= 10_000:
                yield flush()
        for what, some in ((LEFT, gaps), (FRESH, fresh)):
            for size, bins in some.by_size.items():
                for rank, bin_ in enumerate(bins):
                    out.append((what, part, size, rank, None, bin_))
                    if len(out) >= 10_000:
                        yield flush()
        yield flush()

    ranged = rows.repartitionByRange(F.desc("size"), F.desc("gap"), "id").sortWithinPartitions(F.desc("size"), F.desc("gap"), "id")
    return ranged.mapInArrow(walk, SWEPT)


def resolve(counts: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, ...]], set[int]]:
    """From (what, part, size, n) of all ranges, the matches of unplaced pieces with gaps that ranges above have left:

    (part, first rank, pieces, part of the gaps, their size, first rank, pieces to a gap), the smallest gaps first that hold each
    piece of the range; and the ranges for none of whose pieces a gap is left, which open new sequences. Ranges go downwards
    in size with their number. What is in neither waits for the next turn, in which the gaps are sorted anew.
    """
    unplaced: dict[int, dict[int, int]] = {}
    left: dict[int, dict[int, int]] = {}
    for what, part, size, n in counts:
        if what in (UNPLACED, LEFT):
            (unplaced if what == UNPLACED else left).setdefault(part, {})[size] = n
    matches, opening = [], set()
    free: dict[int, list[list[int]]] = {}  # by size, what ranges above have: [part, first rank, how many]
    for part in sorted({*unplaced, *left}):
        own = unplaced.get(part, {})
        n, rank, longest = sum(own.values()), 0, max(own, default=0)
        for size in sorted(k for k in free if n and k >= longest):
            each = size // longest
            while rank < n and free[size]:
                at, first, have = free[size][-1]
                use = min(have, -(-(n - rank) // each))
                took = min(n - rank, use * each)
                matches.append((part, rank, took, at, size, first, each))
                rank += took
                free[size].pop()
                if use < have:
                    free[size].append([at, first + use, have - use])
            if not free[size]:
                del free[size]
        if n and not rank and max(free, default=0) < min(own):
            opening.add(part)
        for size, have in left.get(part, {}).items():
            free.setdefault(size, []).append([part, 0, have])
    return matches, opening


def matched(unplaced: DataFrame, matches: list[tuple[int, ...]]) -> DataFrame:
    """(item, length, part, size, rank) of the unplaced pieces that a match gives a gap: its range, size and rank."""
    rows = np.array(sorted(matches), np.int64).reshape(-1, 7)
    shared = unplaced.sparkSession.sparkContext.broadcast((rows[:, 0] * (1 << 40) + rows[:, 1], rows))

    def look_up(batches):
        keys, rows = shared.value
        for batch in batches:
            part, rank = (batch.column(i).to_numpy().astype(np.int64) for i in range(2))
            at = np.searchsorted(keys, part * (1 << 40) + rank, side="right") - 1
            own = rows[np.maximum(at, 0)]
            hit = np.flatnonzero((at >= 0) & (own[:, 0] == part) & (rank < own[:, 1] + own[:, 2]))
            own, rank = own[hit], rank[hit]
            cols = [batch.column(2).take(pa.array(hit)), batch.column(3).take(pa.array(hit)), *(pa.array(x) for x in (own[:, 3].astype(np.int32), own[:, 4].astype(np.int32), own[:, 5] + (rank - own[:, 1]) // own[:, 6]))]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "length", "part", "size", "rank"])

    return unplaced.select("part", "rank", "item", F.col("size").alias("length")).mapInArrow(look_up, "item long, length int, part int, size int, rank long")


def place(items: DataFrame, capacity: int, shelf: Shelf) -> DataFrame:
    """(item, bin) for `items` (item, length) shorter than the capacity: each with the sequence it goes to, named by the item that opened it."""
    large = items.where(F.col("length") > capacity // 2)
    placed = large.select("item", F.col("item").alias("bin"))
    gaps = shelf.put(large.select(F.col("item").alias("bin"), (F.lit(capacity) - F.col("length")).cast("int").alias("size")), "gaps")
    for number, (low, high) in enumerate(bands(capacity)):
        todo, turn = items.where(F.col("length").between(low, high)).select("item", F.col("length").alias("size")), 0
        while todo is not None:
            name, usable = f"{number}-{turn}", F.col("size") >= low
            both = gaps.where(usable).select("size", F.lit(True).alias("gap"), F.col("bin").alias("id")).unionByName(todo.select("size", F.lit(False).alias("gap"), F.col("item").alias("id")))
            swept = shelf.put(sweep(both, capacity), f"swept-{name}")
            left, unplaced = swept.where(F.col("what") == LEFT), swept.where(F.col("what") == UNPLACED)
            counts = swept.where(F.col("what").isin(UNPLACED, LEFT)).groupBy("what", "part", "size").count().collect()  # by range and size
            matches, opening = resolve([tuple(r) for r in counts])
            opens = F.col("part").isin(sorted(opening)) if opening else F.lit(False)
            now = swept.where(F.col("what") == PLACED).select("item", "bin").unionByName(unplaced.where(opens).select("item", "bin"))
            rest = gaps.where(~usable).unionByName(swept.where((F.col("what") == FRESH) & opens).select("bin", "size"))
            if matches:
                pairs = shelf.put(matched(unplaced, matches).join(left.select("part", "size", "rank", "bin"), ["part", "size", "rank"]).select("item", "bin", "length"), f"pairs-{name}")
                now = now.unionByName(pairs.select("item", "bin"))
                used = pairs.groupBy("bin").agg(F.sum("length").alias("used"))
                after = left.select("bin", "size").join(used, "bin", "left").select("bin", (F.col("size") - F.coalesce("used", F.lit(0))).cast("int").alias("size"))
                todo = unplaced.where(~opens).join(pairs, "item", "left_anti").select("item", "size")
                still = sum(r["count"] for r in counts if r.what == UNPLACED and r.part not in opening) - sum(m[2] for m in matches)
            else:
                after, todo = left.select("bin", "size"), unplaced.where(~opens).select("item", "size")
                still = sum(r["count"] for r in counts if r.what == UNPLACED and r.part not in opening)
            gaps = shelf.put(rest.unionByName(after.where("size > 0")), f"gaps-{name}")
            placed = placed.unionByName(now)
            todo, turn = todo if still else None, turn + 1
    return placed


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece, with a number of its own: its task and its place among that task's pieces."""
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def tokenise(batches):
        enc, end, item = encoder(tokenizer_file(tokenizer)), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, k, start, n, zlib.crc32(own), item, own)[: len(names)])
                    item += 1
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenise, PIECE + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Every piece of every row of `docs` (`doc_id`, `text`; other columns take no part):

    doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids as bytes.

    A null or empty text is one piece of the end id alone. Rows that repeat an id are packed each;
    a null id stays null. Without documents there are no pieces. Ties go to any piece or gap of a size:
    whichever it is, sequences are filled alike.
    """
    shelf = Shelf(docs.sparkSession)
    made = shelf.put(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    out = [x for x in made.columns if x != "item"]
    full, part = made.where(F.col("length") == capacity), made.where(F.col("length") < capacity)
    placed = place(part.select("item", F.col("length").cast("int").alias("length")), capacity, shelf)
    by_item = part.join(placed, "item").withColumnRenamed("bin", "sequence_id")
    own = Window.partitionBy("sequence_id").orderBy("item")
    offset = (F.sum("length").over(own) - F.col("length")).alias("offset")
    alone = full.select(*out, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return by_item.select(*out, "sequence_id", offset).unionByName(alone)


def op6_best_fit_pack(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
