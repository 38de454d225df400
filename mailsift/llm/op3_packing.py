"""Operator 3: best-fit packing by a grouping genetic algorithm on islands.

A document's ids (its text's ids and an end id) are one piece of at most ``CAPACITY`` ids, or, if
it is longer, several: the first takes what is left over, the others are full. Pieces are dealt
evenly into blocks of about ``BLOCK`` pieces by a hash of their place in the staged table, never
by document, so a repeated document cannot fill a block.

Each block is packed by ``ISLANDS`` islands, each a task of its own with its own seed. An
individual is a grouping of pieces into bins. Crossover copies whole well-filled bins of one
parent into the other, removes the bins that now hold a piece twice and best-fits the pieces
that lost their bin; mutation empties a few ill-filled bins the same way. After every epoch but
the last the islands of a block send their elite to the next island, which goes on from both.
Evolution ends early when a grouping reaches the least possible number of bins. What travels is
one row for each block and island: lengths and bin numbers, no text or ids.

The bins that a level leaves ill-filled (``ILL`` of their capacity free, or more) are dealt,
whole, into new blocks and packed again by the same islands, starting from the bins as they are,
so a level never adds a bin. Levels end when the ill-filled bins of all blocks fitted into one
block, or when a level has saved no bin; the number of bins that go up falls with each.

Null or empty text: a piece of the end id alone. Null and repeated ids: pieces of their own. An
empty table: no pieces. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import parts, staged, table
from mailsift.llm.tokens import END_ID, default_path, encoder

CAPACITY = 2048
BLOCK = 8192
ISLANDS = 4
EPOCHS = 3
POPULATION = 4
GENERATIONS = 6
ILL = 1 / 32
_END = np.array([END_ID], "<u4").tobytes()


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in parts(batches, "text", 8 << 20):
            at, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(enc.encode_all(part.column("text"))):
                ids += _END
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a:4 * b]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins being filled, found by the room they have left: the best fit is the lowest set bit
    of ``rooms`` from a piece's length on."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms = capacity, 0
        self.by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def add(self, items: list[int], room: int) -> None:
        self.by_room[room].append(items)
        self.rooms |= 1 << room

    def fit(self, item: int, length: int) -> None:
        fitting = self.rooms >> length
        if not fitting:
            self.add([item], self.capacity - length)
            return
        room = length + (fitting & -fitting).bit_length() - 1
        same = self.by_room[room]
        items = same.pop()
        if not same:
            self.rooms &= ~(1 << room)
        items.append(item)
        self.add(items, room - length)

    def grouping(self) -> list[tuple[int, list[int]]]:
        """(room, items) of every bin."""
        return [(room, items) for room, bins in enumerate(self.by_room) for items in bins]


def best_fit(items: list[int], lengths: list[int], bins: Bins) -> list[tuple[int, list[int]]]:
    for i in items:
        bins.fit(i, lengths[i])
    return bins.grouping()


def fitness(grouping: list[tuple[int, list[int]]], capacity: int) -> float:
    """Fewer bins first, then the mean squared filling (it rewards full bins beside empty ones)."""
    return -len(grouping) + sum(((capacity - r) / capacity) ** 2 for r, _ in grouping) / max(1, len(grouping))


def crossover(mother, father, lengths, capacity, dice) -> list[tuple[int, list[int]]]:
    """Whole well-filled bins of the father go into the mother's grouping."""
    full = sorted(father, key=lambda b: b[0])
    best = full[:max(1, len(full) // 2)]
    begin = dice.randrange(len(best))
    given = best[begin:begin + max(1, dice.randrange(1, len(best) + 1))]
    inside = {i for _, items in given for i in items}
    bins, displaced = Bins(capacity), []
    for room, items in given:
        bins.add(list(items), room)
    for room, items in mother:
        if inside.isdisjoint(items):
            bins.add(list(items), room)
        else:
            displaced += [i for i in items if i not in inside]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, bins)


def mutate(grouping, lengths, capacity, dice) -> list[tuple[int, list[int]]]:
    """Empty the worst-filled bins and a few others, and best-fit their pieces again."""
    order = sorted(grouping, key=lambda b: -b[0])
    n = max(2, len(order) // 50)
    gone = order[:n] + dice.sample(order[n:], min(n, len(order[n:])))
    emptied = {id(b[1]) for b in gone}
    bins = Bins(capacity)
    for room, items in grouping:
        if id(items) not in emptied:
            bins.add(list(items), room)
    displaced = sorted((i for _, items in gone for i in items), key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, bins)


def evolve(lengths: list[int], capacity: int, seed: int, migrants: list[list[tuple[int, list[int]]]],
           generations: int = GENERATIONS, population: int = POPULATION) -> list[tuple[int, list[int]]]:
    """The best grouping of one island; ``migrants`` are groupings that it starts from."""
    dice = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    items = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    group = list(migrants)
    score = lambda g: fitness(g, capacity)
    if group and len(max(group, key=score)) <= least:
        return max(group, key=score)
    while len(group) < population:
        # the first newcomer takes pieces by length, the others nearly so
        order = items if not group else sorted(items, key=lambda i: -lengths[i] * dice.uniform(0.9, 1.1))
        group.append(best_fit(order, lengths, Bins(capacity)))
        if len(group[-1]) <= least:
            return group[-1]
    for _ in range(generations):
        group.sort(key=score, reverse=True)
        if len(group[0]) <= least:
            break
        children = []
        for _ in range(population):
            mother, father = dice.sample(group, 2)
            child = crossover(mother, father, lengths, capacity, dice)
            children.append(mutate(child, lengths, capacity, dice) if dice.random() < 0.5 else child)
        group = sorted(group + children, key=score, reverse=True)[:population]
    return max(group, key=score)


def _numbers(grouping, n: int) -> list[int]:
    out = [0] * n
    for k, (_, items) in enumerate(grouping):
        for i in items:
            out[i] = k
    return out


def _grouping(numbers, lengths, capacity) -> list[tuple[int, list[int]]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        bins.setdefault(int(k), []).append(i)
    return [(capacity - sum(lengths[i] for i in items), items) for items in bins.values()]


def _numpy(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray | None:
    """One list of a batch, without a Python object for each number."""
    found = batch.column(column)[row].values
    return None if found is None else found.to_numpy(zero_copy_only=False)


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (block, island) in enumerate(zip(batch.column("block").to_pylist(), batch.column("island").to_pylist())):
                sizes, *known = (_numpy(batch, c, row) for c in ("lengths", "elite", "migrant"))
                given = [np.unique(x, return_inverse=True) for x in known if x is not None]
                least = -(-int(sizes.sum()) // capacity)
                ended = [numbers for bins, numbers in given if len(bins) <= least]
                if ended:  # nothing better exists, so it goes on as it is
                    elite, score = ended[0], 1.0
                else:
                    lengths = sizes.tolist()
                    seeds = [_grouping(numbers.tolist(), lengths, capacity) for _, numbers in given]
                    best = evolve(lengths, capacity, hash((block, island, epoch)), seeds)
                    elite, score = _numbers(best, len(lengths)), fitness(best, capacity)
                out = [pa.array([block]), pa.array([island], pa.int32()), batch.column("lengths").slice(row, 1),
                       pa.ListArray.from_arrays(pa.array([0, len(elite)], pa.int32()), pa.array(elite, pa.int64())), pa.array([score])]
                yield pa.RecordBatch.from_arrays(out, ["block", "island", "lengths", "elite", "fitness"])
    return run


def _grouped(lists: DataFrame, capacity: int, islands: int) -> DataFrame:
    """``lists`` (block, pieces, elite) to the best bins: block, bins (a number for each piece)."""
    spark = lists.sparkSession
    tasks = max(1, min(lists.count() * islands, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "block long, island int, lengths array<int>, elite array<long>, fitness double"
    turn = lists.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                        F.transform("pieces", lambda p: p["length"].cast("int")).alias("lengths"),
                        "elite", F.lit(None).cast("array<long>").alias("migrant"))
    for epoch in range(EPOCHS):
        ended = turn.repartition(tasks, "block", "island").mapInArrow(_epoch(capacity, epoch), schema)
        if epoch + 1 < EPOCHS:
            ended = staged(ended, "islands")
            sent = ended.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
            turn = ended.join(sent, ["block", "island"]).select("block", "island", "lengths", "elite", "migrant")
    return ended.groupBy("block").agg(F.max_by("elite", F.struct("fitness", -F.col("island"))).alias("bins"))


def pack_level(lists: DataFrame, columns: list[str], level: int, capacity: int, islands: int) -> DataFrame:
    """The pieces of ``lists`` (block, pieces, elite) with sequence_id, offset and ``room``, what
    their bin has left."""
    def place_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            for row, b in enumerate(batch.column("block").to_pylist()):
                bins, lengths = (_numpy(batch, c, row).tolist() for c in ("bins", "lengths"))
                used: dict[int, int] = {}
                offsets = []
                for k, n in zip(bins, lengths):
                    offsets.append(used.get(k, 0))
                    used[k] = offsets[-1] + n
                rooms = [capacity - used[k] for k in bins]
                yield pa.RecordBatch.from_arrays([pa.array([b]), *(pa.array([x], kind) for x in (offsets, bins, rooms))],
                                                 ["block", "offsets", "bins", "rooms"])

    best = _grouped(lists, capacity, islands)
    placed = best.join(lists.select("block", F.transform("pieces", lambda p: p["length"]).alias("lengths")), "block") \
        .select("block", "bins", "lengths") \
        .mapInArrow(place_pieces, "block long, offsets array<long>, bins array<long>, rooms array<long>")
    rows = lists.join(placed, "block").select("block", F.explode(F.arrays_zip("pieces", "bins", "offsets", "rooms")).alias("r"))
    number = F.lit(level << 58) + F.col("block") * F.lit(1 << 24) + F.col("r.bins")
    return rows.select(F.struct(*[F.col("r.pieces")[c].alias(c) for c in columns]).alias("piece"),
                       number.alias("sequence_id"), F.col("r.offsets").alias("offset"), F.col("r.rooms").alias("room"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them) with sequence_id and offset."""
    columns = pieces.columns
    pieces = staged(pieces, "pieces")
    blocks = max(1, -(-pieces.count() // block))
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    dealt = pieces.select(F.pmod(place, F.lit(blocks)).alias("block"), F.struct(*columns).alias("piece"))
    # a block has about `block` pieces whatever the data, so its list is bounded
    lists = dealt.groupBy("block").agg(F.collect_list("piece").alias("pieces")).withColumn("elite", F.lit(None).cast("array<long>"))
    done, level, least = [], 0, int(capacity * ILL)
    while True:
        rows = staged(pack_level(staged(lists, "blocks"), columns, level, capacity, islands), "packed")
        ill = rows.where(F.col("room") >= least)
        bins = F.count(F.when(F.col("offset") == 0, 1))
        n, now = ill.agg(F.count(F.lit(1)), bins).first()
        saved = level == 0 or rows.agg(bins).first()[0] < before  # noqa: F821
        if blocks == 1 or now < 2 or not saved:
            done.append(rows)
            break
        done.append(rows.where(F.col("room") < least))
        blocks, level, before = max(1, -(-n // block)), level + 1, now
        # a bin goes to one block as a whole: the bins as they are start the evolution
        lists = ill.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(blocks)).alias("block")) \
            .agg(F.collect_list(F.struct("piece", "sequence_id")).alias("r")) \
            .select("block", F.col("r.piece").alias("pieces"), F.col("r.sequence_id").alias("elite"))
    return reduce(DataFrame.unionByName, done).select("piece.*", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents"), default_path()))
