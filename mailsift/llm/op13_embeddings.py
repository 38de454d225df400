"""Operator 13: near-duplicate embeddings by collision-counting projections.

Vectors of one label link if their cosine, in double precision, is ``COSINE`` or more. Unit vectors
at that cosine lie at most ``r = sqrt(2 - 2 cosine)`` apart.

Each vector is projected on ``GROUPS * s`` fixed random directions. A pair collides in a projection
if the query-centred window of half-width ``h`` holds the other's value. A pair passes if it
collides in all but ``GROUPS - 1`` projections, and is then verified by its cosine. ``h`` is
calibrated for recall: it is the least width at which each of 100,000 random pairs at distance
``r``, the worst case, passes. The directions are drawn without a look at the data, so this holds
for any data; the expected loss is about one borderline pair in 100,000, and less for closer ones.

A passing pair misses at most ``GROUPS - 1`` projections, so in at least one of the ``GROUPS`` groups of
``s`` projections it collides in all. That is where it is met: a vector has one home cell in the
grid of each group and asks in all cells that its window touches. Inside a cell the homes are
sorted by one projection, the windows are ranges there, and the collisions of what is left are
counted over all projections. A pair that several groups meet counts in the first of them. ``s`` grows with
the logarithm of the largest label, so that cells stay small, up to ``MAX_LEVELS``.

Equal vectors of a label are one row with a count from the start. The homes of a cell of more than
``BLOCK`` are dealt to blocks, and each asking vector goes to every block: no task holds a whole dense
group, and what leaves a task is a number of links for each asking vector and a spanning forest of
the links, never the pairs. Counting the links of n different vectors that all link still
compares n * n pairs, spread over n / BLOCK tasks.

Null, empty or zero vectors, null or non-finite components, null labels: no links, a component of
their own. Vectors of different lengths never link. Null id: the row stays, has its class's least id
(null, and kept false, if there is none). Repeated rows and ids: a row each, linked with each
other like any equal vectors. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import staged, table
from mailsift.llm.components import connected_components

COSINE = 0.98
GROUPS = 6
MAX_LEVELS = 5
#: Homes of a cell in one task, pairs compared at once, homes that a cell should have about.
BLOCK = 4096
_PAIRS = 1 << 16
_HOMES = 1024
_DRAWN = 100_000


@lru_cache(maxsize=16)
def projections(dim: int, levels: int, cosine: float) -> tuple[np.ndarray, float]:
    """(directions, window): ``GROUPS * levels`` unit directions, orthogonal in runs of ``dim``, and the
    half-width at which all drawn pairs at the limit pass."""
    dice = np.random.default_rng([dim, levels])
    count = GROUPS * levels
    runs = [np.linalg.qr(dice.standard_normal((dim, dim)))[0].T for _ in range(-(-count // dim))] if dim < count \
        else [np.linalg.qr(dice.standard_normal((dim, count)))[0].T]
    directions = np.ascontiguousarray(np.concatenate(runs)[:count])
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    widest = 0.0
    for _ in range(10):
        drawn = dice.standard_normal((_DRAWN // 10, dim))
        drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
        apart = np.abs(drawn @ directions.T) * reach
        widest = max(widest, float(np.partition(apart, count - GROUPS, axis=1)[:, count - GROUPS].max()))
    return directions, max(widest * (1 + 1e-9), 1e-9)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the largest component first, so nothing overflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(at: np.ndarray) -> np.ndarray:
    return at.astype("<i2")


def _keys(group: int, dim: int, cells: np.ndarray) -> list[bytes]:
    head = np.array([group], "<i2").tobytes() + np.array([dim], "<i4").tobytes()
    return [head + row.tobytes() for row in _cells(cells)]


def _by_length(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors) for each length that occurs."""
    lists = batch.column("embedding")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[(starts[rows][:, None] + np.arange(dim))]


def _homes(levels: int, cosine: float, kind: str):
    """(label, cell) of each vector's home cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_length(batch, kind):
                directions, h = projections(vectors.shape[1], levels, cosine)
                at = np.floor(units(vectors) @ directions.T / (3 * h))
                label = batch.column("label").take(pa.array(rows))
                for g in range(GROUPS):
                    keys = _keys(g, vectors.shape[1], at[:, g * levels:(g + 1) * levels])
                    yield pa.RecordBatch.from_arrays([label, pa.array(keys, pa.binary())], ["label", "cell"])
    return run


def _asked(levels: int, cosine: float, kind: str):
    """Each vector at home (asks = 0) and in every cell that its windows touch (asks = 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                for rows, vectors in _by_length(batch, kind):
                    directions, h = projections(vectors.shape[1], levels, cosine)
                    on = units(vectors) @ directions.T
                    raw = [v.tobytes() for v in vectors]
                    for g in range(GROUPS):
                        x = on[:, g * levels:(g + 1) * levels]
                        home = np.floor(x / (3 * h))
                        low, high = np.floor((x - h) / (3 * h)), np.floor((x + h) / (3 * h))
                        who, cells = np.arange(len(rows)), np.empty((len(rows), 0))
                        for level in range(levels):  # the window touches one or two cells of a level
                            two = np.flatnonzero(high[who, level] > low[who, level])
                            cells = np.concatenate([np.column_stack([cells, low[who, level]]), np.column_stack([cells[two], high[who[two], level]])])
                            who = np.concatenate([who, who[two]])
                        place = np.concatenate([np.arange(len(rows)), who])
                        keys = _keys(g, vectors.shape[1], np.concatenate([home, cells]))
                        asks = np.repeat(np.array([0, 1], np.int8), [len(rows), len(who)])
                        take = pa.array(rows[place])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("label").take(take), pa.array(keys, pa.binary()), pa.array(asks), batch.column("node").take(take),
                             batch.column("copies").take(take), pa.array([raw[i] for i in place], pa.binary())],
                            ["label", "cell", "asks", "node", "copies", "vector"])
    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the edges (a, b) join, one fewer than nodes in each component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    parent = np.arange(len(nodes))
    while len(x):
        rx, ry = parent[x], parent[y]
        differ = rx != ry
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


class Cell:
    """The homes of one cell (or of one block of it), sorted by the group's first projection."""

    def __init__(self, key: bytes, node: np.ndarray, copies: np.ndarray, raw: list[bytes], levels: int, cosine: float, kind: str):
        self.group, self.dim = int(np.frombuffer(key[:2], "<i2")[0]), int(np.frombuffer(key[2:6], "<i4")[0])
        self.levels, self.cosine, self.kind = levels, cosine, kind
        self.directions, self.h = projections(self.dim, levels, cosine)
        unit, on = self._read(raw)
        order = np.argsort(on[:, self.group * levels], kind="stable")
        self.node, self.copies, self.unit, self.on = node[order], copies[order], unit[order], on[order]

    def _read(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        unit = units(np.frombuffer(b"".join(raw), self.kind).reshape(len(raw), self.dim))
        return unit, unit @ self.directions.T

    def ask(self, node: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of each asking vector, and the linked pairs (asking node, home node) as a forest."""
        unit, on = self._read(raw)
        first = self.group * self.levels
        low = np.searchsorted(self.on[:, first], on[:, first] - self.h, "left")
        high = np.searchsorted(self.on[:, first], on[:, first] + self.h, "right")
        upto = np.cumsum(high - low)
        links = np.zeros(len(node), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(node):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
            n = (high - low)[at:stop]
            q = np.repeat(np.arange(at, stop), n)
            x = np.repeat(low[at:stop] - np.cumsum(n) + n, n) + np.arange(len(q))
            near = node[q] != self.node[x]
            for k in range(first + 1, first + self.levels):
                near &= np.abs(on[q, k] - self.on[x, k]) <= self.h
            q, x = q[near], x[near]
            for part in range(0, len(q), _PAIRS):
                self._verify(q[part:part + _PAIRS], x[part:part + _PAIRS], unit, on, node, links, found)
            at = stop
        if not found:
            return links, np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return links, a, b

    def _verify(self, q, x, unit, on, node, links, found) -> None:
        met = np.abs(on[q] - self.on[x]) <= self.h
        passed = met.sum(axis=1) >= met.shape[1] - (GROUPS - 1)
        whole = met.reshape(len(q), GROUPS, self.levels).all(axis=2)
        passed &= whole.argmax(axis=1) == self.group
        q, x = q[passed], x[passed]
        linked = np.einsum("ij,ij->i", unit[q], self.unit[x]) >= self.cosine
        q, x = q[linked], x[linked]
        np.add.at(links, q, self.copies[x])
        if len(q):
            found.append(forest(node[q], self.node[x]))


def _link(levels: int, cosine: float, kind: str):
    """Rows sorted by (label, cell, block, asks) -> (a, n, null): n links of a; (a, null, b): an edge."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, cell = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "cell", "block"))))
            asks, node, copies = (batch.column(c).to_numpy() for c in ("asks", "node", "copies"))
            raw = batch.column("vector").to_pylist()
            new = np.array([k > 0 and (keys[k] != keys[k - 1] or asks[k] != asks[k - 1]) for k in range(len(keys))], bool)
            cuts = [0, *np.flatnonzero(new).tolist(), len(keys)]
            out: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    key, homes, cell = keys[a], [], None
                if not asks[a]:
                    homes.append((node[a:b], copies[a:b], raw[a:b]))
                    continue
                if not homes:
                    continue
                if cell is None:
                    cell = Cell(key[1], np.concatenate([x[0] for x in homes]), np.concatenate([x[1] for x in homes]),
                                [v for x in homes for v in x[2]], levels, cosine, kind)
                links, low, high = cell.ask(node[a:b], raw[a:b])
                some = links > 0
                for x, y in zip(out, (node[a:b][some], links[some], low, high)):
                    x.append(y)
            if out[0]:
                a, n, low, high = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.nulls(len(a), pa.int64())], ["a", "n", "b"])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.nulls(len(low), pa.int64()), pa.array(high)], ["a", "n", "b"])
    return run


def links(nodes: DataFrame, cosine: float = COSINE, block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """(a, n, b) rows from nodes (node, label, embedding, copies): n links of a, or an edge a - b."""
    kind = "<f4" if dict(nodes.dtypes)["embedding"] == "array<float>" else "<f8"
    label = nodes.schema["label"].dataType.simpleString()
    if levels is None:
        largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        levels = min(MAX_LEVELS, max(1, math.ceil(math.log2(max(1, largest / _HOMES)))))
    full = nodes.select("label", "embedding").mapInArrow(_homes(levels, cosine, kind), f"label {label}, cell binary") \
        .groupBy("label", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    full = staged(full.select("label", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "full-cells")
    rows = nodes.select("node", "label", "embedding", "copies") \
        .mapInArrow(_asked(levels, cosine, kind), f"label {label}, cell binary, asks byte, node long, copies long, vector binary")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = rows.join(full, ["label", "cell"], "left").select(
        "label", "cell", "asks", "node", "copies", "vector",
        F.explode(F.when(F.col("asks") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))).alias("block"))
    return dealt.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "asks") \
        .mapInArrow(_link(levels, cosine, kind), "a long, n long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    element = dict(vectors.dtypes)[vector_col]
    vector = F.col(vector_col) if element == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("embedding"), F.col(label_col).alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    nodes = rows.where(usable).groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    met = staged(links(nodes, cosine, block, levels), "links")
    counts = met.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(met.where("b is not null").select("a", "b"))
    rooted = staged(nodes.join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("label", "embedding", "n_links", "component_id")
    linked = rows.where(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
