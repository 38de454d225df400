"""Vector codes and embedding near-duplicates against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailsift.llm import op11_codes, op13_embeddings
from mailsift.llm.queries import QUERIES
from tests.llm.conftest import SF001


def _rows(folder):
    t = pq.read_table(f"{folder}/embeddings.parquet", columns=["vec_id", "embedding", "label"])
    return list(zip(*(t[c].to_pylist() for c in ("vec_id", "embedding", "label"))))


def _finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _codes(rows):
    """Codes by the contract's words, with every distance worked out in Python integers."""
    kept = sorted((r for r in rows if _finite(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    limit = math.isqrt((2**63 - 1) // max(1, dim)) // 2
    whole = [[max(-limit, min(limit, math.floor(1024 * max(-limit, min(limit, x))))) for x in v] for _, v, _ in kept]
    cut = [dim * k // 4 for k in range(5)]
    parts = [[w[a:b] for w in whole] for a, b in zip(cut, cut[1:])]
    books = [[list(x) for x in p[:256]] for p in parts]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), i) for i, e in enumerate(book))

    for _ in range(4):
        for book, part in zip(books, parts):
            of = {}
            for x in part:
                of.setdefault(nearest(book, x)[1], []).append(x)
            for i, xs in of.items():
                book[i] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(b, x) for b, x in zip(books, xs)] for xs in zip(*parts)]
    errors = Counter()
    for (_, _, label), f in zip(kept, found):
        errors[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, bytes(k for _, k in f).hex(), sum(d for d, _ in f), errors[label], digest) for (i, _, label), f in zip(kept, found))


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_codes(spark, odd, where):
    folder = odd if where == "odd" else SF001
    rows = QUERIES["op11_codes"](spark, folder)
    got = Counter(tuple(r) for r in rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == _codes(_rows(folder))


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 256), st.integers(1, 20), st.integers(1, 2000), st.integers(0, 2**32))
def test_masks_find_the_nearest(n, width, spread, seed):
    dice = np.random.default_rng(seed)
    book = op11_codes.Codebook(dice.integers(-spread, spread, (n, width)))
    parts = np.concatenate([dice.integers(-2 * spread, 2 * spread, (50, width)), book.entries])
    code, error = book.nearest(parts)
    apart = ((parts[:, None] - book.entries[None]) ** 2).sum(axis=2)
    assert (code == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
    some = np.full(len(parts), spread * spread // 4)
    query, entry = book.candidates(parts, some)
    radius = math.ceil(math.sqrt(spread * spread // 4) * (1 + 1e-12))
    box = (np.abs(parts[:, None] - book.entries[None]) <= radius).all(axis=2)
    assert sorted(zip(query, entry)) == sorted(zip(*np.nonzero(box)))


def _linked(rows, cosine=0.98):
    """(links, component) of each row by comparing all pairs."""
    def unit(v, label):
        if label is None or not _finite(v) or not any(v):
            return None
        x = np.array(v, np.float64)
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(v, label) for _, v, label in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and len(x) == len(y) and rows[i][2] == rows[j][2] and x @ y >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], n[i], least.get(find(i)), r[0] is not None and r[0] == least.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_embedding_near_duplicates(spark, odd, where):
    folder = odd if where == "odd" else SF001
    assert Counter(tuple(r) for r in QUERIES["op13_embeddings"](spark, folder).collect()) == _linked(_rows(folder))


@pytest.mark.parametrize("dim,levels,block", [(2, 1, 4096), (3, 3, 20), (16, 2, 4096), (40, 4, 30), (64, 3, 4096)])
def test_links_at_the_limit(spark, dim, levels, block):
    """Clusters, chains of pairs right at the limit, copies; small blocks split the dense cells."""
    dice = np.random.default_rng(dim)
    vectors = []
    for _ in range(6):
        x = dice.standard_normal(dim)
        for _ in range(25):  # each step turns by 0.97 to 1.03 of the limit
            vectors.append(x)
            y = dice.standard_normal(dim)
            y -= x * (x @ y) / (x @ x)
            turn = math.acos(0.98) * dice.uniform(0.97, 1.03)
            x = math.cos(turn) * x + math.sin(turn) * y * np.linalg.norm(x) / max(1e-12, np.linalg.norm(y))
    center = dice.standard_normal(dim)
    vectors += [center * (1 + k) + dice.standard_normal(dim) * 0.01 for k in range(60)] + [vectors[3]] * 5
    rows = [(k, v.tolist(), k % 2 if k < 60 else 1) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = Counter(tuple(r) for r in op13_embeddings.near_duplicates(df, block=block, levels=levels).collect())
    assert got == _linked(rows)


@pytest.mark.parametrize("dim", [1, 2, 8, 64])
def test_window_keeps_pairs_at_the_limit(dim):
    """Fresh random pairs at the limit, not those that the window was calibrated on."""
    directions, h = op13_embeddings.projections(dim, 3, 0.98)
    apart = np.random.default_rng(99).standard_normal((20_000, dim))
    apart *= math.sqrt(0.04) / np.linalg.norm(apart, axis=1, keepdims=True)
    missed = (np.abs(apart @ directions.T) > h).sum(axis=1)
    assert (missed >= op13_embeddings.GROUPS).mean() <= 2e-4
