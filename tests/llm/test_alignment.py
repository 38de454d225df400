"""Cross-tokenizer alignment against whole-text tokenizations and plain set intersection."""

import bisect
import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailsift.llm import op12_alignment
from mailsift.llm.queries import QUERIES
from tests.llm.conftest import SF001, SF01

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
_A = Tokenizer.from_file(PATHS[0])
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def _letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {}, 0
    for b in range(256):
        if b in plain:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    return table


_LETTERS = _letters()


def _groups(text):
    """[(a ids, b ids)] of a text by its whole tokenizations."""
    if not text:
        return []
    want = (" " + text).encode()
    a = [(i, bytes(_LETTERS[c] for c in _A.id_to_token(i))) for i in _A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if _B.is_byte(i) else p.replace("▁", " ").encode()) for i in _B.encode(text) for p in [_B.id_to_piece(i)]]
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in cuts]
    for k, side in enumerate((a, b)):
        for (i, _), e in zip(side, ends[k]):
            out[bisect.bisect_left(cuts, e)][k].append(i)
    return out


def _expected(rows):
    groups = [(i, _groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in groups]
    count = Counter(pair for found in links for pair in found)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = Counter()
    for (i, g), found in zip(groups, links):
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out[i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()),
            sum(n for p, n in found.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in found.items()),
            hashlib.sha256(written.encode()).hexdigest() if g else ""] += 1
    return out


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_alignment(spark, odd, where):
    folder = odd if where == "odd" else SF001
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    got = QUERIES["op12_alignment"](spark, folder).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r) for r in got.collect()) == _expected(rows)


def test_small_chunks(spark, monkeypatch):
    """Chunks of a few documents, and groups that are all counted as products, change nothing."""
    rows = list(zip(*(pq.read_table(f"{SF001}/documents.parquet", columns=[c])[c].to_pylist()[:40] for c in ("doc_id", "text"))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = op12_alignment.align(df, *PATHS, chunk=3000)
    assert Counter(tuple(r) for r in got.collect()) == _expected(rows)
    units = [u for _, t in rows for u in _ALIGNER.split(t or "")]
    listed = _ALIGNER.align(units)
    monkeypatch.setattr(op12_alignment, "LISTED", 1)
    products = _ALIGNER.align(units)
    sums = [Counter() for _ in range(2)]
    for found, x in zip(sums, (listed, products)):
        for u, p, n in zip(x.unit.tolist(), x.pair.tolist(), x.times.tolist()):
            found[u, p] += n
    assert sums[0] == sums[1] and (products.unit[1:] >= products.unit[:-1]).all()


_ALIGNER = op12_alignment.Aligner(*PATHS)


@settings(deadline=None, max_examples=1000)
@given(st.lists(st.sampled_from(["a", "B", "é", "漢", "😀", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2009", "\u3000", "▁", "<|endoftext|>", "<s>", "<0x41>",
                                 "'s", "'", "'LL", "1", "²", "\u0301", "\u094d", "\x00", "hello", " the", "."]), max_size=14).map("".join))
def test_units_align_like_whole_texts(text):
    units = _ALIGNER.split(text) if text else []
    found = _ALIGNER.align(units)
    got = ";".join(found.groups) if found.ok.all() else ""
    assert got == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in _groups(text))


def test_ranked_ids_are_the_tokenizers_ids():
    assert _ALIGNER.ranked and _ALIGNER.a is None
    for text in pq.read_table(f"{SF01}/documents.parquet", columns=["text"])["text"].to_pylist():
        if text:
            assert _ALIGNER.ranked.encode_ordinary(text) == _A.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["z" * 50_000, "ab" * 20_000, "漢字" * 10_000, "a." * 10_000, "x\n" * 10_000, "1" * 3000 + " " * 3000 + "q"])
def test_long_units(text):
    found = _ALIGNER.align(_ALIGNER.split(text))
    assert ";".join(found.groups) == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in _groups(text))


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(61, 70))
def test_cuts_are_the_shared_ends(a, b, last):
    a, b = np.array(sorted(a | {last})), np.array(sorted(b | {last}))
    cut = op12_alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
    assert a[cut].tolist() == sorted(set(a.tolist()) & set(b.tolist()) - {last})


def test_a_task_gives_memory_back_when_its_chunks_are_out(monkeypatch):
    seen = []
    monkeypatch.setattr(op12_alignment, "_give_back", lambda: seen.append(len(rows)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3]), "text": ["one two", None, "three, four"]})
    rows = []
    for row in op12_alignment._chunks(*PATHS, 8)(iter([batch])):
        rows.append(row)
    assert seen == [len(rows)] and sum(len(r.column("doc_id")[0]) for r in rows) == 3
    assert [r.column("chunk")[0].as_py() for r in rows] == list(range(len(rows)))


def test_units_of_documents_are_no_rows_of_spark(spark):
    """The units, megabytes a chunk, are neither staged nor shuffled as rows: executors held hundreds of MB of them."""
    rows = [(1, "one two three"), (None, None), (1, "one two three"), (2, "four, five " * 40), (None, "two"), (3, "")]
    got = op12_alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *PATHS, chunk=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "pair" in plan and not any(c in plan for c in ("unit_pairs", "pair_at", "doc_units", "many_at"))
    assert Counter(tuple(r) for r in got.collect()) == _expected(rows)


def test_a_task_that_runs_again_has_files_of_its_own(tmp_path, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3]), "text": ["one two", None, "three, four"]})
    sent = []
    for attempt in (5, 6):
        task = type("Task", (), {"taskAttemptId": lambda self, k=attempt: k, "partitionId": lambda self: 0})()
        monkeypatch.setattr(op12_alignment.TaskContext, "get", classmethod(lambda cls, task=task: task))
        sent += op12_alignment._kept(op12_alignment._chunks(*PATHS, 8), str(tmp_path))(iter([batch]))
    names = [r.column("chunk")[0].as_py() for r in sent]
    assert len(set(names)) == len(sent) and sorted(map(str, names)) == sorted(f.name for f in tmp_path.iterdir())
    assert all(r.schema.names == ["chunk", "pairs", "docs"] for r in sent)
