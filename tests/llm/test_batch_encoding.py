"""Texts encoded a batch at a time: the tokenizer's ids, each different word of a batch looked up once."""

import numpy as np
import pyarrow as pa
import pytest

from mailsift.llm import op3_packing
from mailsift.llm.tokens import TextEncoder, UnitIds, default_path

_SNIPS = [" ", " ", " ", "  ", "\n", " \n", "a", "word", "Été", "x,", "!!", "\t", "\x1d", "　", "\xa0", "\x85", "中文", "<|endoftext|>", "12", "don't", "😀", "ß"]


@pytest.mark.parametrize("kept", [5, 1_000_000])
def test_a_batch_has_the_tokenizers_ids(kept):
    dice, enc = np.random.default_rng(4), TextEncoder(default_path(), kept)
    texts = ["", " ", "a ", " a"] + ["".join(_SNIPS[k] for k in dice.integers(0, len(_SNIPS), n)) for n in dice.integers(0, 14, 20_000)]
    for k in range(0, len(texts), 777):
        want = enc.tokenizer.encode_batch(texts[k:k + 777], add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_all(pa.array(texts[k:k + 777]))] == [e.ids for e in want]
    assert enc.encode_all(pa.array([], pa.string())) == []
    assert enc.encode_all(pa.array([None, "a"], pa.string())) == [b"", enc.encode("a")]


class Counted(UnitIds):
    looked_up = 0

    def __getitem__(self, unit):
        self.looked_up += 1
        return super().__getitem__(unit)

    def get(self, unit):
        self.looked_up += 1
        return super().get(unit)


def test_pieces_look_up_each_word_of_a_batch_once(spark, monkeypatch):
    enc = TextEncoder(default_path())
    enc.units = Counted(enc.tokenizer)
    text = " ".join(["the", "same", "words,"] * 2000)
    batch = pa.record_batch({"doc_id": [1, 2], "text": [text, text]})
    made = []
    monkeypatch.setattr(op3_packing, "encoder", lambda path: enc)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: made.extend(run(iter([batch]))))
    op3_packing.cut_pieces(docs, "")
    assert enc.units.looked_up < 100
    assert sum(sum(b.column("length").to_pylist()) for b in made) == 2 * (len(TextEncoder(default_path()).encode(text)) // 4 + 1)
