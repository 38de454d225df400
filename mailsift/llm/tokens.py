"""Token ids of whole texts by the ``tokenizers`` library, with a cache of space-separated units.

A byte-level BPE tokenizer splits a text at white space before it merges bytes: ``" word,"`` is
encoded alike wherever it stands. A text is therefore cut into such units, each unit is encoded
by the library when it is first met, and the ids of a text are the joined ids of its units. The
cut is the tokenizer's own rule for white space: one space goes with the word after it, other
white space stands alone. A word of Latin letters with marks after it is cut before the marks too, where the tokenizer's rule
always cuts, so a word is kept once whatever follows it. Before that, the tokenizer takes its added tokens out of the text and looks
at what lies between them as texts of their own; so does this. ``\\x1c``-``\\x1f`` are white space for
Python but not for the tokenizer, so texts that hold them are encoded whole, as are all texts that
hold an added token with rules of its own (stripping, single words, normalised text).

``encode_all`` encodes the texts of an Arrow batch at once: they are split at single spaces between words, every
different chunk of the batch is looked up once, and the ids are gathered by chunk number. A text that this cut does
not fit (white space beside a space, an added token, ``\\x1c``-``\\x1f``, more than 4 MB) is encoded by itself as above.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

END_ID = 0
_LATIN = r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: Letters up to their end or to marks, two pieces for the tokenizer's rule; else all up to white space.
_UNIT = re.compile(_LATIN + r"(?=[.,:;!?|*#%&$\s]|\Z)| ?\S+|\s+(?!\S)|\s")
_ODD = re.compile("[\x1c-\x1f]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPAN = 1 << 20
_LONG = 4 << 20
_WORD = re.compile(_LATIN)
_ENCODERS: dict[tuple[str, int], TextEncoder] = {}


def _byte_letters() -> dict[int, int]:
    """Byte -> code point of a byte-level vocabulary: printable Latin-1 stands for itself, the
    other bytes take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class UnitIds(dict):
    """Unit -> its ids as little-endian uint32 bytes; a missing unit is encoded and kept."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, unit: str) -> bytes:
        if _WORD.fullmatch(unit):
            letters = unit.encode().decode("latin-1").translate(_LETTERS)
            out = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        else:
            out = array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        if len(unit) <= 64:
            self[unit] = out
        return out


class TextEncoder:
    """Encodes texts to little-endian uint32 ids. ``cache_units`` bounds the units kept."""

    def __init__(self, path: str, cache_units: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.units = UnitIds(self.tokenizer)
        self.cache_units = cache_units
        self.joined: dict[str, bytes] = {}
        added = sorted(self.tokenizer.get_added_tokens_decoder().items(), key=lambda x: -len(x[1].content))
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized and self.tokenizer.normalizer for _, t in added)
        self.at_added = re.compile("(" + "|".join(re.escape(t.content) for _, t in added) + ")")

    def _spans(self, text: str) -> Iterator[str]:
        """Pieces of a long text, cut before a space between two words."""
        first = 0
        while len(text) - first > _SPAN and (cut := _CUT.search(text, first + _SPAN)):
            yield text[first:cut.start()]
            first = cut.start()
        yield text[first:] if first else text

    def encode(self, text: str) -> bytes:
        """Ids of one text, without an end id."""
        if any(t in text for t in self.added):
            if self.plain and not _ODD.search(text):
                return b"".join([self.added[x] if k % 2 else self._between(x) for k, x in enumerate(self.at_added.split(text))])
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        if _ODD.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for span in self._spans(text):
            if len(self.units) > self.cache_units:
                self.units.clear()
            out.append(b"".join(map(self.units.__getitem__, _UNIT.findall(span))))
        return out[0] if len(out) == 1 else b"".join(out)

    def _ids(self, chunk: str) -> bytes:
        """Ids of a space and a word with its marks."""
        found = _UNIT.findall(chunk)
        if len(found) == 1:
            return self.units[found[0]]
        out = b"".join(map(self.units.__getitem__, found))
        if len(chunk) <= 64:
            if len(self.joined) >= self.cache_units // 4:
                self.joined.clear()
            self.joined[chunk] = out
        return out

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, without an end id; null is empty."""
        if len(self.units) > self.cache_units:
            self.units.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        alone = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        for token in self.added:
            alone = pc.or_(alone, pc.match_substring(texts, token))
        alone = pc.or_(alone, pc.greater(pc.binary_length(texts), _LONG))
        lists = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        alone = alone.to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(lists).to_numpy()
        coded = pc.dictionary_encode(lists.flatten())
        code = coded.indices.to_numpy().astype(np.int64)
        # no chunk has a space, so one text of all of them is split again: far quicker than Arrow's to_pylist
        every = pa.LargeListArray.from_arrays(pa.array([0, len(coded.dictionary)]), coded.dictionary)
        chunks = pc.binary_join(every.cast(pa.list_(pa.large_string())), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        units, joined = self.units, self.joined
        table = [(units.get(" " + c) or joined.get(" " + c)) if c and not c.isspace() else None for c in chunks]
        odd = np.zeros(len(table), bool)
        for k in [k for k, ids in enumerate(table) if ids is None]:
            c = chunks[k]
            odd[k] = not c or c[0].isspace() or c[-1].isspace()
            table[k] = b"" if odd[k] else self._ids(" " + c)
        begins = np.searchsorted(row, np.arange(len(texts)))
        first = [chunks[k] for k in code[begins].tolist()]
        # the first chunk of a text has no space before it
        code[begins] = len(table) + np.arange(len(texts))
        table += [b"" if not c else b"".join(map(units.__getitem__, _UNIT.findall(c))) for c in first]
        odd = np.concatenate((odd, [c[-1:].isspace() for c in first])).astype(bool)
        alone |= np.bincount(row, odd[code], len(texts)) > 0
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        ids, starts = np.frombuffer(b"".join(table), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[code]
        ends = np.cumsum(n)
        ids = ids[np.repeat(starts[code] - (ends - n), n) + np.arange(n.sum())].tobytes()
        bounds = [0, *np.cumsum(np.bincount(row, 4 * n, len(texts)).astype(np.int64)).tolist()]
        return [self.encode(texts[k].as_py()) if alone[k] else ids[bounds[k]:bounds[k + 1]] for k in range(len(texts))]


def encoder(path: str, cache_units: int = 1_000_000) -> TextEncoder:
    """This process's encoder for a tokenizer file and a bound of units, loaded once."""
    if (path, cache_units) not in _ENCODERS:
        _ENCODERS[path, cache_units] = TextEncoder(path, cache_units)
    return _ENCODERS[path, cache_units]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
