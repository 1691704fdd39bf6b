"""Token IDs of whole texts with a public tokenizer file, remembering words already seen.

The tokenizer drops white space and never joins characters across it, so a text's IDs are the IDs of
its words, split at ASCII white space, in order, and a word needs encoding once. Words are split
further, by the tokenizer's own pattern, where they hold printable ASCII and Latin-1 letters only,
for which its normalisation changes nothing but case; all other words are encoded as they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlight.llm import worker
from ledgerlight.llm.arrow_text import ragged

#: Words of a generation kept per Python worker. The last two generations are known; a word that is
#: met again moves to the newer one, so frequent words stay and memory is bounded.
REMEMBERED = 250_000
# The tokenizer's split pattern for the characters admitted by _SIMPLE.
_PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9\n]+")
_SIMPLE = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves,
    the others, in order, for characters from 256 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """A bounded table: the newer of two generations, with the older one behind it."""

    def __init__(self):
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.older[word]
        return found

    def unknown(self, words: list[str]) -> list[str]:
        older = self.older
        return [w for w in words if w not in self and w not in older]

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


class WordTokens:
    """``dtype`` is the narrowest little-endian type that holds all IDs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = min((t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()), default="<|")
        self.bytes_as = _byte_characters()
        self.words, self.parts = Remembered(), Remembered()

    def whole(self, text: str) -> bytes:
        """The IDs by the tokenizer alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        """Parts are already normalised and split, so the tokenizer's merges alone are left to do."""
        merge, known, as_character = self.tokenizer.model.tokenize, self.parts, self.bytes_as
        flat, ends = [], [0]
        for part in parts:
            flat += [t.id for t in merge(part if part.isascii() else part.encode().decode("latin-1").translate(as_character))]
            ends.append(len(flat))
        width = np.dtype(self.dtype).itemsize
        data = np.array(flat, self.dtype).tobytes()
        for part, a, b in zip(parts, ends[:-1], ends[1:]):
            known[part] = data[width * a : width * b]

    def _learn(self, new: list[str]) -> None:
        """Encode words not seen before: simple ones by their parts, all unseen parts in few calls."""
        simple = [w for w in new if _SIMPLE.fullmatch(w) and self.special not in w]
        if len(simple) < len(new):
            for word in set(new).difference(simple):
                self.words[word] = self.whole(word)
        if not simple:
            return
        lower = "\n".join(simple).lower().split("\n")
        # A word of letters alone is one part; the others are split.
        single = [x.isalpha() for x in lower]
        split = [x for x, one in zip(lower, single) if not one]
        flat = _PARTS.findall("\n".join(split))
        self._learn_parts(self.parts.unknown(list({*flat, *(x for x, one in zip(lower, single) if one)} - {"\n"})))
        known = self.parts
        self.words.update((w, known[x]) for w, x, one in zip(simple, lower, single) if one)
        if not split:
            return
        held, words = [], (w for w, one in zip(simple, single) if not one)
        for part in flat:
            if part == "\n":
                self.words[next(words)] = b"".join(held)
                held = []
            else:
                held.append(known[part])
        self.words[next(words)] = b"".join(held)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All IDs of the texts, one after the other, and n + 1 offsets; a null text has none."""
        self.words.age()
        self.parts.age()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(self.words.unknown(distinct))
        found = list(map(self.words.__getitem__, distinct))
        length = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        start = np.cumsum(length) - length
        table = np.frombuffer(b"".join(found), self.dtype)
        at = coded.indices.to_numpy(zero_copy_only=False)
        times = length[at]
        flat = table[ragged(start[at], times)]
        total = np.r_[0, np.cumsum(times)]
        return flat, total[ends - ends[0]]


def loaded(path: str) -> WordTokens:
    """The tokenizer of this worker, read once."""
    known = worker.table("tokens")
    if path not in known:
        known[path] = WordTokens(path)
    return known[path]
