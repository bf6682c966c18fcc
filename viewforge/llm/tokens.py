"""Token ids of texts from a public tokenizer file."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Words whose ids a worker remembers; beyond that, those which were not met since the last time are forgotten.
REMEMBERED = 200_000
#: Characters of text after which a worker looks how many words it remembers.
BATCH_CHARS = 200_000


#: A run of ASCII signs between blanks, ASCII letters or digits. Beside an apostrophe or anything beyond ASCII the
#: vocabulary's own rules reach across, so such a run stays with its word.
_SIGNS = rb"[\x00-\x08\x0e-\x1f!-&(-/:-@\[-`{-\x7f]"
#: The pattern begins with its own signs, because such a search skips letters several times as fast.
_RUN = re.compile(rb"(" + _SIGNS + rb"(?<![\x00-\x08\x0e-\x1f!-/:-@\[-`{-\xff]" + _SIGNS + rb")" + _SIGNS + rb"*+)(?!['\x80-\xff])")
#: Words that such a vocabulary takes as one unit.
_UNIT = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+")
#: Words on which a vocabulary shows that its model gives the ids of a unit.
_PROBES = ["a", "Zz", "tokenization", "unbelievably", "qwxzkjv", "Éléphant", "groß", "señor", "Àÿø", "!", "...", "$%&", "~_^`|"]


class _Memory(dict):
    """Ids by word; a word that is not known is taken from the words before, or else encoded."""

    def __init__(self, encode: Callable[[bytes], bytes], older: dict[bytes, bytes]) -> None:
        self.encode, self.older = encode, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class Encoder:
    """Ids of a text as little-endian unsigned integers of ``width`` bytes.

    ``by_word`` is for vocabularies that lower-case, drop white space and keep letters
    and signs apart, such as the word-end ones: texts are cut at ASCII white space and
    around runs of ASCII signs, ASCII letters are lower-cased, and each distinct word is
    encoded once: by the vocabulary's model if it is one unit and the model does so on
    some probes, else by the whole tokenizer. The ids are the same. A text that holds a
    special token is cut at white space only.
    """

    def __init__(self, path: str, by_word: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, {ord(c): self._letter(c) for c in map(chr, range(256)) if _UNIT.fullmatch(c)}
        self.direct = by_word and all(self._unit(w) == self._encoded(w) for w in _PROBES)
        self.known, self.chars = _Memory(self._word, {}), 0

    @property
    def older(self) -> dict[bytes, bytes]:
        return self.known.older

    def _packed(self, ids: Sequence[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _encoded(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letter(self, letter: str) -> str:
        """A letter or sign as the model gets it."""
        normalizer, pre_tokenizer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        plain = normalizer.normalize_str(letter) if normalizer else letter
        return "".join(part for part, _ in pre_tokenizer.pre_tokenize_str(plain)) if pre_tokenizer else plain

    def _unit(self, word: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize(word.translate(self.letters))])

    def _word(self, word: bytes) -> bytes:
        plain = word.decode()
        return self._unit(plain) if self.direct and _UNIT.fullmatch(plain) else self._encoded(plain)

    def _words(self, text: str) -> list[bytes]:
        raw = text.encode()
        lower = raw.lower()
        if any(s in lower for s in self.special):
            return raw.split()
        return _RUN.sub(rb" \1 ", lower).split()

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        if not self.by_word:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [self._packed(e.ids) for e in found]
        out = []
        for text in texts:
            out.append(b"".join(map(self.known.__getitem__, self._words(text))) if text else b"")
            self.chars += len(text or "")
            if self.chars >= BATCH_CHARS:
                self.chars = 0
                if len(self.known) > REMEMBERED:
                    self.known = _Memory(self._word, dict(self.known))
        return out


#: Rows whose texts a worker holds as Python strings at a time.
ROWS = 512


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


@cache
def encoder(path: str, by_word: bool) -> Encoder:
    """One encoder per worker process, so that its words are kept from task to task."""
    return Encoder(path, by_word)


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())

