"""Token ids of whole texts with the ``tokenizers`` library, remembered per pre-token.

The tokenizer lower-cases a text and splits it before its merges; a text of ASCII and Latin letters is split here the
same way, and the library's model is asked only for pre-tokens that a worker hasn't met lately. Other texts are taken
apart at white space, which no pre-token spans, and what is left in other scripts goes to the library as it is.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Pre-tokens, and chunks in other scripts, that a worker remembers before it starts over.
WORDS, CHUNKS = 3 << 18, 1 << 17

# Latin letters that stand for themselves in normal form and whose lower case does too; ASCII but the separators that
# Python takes as white space and the tokenizer does not.
_LETTER = "a-zß-öø-įı-ſ"
_PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-įı-ſ]*")
_PRE_TOKENS = re.compile(f"[{_LETTER}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_LETTER}0-9]+")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def _byte_letters() -> list[str]:
    """The model's letter for each byte: itself if printable Latin-1, else the next letter from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Memo(dict):
    """Ids by pre-token, as packed little-endian unsigned 32-bit integers; starts over beyond a bound."""

    def __init__(self, compute, bound: int) -> None:
        super().__init__()
        self.compute, self.bound = compute, bound

    def __missing__(self, key: str) -> bytes:
        packed = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[key] = packed
        return packed


class WordIds:
    def __init__(self, tokenizer_json: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.letters = self.library.model, _byte_letters()
        self.words, self.chunks = Memo(self._pre_token, WORDS), Memo(self._chunk, CHUNKS)

    def _pre_token(self, word: str) -> bytes:
        """A single pre-token goes to the library's model directly."""
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8")])
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return self._plain(chunk)
        return np.asarray(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _PRE_TOKENS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if _PLAIN.fullmatch(text):
            return self._plain(text)
        return b"".join([self.chunks[c] for c in _SPACE.split(text) if c])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_WORKER: dict[object, WordIds] = {}


def worker_encoder(shared) -> WordIds:
    """One encoder per Python worker; ``shared`` broadcasts the tokenizer file's text, whose size is fixed."""
    if shared.id not in _WORKER:
        _WORKER.clear()
        _WORKER[shared.id] = WordIds(shared.value)
    return _WORKER[shared.id]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()
