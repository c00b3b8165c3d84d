"""Token ids of a BPE vocabulary with word ends, one lookup per white-space-delimited chunk.

White space is dropped by the vocabulary's own pre-tokenizer, so ids of a text are the ids of its chunks in order.
A chunk's ids are computed by the tokenizers library once per process and then looked up.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import regex

from rosterline.llm.common import process_object

#: Chunks kept per process; beyond them a chunk is encoded each time.
CACHE = 150_000
#: The pre-tokenizer's pattern (fixed value of the vocabulary).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Chunks whose normal form is known to be NFC and lower case; all others go through the library whole.
PLAIN = re.compile("[!-~¡-ÿ]+")
#: Marks that often end a chunk.
MARKS = frozenset(".,;:!?")
#: str.split() takes these for white space, the vocabulary doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable bytes stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Chunks(dict):
    """Chunk to little-endian uint32 ids; missing ones are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces = self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, piece: str) -> bytes:
        ids = self.words.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = array("I", [t.id for t in self.pieces(shown)]).tobytes()
            if len(self.words) < CACHE:
                self.words[piece] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        # Letters of a kind that is in normal form anyway, perhaps with a mark at the end, are one word and the mark.
        letters = chunk[:-1] if chunk[-1] in MARKS else chunk
        if len(chunk) <= 1000 and letters.isalpha() and (letters.isascii() or PLAIN.fullmatch(letters)):
            ids = self.word(letters.lower())
            if len(letters) < len(chunk):
                ids += self.word(chunk[-1])
        elif len(chunk) > 1000 or "<|" in chunk or not PLAIN.fullmatch(chunk):
            ids = self.whole(chunk)
        else:
            ids = b"".join(map(self.word, PIECES.findall(unicodedata.normalize("NFC", chunk).lower())))
        if len(self) < CACHE and len(chunk) <= 100:
            self[chunk] = ids
        return ids


def encoder(path: str) -> Callable[[str | None], np.ndarray]:
    """A function from text (None: empty) to the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives."""
    chunks = process_object(f"wordbpe {path}", lambda: Chunks(path), grows=True)

    def ids(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        data = chunks.whole(text) if SEPARATORS.search(text) else b"".join(map(chunks.__getitem__, text.split()))
        return np.frombuffer(data, "<u4")

    return ids


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
