"""Token ids of whole texts by a word-based BPE vocabulary file, with a cache of white-space chunks.

In such a vocabulary (normaliser: NFC, white space to blanks, lower case; split into letters, single digits and
other signs) white space always ends a token and leaves none, so the ids of a text are those of its chunks on
end. Chunks repeat heavily; each distinct one is encoded once per worker and kept as bytes of its ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

#: Entries after which a worker's cache starts anew; it bounds memory, not the result.
CACHE = 400_000
SPECIAL = re.compile("[\x1c-\x1f]")
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-ɏ]+")
#: Below U+0250 letters and numbers are these; other signs stand together.
LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")


def byte_signs() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Chunks(dict):
    """Ids of chunks; a missing one is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        known = self[chunk] = self.encode(chunk)
        return known


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.signs = byte_signs()
        self.written = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.chunks = _Chunks(self._chunk)
        self.parts = _Chunks(self._part)

    def _part(self, part: str) -> bytes:
        signs = part if part.isascii() else "".join([self.signs[b] for b in part.encode()])
        written = self.written
        return b"".join([written[t.id] for t in self.model.tokenize(signs)])

    def _slow(self, text: str) -> bytes:
        return b"".join([self.written[i] for i in self.whole.encode(text, add_special_tokens=False).ids])

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or len(chunk) > 1000:
            return self._slow(chunk)
        if chunk.isascii():
            small = chunk.lower()
            if small.isalpha():
                return self.parts[small]
            if small[:-1].isalpha() and small[-1] in ".,":
                return self.parts[small[:-1]] + self.parts[small[-1]]
            return b"".join([self.parts[p] for p in ASCII_PARTS.findall(small)]) if chunk.isprintable() else self._slow(chunk)
        if LATIN.fullmatch(chunk):
            small = chunk.lower() if unicodedata.is_normalized("NFC", chunk) else unicodedata.normalize("NFC", chunk).lower()
            if small.isalpha():
                return self.parts[small]
            if LATIN.fullmatch(small):
                return b"".join([self.parts[p] for p in LATIN_PARTS.findall(small)])
        return self._slow(chunk)

    def encode(self, text: str) -> bytes:
        if SPECIAL.search(text):
            return self._slow(text)
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        return b"".join(map(self.chunks.__getitem__, text.split()))


    def forget(self) -> None:
        """Let go of the known chunks, which may be a hundred MB, when a task is done."""
        self.chunks.clear()
        self.parts.clear()


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str | None) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file; None stands for the public word vocabulary."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
