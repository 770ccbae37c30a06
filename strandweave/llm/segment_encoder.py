"""Whole-text encoding with the `tokenizers` library at cache speed.

Byte-level BPE pre-tokenisation cuts before every space that a non-space
follows, and around every single newline between non-spaces, whatever stands
elsewhere.  So a text whose white space is only such characters falls into
segments that encode independently of each other.  Each distinct segment is
merged once by the library's model and kept as packed little-endian ids; a
document is then a join of cached bytes.  Any other text goes to the library
whole, and so does one that holds an added token's content (`<|endoftext|>`),
which the library codes as that token.
"""

from __future__ import annotations

import os

import numpy as np

CACHE_ENTRIES = 900_000
#: Longer segments are coded each time and never kept, so that the cache is bounded in bytes.
KEPT_CHARACTERS = 256
NEWLINE = "\n"
CLOSERS = frozenset(".,;:!?")


def byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Segments(dict):
    """Segment (the text after a space, or a newline and the text after it) to packed ids."""

    __slots__ = ("learn",)

    def __missing__(self, key: str) -> bytes:
        found = self.learn(key)
        if len(key) <= KEPT_CHARACTERS:
            self[key] = found
        return found


class SegmentEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids (`bytes`)."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.shown = {b: ord(c) for b, c in byte_characters().items()}
        self.segments = _Segments()
        self.segments.learn = self._learn
        self.cache_entries = cache_entries
        self.newline = self.whole(NEWLINE)

    def whole(self, text: str) -> bytes:
        got = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(got, dtype="<u4").tobytes()

    @staticmethod
    def plain(text: str) -> bool:
        """True if all white space is single spaces and newlines between non-spaces.

        The cut at any white space then gives the very parts of the cut at spaces and newlines.
        """
        return text.split() == text.replace(NEWLINE, " ").split(" ")

    def _merge(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable() and piece[0] != " "):
            piece = piece.encode().decode("latin-1").translate(self.shown)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def _learn(self, key: str) -> bytes:
        if key[0] == NEWLINE:
            return self.newline + b"".join(map(self._merge, self.pieces(key[1:])))
        if key.isalpha():
            return self._merge(" " + key)
        if key[-1] in CLOSERS and key[:-1].isalpha():
            return self.segments[key[:-1]] + self._merge(key[-1])
        return b"".join(map(self._merge, self.pieces(" " + key)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        segments, skip, out = self.segments, len(self.newline), []
        get = segments.__getitem__
        for text in texts:
            if len(segments) > self.cache_entries:
                segments.clear()
            if not text:
                out.append(b"")
            elif self.plain(text) and not any(a in text for a in self.added):
                first, *rest = text.replace(NEWLINE, " \n").split(" ")
                # No space comes first at the start of a text, as after a newline.
                out.append(get(NEWLINE + first)[skip:] + b"".join(map(get, rest)))
            else:
                out.append(self.whole(text))
        return out


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]
