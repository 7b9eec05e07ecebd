"""Token ids of whole texts by a public tokenizer, with the ids of frequent words remembered."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np

#: Remembered words of a generation in one Python worker, which keeps two: about 120 MB.
CACHE_WORDS = 300_000
_encoders: dict = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file: its memory outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Words(dict):
    """Ids by word, worked out when first asked for; a full generation gives way to the next, which takes over what is asked for again."""

    def __init__(self, find: Callable[[bytes], bytes]):
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.find(word)
        if len(self) >= CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _latin_pieces() -> re.Pattern:
    """The vocabulary's pattern of pieces for characters below U+0250 but white space and controls, which NFC leaves as they are."""
    kinds = {"L": "", "N": "", "other": ""}
    for c in map(chr, range(0x250)):
        kind = unicodedata.category(c)[0]
        if kind not in "CZ":
            kinds[kind if kind in "LN" else "other"] += re.escape(c)
    return re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[{other}]+".format(**kinds))


class Encoder:
    """`tokenizers` applied between ASCII white space, which the vocabulary drops and never joins across.

    Upper-case A-Z may be folded first, as the vocabulary folds all case. Words of Latin letters, digits and marks go
    to the model by the vocabulary's pieces. Texts that may hold a special token go through the tokenizer whole. The
    ids equal those of encoding the text at once (tests/llm).
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.known = Tokenizer.from_file(path), Words(self._word)
        self.model, self.characters, self.pieces = self.tokenizer.model, dict(enumerate(byte_characters())), _latin_pieces()
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"]
        self.special = [t["content"].encode().lower() for t in spec["added_tokens"]]

    def _tokens(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # bytes: ASCII letters alone, one piece
            return self._piece(word.decode())
        text = word.decode()
        low = text.lower()
        pieces = self.pieces.findall(low)
        if sum(map(len, pieces)) < len(low):  # other characters
            return self._tokens(text)
        if len(pieces) == 1:
            return self._piece(low)
        return b"".join([self.known[p.encode()] for p in pieces])

    def __call__(self, text: bytes | None) -> bytes:
        """The ids as little-endian unsigned 32-bit values."""
        if not text:
            return b""
        low = text.lower()
        if not self.by_word or any(s in low for s in self.special):
            return self._tokens(text.decode())
        return b"".join(map(self.known.__getitem__, low.split()))


# ---- byte-level vocabularies ------------------------------------------------------------------

#: White space and what is behind it: ASCII white space behind anything else always begins a piece of its own.
_CHUNK = re.compile(rb"\s*[^\s]+|\s+")
#: Remembered chunks in one Python worker, about 200 MB.
CACHE_CHUNKS = 1_000_000
_byte_encoders: dict = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One encoder per worker and file."""
    if path not in _byte_encoders:
        _byte_encoders[path] = ByteEncoder(path)
    return _byte_encoders[path]


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others in order from U+0100."""
    shown = {b for low, high in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(low, high + 1)}
    others = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(others)) for b in range(256)]


class ByteEncoder:
    """`tokenizers` with a byte-level vocabulary, applied to chunks of white space and a word, which are remembered.

    No piece of the vocabulary's pattern goes from other characters on into white space, so chunks are encoded on
    their own. Where a chunk ends in white space beyond ASCII, and where a text may hold a special token, the text goes
    through the tokenizer whole. The ids equal those of encoding the text at once (tests/llm).
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model, self.character = self.tokenizer.model, byte_characters()
        before = spec["pre_tokenizer"] or {}
        self.by_chunk = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"] and not spec["truncation"]
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), *(t["id"] + 1 for t in spec["added_tokens"])) <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """A chunk that is one piece: a space or none, and letters."""
        ids = [t.id for t in self.model.tokenize("".join(map(self.character.__getitem__, piece)))]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _remembered(self, chunk: bytes) -> bytes | None:
        ids = self.known.get(chunk, 0)
        if ids == 0:
            ids = self.known[chunk] = self._chunk(chunk)
        return ids

    def _chunk(self, chunk: bytes) -> bytes | None:
        """The ids of a chunk; None if what follows could join it."""
        if chunk[1:].isalpha() and (chunk[0] == 0x20 or chunk[:1].isalpha()):  # bytes: ASCII letters alone
            ids = [t.id for t in self.model.tokenize(("\u0120" if chunk[0] == 0x20 else chunk[:1].decode()) + chunk[1:].decode())]
            return struct.pack(f"<{len(ids)}{self.code}", *ids)
        text = chunk.decode()
        if not chunk[-1:].isspace() and text[-1].isspace():
            return None
        word = text[1:] if chunk[0] == 0x20 else text
        if word.isalpha() and max(word) < "\u0250":
            return self._piece(chunk)
        stem = chunk.rstrip(b".,!?;:")
        if stem and len(stem) < len(chunk) and (last := stem.decode()[-1]).isalpha() and last < "\u0250":  # letters and marks never share a piece
            return self._remembered(stem) + self._remembered(chunk[len(stem) :])
        if len(chunk) > 1 and chunk[0] == 0x0A and word[1].isalpha():  # one line end, and a word of its own behind it
            return self._remembered(chunk[:1]) + self._remembered(chunk[1:])
        return self._whole(chunk)

    def __call__(self, text: bytes | None) -> bytes:
        """The ids as little-endian values of `kind`."""
        if not text:
            return b""
        if not self.by_chunk or any(s in text for s in self.special):
            return self._whole(text)
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        get, out = self.known.get, []
        for c in _CHUNK.findall(text):
            ids = get(c, 0)
            if ids == 0:
                ids = self._remembered(c)
            if ids is None:
                return self._whole(text)
            out.append(ids)
        return b"".join(out)
