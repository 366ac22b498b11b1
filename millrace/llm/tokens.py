"""Token ids by the tokenizers library, one call for each distinct piece of text.

Pieces are runs of text that a tokenizer file never joins across: with a byte-level splitting pattern a
piece is a run of white space with the run of other characters that follows it; where the file drops
white space it is each run of other characters. Both are cut once more between letters or digits and marks, as
both patterns keep these apart. Pieces are found and told apart (by 64-bit hashes within a chunk) over Arrow
buffers; a task encodes a piece it meets, keeps its ids while there is room, and lays out the ids of whole texts
from them. Texts with other white space than ASCII's are cut by a pattern, and files of any other make are given
whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from . import words

#: Unicode's White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Pieces that a task keeps of either generation, and the longest piece it keeps.
CACHE_PIECES, CACHE_BYTES = 100_000, 48
#: Letters of Latin-1 alone, after one blank at most: one word to the splitting patterns, so that the file's model can be asked at once.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Kinds of bytes. Marks are ASCII's but for the apostrophe, with which a word may go on.
_BLANK, _LETTER, _MARK, _OTHER = range(4)


def _byte_kinds() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        out[b] = _LETTER if chr(b).isalnum() else _MARK
    out[ord("'")] = _OTHER
    out[list(b"\t\n\x0b\x0c\r ")] = _BLANK
    return out


def _byte_signs() -> dict[int, str]:
    """The sign by which byte-level files name each byte: its own where that is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_KINDS, _SIGNS = _byte_kinds(), _byte_signs()
#: First bytes of white space beyond ASCII's.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _make(spec: dict) -> str | None:
    """Whether a file keeps white space ("kept") or drops it ("dropped"), if it splits by one of the known patterns."""
    splitter, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space") and normalizer is None:
        return "kept"
    steps = splitter.get("pretokenizers") or []
    drops = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex")
    kinds = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
    if drops and set(kinds) == {"NFC", "Replace", "Lowercase"} and r"[^\s" in json.dumps(steps[0]["pattern"]).replace("\\\\", "\\"):
        return "dropped"
    return None


def _wide_blanks(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII's stands."""
    at = np.flatnonzero(_LEADS[data])
    if not len(at):
        return at
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[two | general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)]


def spans(data: np.ndarray, ends: np.ndarray, make: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of all texts."""
    kind = _KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # Latin-1's letters beyond ASCII
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] + kind[:-1] == _LETTER + _MARK) & (kind[1:] != kind[:-1]) & (kind[1:] != _BLANK) & (kind[:-1] != _BLANK)
    blank = kind == _BLANK
    cut[1:] |= blank[1:] & ~blank[:-1]
    if make == "dropped":
        cut[1:] |= ~blank[1:] & blank[:-1]
    cut[ends[:-1][ends[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    stops = np.append(starts[1:], len(data))
    if make == "dropped":
        held = ~blank[starts]
        starts, stops = starts[held], stops[held]
    return starts, stops


class _Pieces(dict):
    """Ids of pieces as bytes, encoded when first asked for; pieces in use outlast those met once."""

    def __init__(self, ids: Callable[[bytes], bytes]):
        self.ids, self.older = ids, {}

    def __missing__(self, piece: bytes) -> bytes:
        held = self.older.get(piece) or self.ids(piece)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = held
        return held


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.make = _make(json.load(f))
        run = f"[^{WHITE}]++"
        self.pattern = re.compile(f"[{WHITE}]*+{run}|[{WHITE}]+" if self.make == "kept" else run)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.packs = [struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}") for n in range(16)]
        self.known = _Pieces(self._piece)

    def _pack(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)].pack(*ids) if len(ids) < len(self.packs) else np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: bytes) -> bytes:
        """What the whole tokenizer makes of a piece; a plain word needs none of its normalizing and splitting."""
        if _WORD.fullmatch(piece) is None:
            return self._whole(piece.decode())
        if self.make == "dropped":
            piece = piece.lstrip()
            piece = piece.lower() if piece.isascii() else piece.decode().lower().encode()
        return self._pack([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_SIGNS))])

    def _alone(self, text: str) -> bytes:
        if self.make is None:
            return self._whole(text)
        return b"".join(self.known[x.encode()] for x in self.pattern.findall(text))

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and n + 1 offsets, from 0), and n + 1 offsets of each text's among them."""
        n = len(ends) - 1
        odd = np.arange(n) if self.make is None else np.unique(np.searchsorted(ends, _wide_blanks(data), "right") - 1)
        ids, at = np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        if self.make is not None and len(data):
            starts, stops = spans(data, ends, self.make)
            _, first, same = np.unique(words.span_hashes(data, starts, stops), return_index=True, return_inverse=True)
            raw = data.tobytes()
            held = list(map(self.known.__getitem__, [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())]))
            size = np.fromiter(map(len, held), np.int64, len(held)) // self.dtype.itemsize
            many, flat = size[same], np.frombuffer(b"".join(held), self.dtype)
            to = np.concatenate([[0], np.cumsum(many)])
            ids = flat[np.arange(to[-1]) - np.repeat(to[:-1] - (np.cumsum(size) - size)[same], many)]
            at = to[np.searchsorted(starts, ends)]
        if len(odd):
            parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            for i in odd.tolist():
                parts[i] = np.frombuffer(self._alone(data[ends[i] : ends[i + 1]].tobytes().decode()), self.dtype)
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, at

    def forget(self) -> None:
        """Give back what the pieces take; tasks call it at their end, as workers live on."""
        self.known.clear()
        self.known.older = {}


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file."""
    return Encoder(path)
