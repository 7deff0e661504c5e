"""Token ids by the tokenizers library, with a bounded cache of word pieces per Python worker.

Both vocabularies cut a text at white space before any merge, so the ids of a text are those of its
chunks one after the other. A chunk of plain letters, digits and signs is cut into the vocabulary's
own pieces and merged by the tokenizer's model; every other chunk goes through the whole tokenizer.
Ids come as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
import re
import struct

import regex

from .common import worker_cache

CACHE = 700_000  # entries of each cache; a worker holds up to some 300 bytes for one
# White space by Unicode, as the vocabularies' patterns see it.
_SPACE = "\t-\r \x85\xa0  -     　"
_CHUNKS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# Where a cut before each blank or line feed could part a run of white space.
_RUNS = re.compile(f"[{_SPACE}][ \n]|\0")
_PLAIN = re.compile("[ \n]?[!-~À-ÖØ-öø-ÿ]+")
# The usual chunk: a word and at most one mark, cut the same way by both patterns.
_WORD = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.]?)")
# How the two vocabularies cut a text into pieces.
_WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """``encode(text)`` gives the ids of a whole text as bytes; ``kind`` is ``word`` or ``byte``."""

    def __init__(self, path: str, kind: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.word = kind == "word"
        self.pattern = regex.compile(_WORD_PIECES if self.word else _BYTE_PIECES)
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.cache = cache
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk):
                ids = outer._chunk(chunk)
                if len(self) >= outer.cache:
                    self.clear()
                self[chunk] = ids
                return ids

        self.chunks = Chunks()

    def _chunk(self, chunk) -> bytes:
        text = chunk.decode("utf-8", "replace") if isinstance(chunk, bytes) else chunk
        usual = _WORD.fullmatch(text)
        if usual:
            lead, word, mark = usual.groups()
            if self.word:
                word = word.lower()
            elif lead == " ":
                word = " " + word
            else:
                return b"".join(self._piece(p) for p in (lead, word, mark) if p)
            return self._piece(word) + self._piece(mark) if mark else self._piece(word)
        if not _PLAIN.fullmatch(text) or "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self._piece, self.pattern.findall(text.lower() if self.word else text)))

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            found = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.pieces) >= self.cache:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if self.word:  # this vocabulary drops white space, so a cut at ASCII spaces is enough
            return b"".join(map(self.chunks.__getitem__, text.split()))
        whole = text.decode("utf-8", "replace")
        if _RUNS.search(whole):
            chunks = _CHUNKS.findall(whole)
        else:
            chunks = whole.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return b"".join(map(self.chunks.__getitem__, chunks))


def encoder(path: str, kind: str, cache: int = CACHE) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return worker_cache(f"encoder:{path}:{cache}", lambda: Encoder(path, kind, cache))
