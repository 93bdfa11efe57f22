"""Encoding many short pieces with BPE models of the `tokenizers` library.

The library's own model encodes each distinct piece; what surrounds the model (white space, case, the split into pieces
and the byte alphabet) is done here for printable ASCII and the letters of Latin-1 and Latin Extended-A, where it is
plain, and left to the library's whole tokenizer for anything else. Workers keep what they have encoded from task to
task, up to a number of pieces."""

from __future__ import annotations

import functools
import re

from tokenizers import Tokenizer

#: Words (or cuts between spaces) and pieces of them that a worker remembers: some 100 MB together.
MEMO, CORES = 300_000, 200_000
#: Letters that need no normalising and whose lower case is one letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ".replace("į", "į").replace("ı", "ı")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_alphabet() -> dict[int, int]:
    """Byte-level BPE writes each byte as a character: visible ones as themselves, the rest as 256, 257, ... in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()


def written(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_ALPHABET)


class WordIds(dict):
    """word -> ids as little-endian 32-bit bytes, for a tokenizer that lower-cases and drops white space."""

    plain = re.compile(f"[!-~{LETTERS}]+").fullmatch
    split = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+").findall

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cores = self.tokenizer.model, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if self.plain(word) and "<|" not in word:
            ids = b"".join([self.cores.get(c) or self.core(c) for c in self.split(word.lower())])
        else:
            ids = packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def core(self, piece: str) -> bytes:
        if len(self.cores) > CORES:
            self.cores.clear()
        ids = self.cores[piece] = packed([t.id for t in self.model.tokenize(written(piece))])
        return ids


class PieceCounts(dict):
    """piece -> number of ids of `lead` and the piece, for a byte-level tokenizer that changes no character."""

    plain = re.compile(f" ?[!-~{LETTERS}]+(?:\n[!-~{LETTERS}]+)*").fullmatch
    split = re.compile(f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^ \n{LETTERS}0-9]+|\n").findall

    def __init__(self, path: str, lead: str = " "):
        super().__init__()
        self.tokenizer, self.lead = Tokenizer.from_file(path), lead
        self.model, self.cores = self.tokenizer.model, {}

    def __missing__(self, key: str) -> int:
        if len(self) > MEMO:
            self.clear()
        piece = self.lead + key
        if self.plain(piece) and "<|" not in piece:
            n = sum([self.cores.get(c) or self.core(c) for c in self.split(piece)])
        else:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        self[key] = n
        return n

    def core(self, piece: str) -> int:
        if len(self.cores) > CORES:
            self.cores.clear()
        n = self.cores[piece] = len(self.model.tokenize(written(piece)))
        return n


def packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """This worker's memo."""
    return WordIds(path)


@functools.lru_cache(maxsize=2)
def piece_counts(path: str) -> tuple[PieceCounts, PieceCounts]:
    """This worker's memos of pieces at a text's start and after a space."""
    return PieceCounts(path, ""), PieceCounts(path)
