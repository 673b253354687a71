"""Byte-pair merging of many pieces at once, on arrays, with the merges of a public vocabulary file."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np

TOKENIZERS = os.environ.get("INKSPARK_TOKENIZERS", "/opt/tokenizers")
NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Merges:
    """Sorted pair keys (left << 16 | right) with rank and new id, the id of each byte, and the bytes of each id."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    byte_ids: np.ndarray
    pieces: list[bytes]


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Merges:
    """Read folder/name.json. Its size (some 50,000 merges) bounds what is broadcast."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], _byte_characters()
    if max(vocab.values()) >= 1 << 16:
        raise ValueError(f"{name} has ids above {(1 << 16) - 1}, and pairs are packed in 32 bits")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys)
    byte_ids = np.zeros(256, np.int32)
    for c, b in letters.items():
        byte_ids[b] = vocab[c]
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return Merges(keys[order], order.astype(np.int32), made[order], byte_ids, pieces)


def encode(data: np.ndarray, offsets: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces given as bytes with offsets; returns flat ids and their offsets.

    Each round joins the adjacent pairs of every piece with the merge ranks and applies the lowest of
    each piece, until no piece has a pair left to merge. Pieces that are done leave the working arrays.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    symbols = merges.byte_ids[data[offsets[0] : offsets[-1]]]
    owner = np.repeat(np.arange(n), lengths)
    done_symbols, done_owner = [], []
    while len(symbols):
        key = symbols[:-1].astype(np.uint32) << np.uint32(16) | symbols[1:].astype(np.uint32)
        at = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
        known = (merges.keys[at] == key) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(known, merges.ranks[at], NONE), NONE)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(owner)))
        lowest = np.minimum.reduceat(rank, starts)
        active = np.repeat(lowest != NONE, sizes)
        if not active.all():
            done_symbols.append(symbols[~active])
            done_owner.append(owner[~active])
        if not active.any():
            break
        hit = (rank == np.repeat(lowest, sizes)) & active
        # In a run such as a a a, pairs overlap: every second one counts, from the left.
        where = np.flatnonzero(hit)
        follows = np.append(False, np.diff(where) == 1)
        run = np.arange(len(where)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(where))))
        where = where[run % 2 == 0]
        symbols = symbols.copy()
        symbols[where] = merges.made[at[where]]
        keep = active
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    owner = np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=n)
    return np.concatenate(done_symbols)[order].astype(np.int32), np.append(0, np.cumsum(counts))
