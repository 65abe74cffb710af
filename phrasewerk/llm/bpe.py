"""Exact byte-level BPE encoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token with which its encoding ends. An automaton over the
vocabulary gives the tokens that end at a position, longest first; the first whose left neighbour (the last token
of the prefix before it) may stand beside it is that unique last token. Back-pointers then spell out the ids.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import regex

#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to this length are kept in a worker's table; the table holds at most so many.
CACHED_LENGTH, CACHED_PIECES = 40, 200_000


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes text with the vocabulary and merges of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(letters[c] for c in token).decode("latin-1")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        byte_ids = {t: i for t, i in ids.items() if len(t) == 1}
        self.split: dict[int, tuple[int, int]] = {}  # the pair whose merge makes a token
        self.rank: dict[int, int] = dict.fromkeys(byte_ids.values(), -1)
        self.merged: dict[tuple[int, int], int] = {}  # pair -> rank of its merge
        made = {raw(t): i for t, i in byte_ids.items()}
        for rank, (a, b) in enumerate(merges):
            if a + b in ids and a in ids and b in ids:
                pair, whole = (ids[a], ids[b]), ids[a + b]
                self.merged.setdefault(pair, rank)
                if whole not in self.rank:
                    self.split[whole], self.rank[whole] = pair, rank
                    made[raw(a + b)] = whole
        self.ids_of = {t: i for t, i in made.items() if t}
        self.beside: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        for text, token in self.ids_of.items():
            if self._reachable(token):
                automaton.add_word(text, (len(text), token))
        automaton.make_automaton()
        self.automaton = automaton
        self.kept: dict[str, list[int]] = {}
        self.pieces = regex.compile(PIECES)

    def _reachable(self, token: int) -> bool:
        """A token can end an encoding only if its own halves may not be merged otherwise."""
        return token not in self.split or self._compatible(*self.split[token], below=self.rank[token])

    def _compatible(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """True if no merge across the border of *left* and *right*, of a rank under *below*, comes before the merges inside them.

        Undoes the merges on both sides from the latest to the earliest; at each state the pair at the border must not
        have a merge that would have come first.
        """
        key = (left, right)
        if below == 1 << 60 and key in self.beside:
            return self.beside[key]
        limit, good = below, True
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                good = False
                break
            rank_left, rank_right = self.rank[left], self.rank[right]
            if rank_left < 0 and rank_right < 0:
                break
            if rank_left > rank_right:  # the later merge is undone first; equal ranks merge from the left
                limit, left = rank_left, self.split[left][1]
            else:
                limit, right = rank_right + 1, self.split[right][0]
        if below == 1 << 60 and len(self.beside) < 2_000_000:
            self.beside[key] = good
        return good

    def piece(self, text: str) -> list[int]:
        """The ids of one piece, given as latin-1 text of its UTF-8 bytes."""
        whole = self.ids_of.get(text)
        if whole is not None and self._reachable(whole):
            return [whole]
        n, compatible = len(text), self._compatible
        lengths, tokens = [0] * n, [-1] * n  # of the one token with which each prefix's encoding ends
        for end, (length, token) in self.automaton.iter(text):
            if tokens[end] < 0:
                before = end - length
                if before < 0 or (tokens[before] >= 0 and compatible(tokens[before], token)):
                    lengths[end], tokens[end] = length, token
        ids, at = [], n - 1
        while at >= 0:
            if tokens[at] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(tokens[at])
            at -= lengths[at]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of *text*; an empty list for an empty or null text. A lone surrogate counts as U+FFFD."""
        if not text:
            return []
        ids: list[int] = []
        kept = self.kept
        for piece in self.pieces.findall(text):
            found = kept.get(piece)
            if found is None:
                found = self.piece(piece.encode("utf-8", "replace").decode("latin-1"))
                if len(piece) <= CACHED_LENGTH:
                    if len(kept) >= CACHED_PIECES:
                        kept.clear()
                    kept[piece] = found
            ids += found
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of *path*, one per Python worker."""
    return Encoder(path)
