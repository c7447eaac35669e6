"""Byte-level BPE: ranks, prefix tables, encoding and decoding of texts.

Encoding is by prefix dynamic programming. For every prefix of a byte string
there is exactly one token that ends its encoding: the token `t` such that the
encoding of the bytes before `t` ends in a token that may stand before `t`.
Storing it for each prefix makes appends exact (old entries never change) and
lets an edit recompute only entries near it.

Two tokens may stand side by side if encoding their joined bytes gives them
back; that is decided by undoing merges from the seam outwards.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import ahocorasick
import public_tokenizers
import regex

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Entries that one worker's caches hold: pieces in each of two generations, and pairs of tokens.
CACHE_PIECES, CACHE_PAIRS = 150_000, 250_000
NONE = -1


class _Pieces(dict):
    """Ids of pieces, made when first asked for; what is known is found without a call in Python.

    Two generations: when one is full it becomes the older one, and what is
    asked for again survives.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or self.make(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """The ranks of a vocabulary file and what follows from them."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.splits: dict[int, tuple[int, int]] = {}
        self.longest = max(map(len, self.ranks))
        #: Finds the tokens that end at each byte, the longest first; bytes go in as the characters of their numbers.
        self.ends = ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merge(token, rank)
                if len(parts) != 2:
                    continue  # merges never make it
                self.splits[rank] = (parts[0], parts[1])
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self.encode_piece)

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Merges by rank, lowest first and leftmost among equals; only ranks under `below`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, NONE
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether `left` and `right` stay as they are when their bytes are encoded together."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        limit, ranks, bytes_of, splits = 1 << 60, self.ranks, self.bytes_of, self.splits
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < limit:
                return False  # the seam would have been merged before what is there now
            # undo the later of the two merges that made the sides; at a tie the left one was first
            a, b = splits.get(left), splits.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def extend(self, last: list[int], text: str, start: int) -> None:
        """Adds to `last` the last token of each prefix up to the end of `text`, which has a character for each byte from byte `start` on.

        Of the tokens that end at a byte, the longest first, one may stand where it does.
        """
        size, known, fits = len(last), self.pairs, self.side_by_side
        add, start1 = last.append, start + 1
        for end, (n, token) in self.ends.iter(text):
            i = start1 + end
            if i < size:
                continue  # known, or found by a longer token
            j = i - n
            if j:
                before = last[j]
                ok = known.get(before << 20 | token)
                if not (fits(before, token) if ok is None else ok):
                    continue
            add(token)
            size += 1
        if size != start1 + len(text):
            raise ValueError("the vocabulary lacks a byte")

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the longest prefix, from its end back."""
        out, i, bytes_of = [], len(last) - 1, self.bytes_of
        while i:
            out.append(last[i])
            i -= len(bytes_of[last[i]])
        return out[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        last = [NONE]
        self.extend(last, piece if len(piece) == len(data) else data.decode("latin-1"), 0)
        return tuple(self.walk(last))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """For each prefix of `data` the token that ends its encoding."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), [NONE]
        self.append(data)

    def _extend(self, stop: int) -> None:
        start = max(0, len(self.last) - self.bpe.longest)  # a token that ends behind the known prefixes starts no earlier
        self.bpe.extend(self.last, self.data[start:stop].decode("latin-1"), start)

    def append(self, more: bytes) -> PrefixTable:
        """Old entries never change; each new prefix gets its own."""
        self.data += more
        self._extend(len(self.data))
        return self

    def splice(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes start..end; returns how many entries were computed.

        Behind the edit, entries are computed in stretches as long as the
        longest token, until one equals the old entries: from there on nothing
        differs.
        """
        old, longest = self.last[end + 1 :], self.bpe.longest
        self.data[start:end] = new
        del self.last[start + 1 :]
        self._extend(start + len(new))
        at = 0
        while at < len(old):
            stop = min(len(old), at + longest)
            self._extend(start + len(new) + stop)
            same = self.last[-(stop - at) :] == old[at:stop]
            at = stop
            if same:
                self.last += old[at:]
                break
        return len(new) + at

    def tokens(self) -> list[int]:
        return self.bpe.walk(self.last)


@lru_cache(maxsize=2)
def load(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Bpe:
    """One for each vocabulary and worker process."""
    return Bpe(path, pattern)
