"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one last token that its encoding can end with. An
automaton over the vocabulary gives, for each end position, all tokens that are a suffix of the
prefix there. Such a token t is the last one if it starts the piece, or if the unique last token of
the prefix before it is compatible with t: merging the bytes of both tokens together keeps exactly
this pair. Last tokens are stored per prefix, and following them back from the end gives the ids.

A piece of n bytes takes time in proportion to its matches, however long it is. Pieces repeat, so
short ones are remembered by the worker that meets them.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.llm.arrowgroups import lists

TOKENIZERS = "/opt/tokenizers"
#: Pieces longer than this are not remembered, and so many at most are.
REMEMBER_CHARS = 48
REMEMBER = 400_000
#: How text splits into pieces before any merge: the fixed pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies, as sign -> byte.

    Printable Latin-1 signs stand for themselves; the other bytes follow in order from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBPE:
    """A vocabulary in merge order: ids rise with the rank of the merge that makes a token."""

    def __init__(self, tokens: dict[bytes, int], halves: dict[int, tuple[int, int]]) -> None:
        """``halves``: for each token that a merge makes, the two tokens it is made of."""
        self.tokens = {t.decode("latin-1"): i for t, i in tokens.items()}
        self.halves = halves
        self.made = {ab: i for i, ab in halves.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN)

    def compatible(self, left: int, right: int) -> bool:
        """Would the bytes of both tokens, merged together, end up as exactly these two?

        Undo the merges next to the border, latest first. Whenever the tokens that then meet at the
        border could merge earlier than the merge just undone, that merge would have come first.
        """
        seen = self.fits.get((left, right))
        if seen is not None:
            return seen
        a, b, before, good = left, right, 1 << 60, True
        while True:
            met = self.made.get((a, b))
            if met is not None and met < before:
                good = False
                break
            # Undo the later of both tokens' merges; of one and the same token, first the right one's.
            ha, hb = self.halves.get(a), self.halves.get(b)
            if ha is None and hb is None:
                break
            if hb is None or (ha is not None and a > b):
                # A merge on the left takes precedence over an equal one further right.
                a, before = ha[1], a
            else:
                b, before = hb[0], b + 1
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[(left, right)] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as bytes in Latin-1."""
        whole = self.tokens.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = [-1] * (len(piece) + 1)
        size: list[int] = [0] * (len(piece) + 1)
        for end, (token, length) in self.automaton.iter(piece):
            upto = end + 1
            if last[upto] >= 0:
                continue
            start = upto - length
            if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                last[upto], size[upto] = token, length
        out, at = [], len(piece)
        while at > 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty give an empty list."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for p in self.split.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.encode_piece(p.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(p) <= REMEMBER_CHARS:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


def from_json(path: str) -> PrefixBPE:
    """A byte-level vocabulary with its merges, as the tokenizers library stores it."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    signs = byte_signs()
    ids = {t: i for t, i in model["vocab"].items() if all(c in signs for c in t)}
    halves = {}
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        halves[ids[a + b]] = (ids[a], ids[b])
    tokens = {bytes(signs[c] for c in t): i for t, i in ids.items() if i in halves or len(t) == 1}
    return PrefixBPE(tokens, halves)


def from_ranks(path: str) -> PrefixBPE:
    """A byte-level vocabulary as base64 token and rank per line; halves are found by merging below each rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    halves = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            halves[rank] = (ranks[parts[0]], ranks[parts[1]])
    return PrefixBPE(ranks, halves)


_LOADED: dict[str, PrefixBPE] = {}


def vocabulary(name: str, folder: str = TOKENIZERS) -> PrefixBPE:
    """The encoder of a byte-level tokenizer, loaded once per worker."""
    key = f"{folder}/{name}"
    if key not in _LOADED:
        _LOADED[key] = from_json(f"{key}.json") if name == "byte_bpe_50k" else from_ranks(f"{key}.tiktoken")
    return _LOADED[key]


def id_lists(texts: Iterable[str | None], name: str, folder: str = TOKENIZERS) -> pa.ListArray:
    enc = vocabulary(name, folder)
    rows = [enc.encode(t) for t in texts]
    lengths = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    values = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(lengths.sum()))
    return lists(values, lengths, pa.int32())


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Column of ids of each text. A null or empty text gives an empty list, never null.

    Text that looks like a special token is plain text. Texts are encoded whole, of any length.
    """
    @F.arrow_udf("array<int>")
    def encode(v: pa.Array) -> pa.Array:
        return id_lists(v.to_pylist(), name, folder)

    return encode(text)
