"""Exact byte-level BPE by longest matches with backtracking, over an Aho-Corasick automaton.

A split of a piece is the one that the merges produce if and only if each two neighbouring
tokens are compatible: merging the two tokens' bytes alone gives back the two tokens. So a
piece is encoded from the left: take the longest token at the position, step down to shorter
ones while it is incompatible with its predecessor or leads to a position from which no
split goes on, and step back when none is left. Each position fails once at most, so the time
is linear in the piece. Compatibility is looked up pair by pair and remembered.

The vocabulary's bytes are mapped to the Latin-1 characters of the same numbers, on which
pyahocorasick builds the automaton that reports all tokens in a piece in one pass.

Tokens that the merges can't produce are left out of the automaton; like the public
implementations, a piece that equals a token as a whole is that token, whatever the merges.

The pattern splits with the regex library, but with tiktoken's character classes: code points that only
one of the two libraries' Unicode tables puts into a class are found once, on the driver, and
written into the pattern that splits texts with such characters (``split_as_tiktoken``).

Scale: one pass, no shuffle. A worker remembers the ids of at most MEMO_PIECES short pieces.

Defined results. A null or empty text has no ids. Any text of any length decodes to its own
UTF-8 bytes. Repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from termforge.llm.common import resident

MEMO_PIECES, MEMO_PAIRS, MEMO_CHARS = 200_000, 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _ranges(points: list[int]) -> str:
    """A regular expression's set of ascending code points."""
    starts = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends)) + "]"


@functools.lru_cache(maxsize=None)
def split_as_tiktoken(pattern: str) -> tuple[str, str, str]:
    """The pattern, the characters that are in other classes for tiktoken than for the regex library,
    and the pattern with tiktoken's classes, for texts that have any of these."""
    import regex
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    exact, odd = pattern, set()
    for name in sorted(set(regex.findall(r"\\[pP]\{\^?\w+\}|\\s", pattern))):
        # An encoding of single bytes gives back all that its pattern matches.
        found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)
        theirs, ours = set(bytes(found).decode()), set(regex.findall(name, text))
        own = name
        if ours - theirs:
            own = f"[{own}--{_ranges(sorted(map(ord, ours - theirs)))}]"
        if theirs - ours:
            own = f"[{own}||{_ranges(sorted(map(ord, theirs - ours)))}]"
        exact = exact.replace(name, own)
        odd |= ours ^ theirs
    return pattern, "".join(sorted(odd)), f"(?V1){exact}"


class ByteBpe:
    """split: of split_as_tiktoken()."""

    def __init__(self, ranks: dict[bytes, int], split: tuple[str, str, str]):
        import ahocorasick
        import regex

        plain, odd, exact = split
        self.find, self.find_exact = regex.compile(plain).findall, regex.compile(exact).findall
        self.is_odd = np.zeros(0x110000, bool)
        self.is_odd[list(map(ord, odd))] = True
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.halves: dict[int, tuple[int, int]] = {}  # of a token: the two tokens its last merge joined
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._add_merge(token, rank):
                automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        self.matches = automaton.iter
        # Next shorter token that starts the token's own bytes, or -1.
        self.shorter = [-1] * len(self.tokens)
        for token, rank in ranks.items():
            for end in range(len(token) - 1, 0, -1):
                other = ranks.get(token[:end])
                if other is not None and (end == 1 or other in self.halves):
                    self.shorter[rank] = other
                    break

    def _add_merge(self, token: bytes, rank: int) -> bool:
        """Replay the merges on a token's bytes; record its last merge if they do produce it."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            options = [(self.merged.get(pair, rank), i) for i, pair in enumerate(zip(parts, parts[1:]))]
            best, at = min(options)
            if best >= rank:
                return False
            parts[at : at + 2] = [best]
        if len(parts) != 2:
            return False
        self.halves[rank] = (parts[0], parts[1])
        self.merged[parts[0], parts[1]] = rank
        return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a boundary between the two tokens when they stand side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._boundary(left, right)
        return known

    def _boundary(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' merges, again and again. The tokens that then meet at
        # the boundary existed together from the later one's birth until `until`, the next merge
        # that was undone; a merge of the two in that time would have come first. Of two merges of
        # the same rank the left one comes first.
        l, r, until = left, right, (len(self.tokens), 0)
        while True:
            join = self.merged.get((l, r))
            if join is not None and (join, 0) < until:
                return False
            l_half, r_half = self.halves.get(l), self.halves.get(r)
            if l_half is None and r_half is None:
                return True
            if r_half is None or (l_half is not None and l > r):
                # A join of the left token's right part with r, of the same rank, would lie to the right.
                until, l = (l, 0), l_half[1]
            else:
                until, r = (r, 1), r_half[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of text."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (rank, length) in self.matches(piece.decode("latin-1")):
            longest[end - length + 1] = rank  # ends ascend, so the longest of a start comes last
        open_end = bytearray(b"\x01") * (n + 1)
        tokens, shorter, compatible = self.tokens, self.shorter, self.compatible
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(tokens[token])
                if open_end[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                open_end[at] = 0
                last = out.pop()
                at -= len(tokens[last])
                token = shorter[last]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text: each match of the pattern by itself."""
        out: list[int] = []
        memo = self.memo
        text = text or ""
        odd = not text.isascii() and self.is_odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()
        for piece in (self.find_exact if odd else self.find)(text):
            ids = memo.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode()))
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _coder(path: str, split: tuple[str, str, str]) -> ByteBpe:
    return resident(("bytebpe", path, split), lambda: ByteBpe(read_ranks(path), split))


def encode_column(path: str, pattern: str):
    """A column function: text to array of ids. path: a rank file present on every executor."""
    split = split_as_tiktoken(pattern)

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(path, split)
        for batch in texts:
            yield pd.Series([coder.encode(t if isinstance(t, str) else None) for t in batch], dtype=object)

    return encode


def decode_column(path: str, pattern: str):
    """A column function: array of ids to bytes."""
    split = split_as_tiktoken(pattern)

    @F.pandas_udf("binary")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(path, split)
        for batch in ids:
            yield pd.Series([coder.decode(x) if x is not None else b"" for x in batch], dtype=object)

    return decode


def code_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Encoding, decoding of the ids and both digests are made text by text in one Python call, so
    the ids of only one text are held at a time and no id list crosses back to the JVM.
    """
    split = split_as_tiktoken(pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(path, split)
        names = [str(i) for i in range(len(coder.tokens))]
        for batch in texts:
            rows = []
            for text in batch:
                ids = coder.encode(text if isinstance(text, str) else None)
                listed = ",".join([names[i] for i in ids])
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.col("text")).alias("c")).select("doc_id", "c.*")
