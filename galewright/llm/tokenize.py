"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Per-prefix dynamic programming. An automaton over all tokens gives, for each prefix of a piece of text, the tokens that
are its suffixes. The last token of a prefix is the only one of them that is compatible with the last token of what
stands before it; it is stored, and back-pointers from the piece's end give its ids. Two tokens are compatible if
byte-pair merging of their joined bytes keeps the border between them. A piece takes time in proportion to its length,
however its merges nest; frequent pieces are remembered per worker, up to a bound.

Tokens' ids must be in the order of their merges, as in rank files.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the public pattern that cuts text into pieces for the 50k byte-level vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered per worker; beyond it the memory starts anew.
REMEMBERED = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary file lies: ``folder``, else $TOKENIZER_DIR, else the installed package, else /opt/tokenizers."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


class PrefixEncoder:
    """Exact byte-pair encoding through the last token of every prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ids = ranks
        self.length = {i: len(b) for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[i] = (i, i)
                continue
            # Tokens get their halves in the order of merges, so all that are older can be encoded already.
            left, right = self._two(token, i)
            self.halves[i] = (left, right)
            self.merged[left, right] = i
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}

    def _two(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``: the cut whose halves are older tokens that keep their border
        until this very merge."""
        for cut in range(1, len(token)):
            left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank and self.compatible(left, right):
                return left, right
        raise ValueError(f"no merge gives token {rank}")

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two neighbouring tokens.

        Both tokens are undone, latest merge first, but only along the border. A pair of parts that touches the border
        would have merged if its merge comes before the merges that used up either part.
        """
        end = 1 << 60  # later than every merge
        used_left = used_right = end
        while True:
            rank = self.merged.get((left, right), end + 1)
            # The merge across the border comes first if it precedes the one that took the left part away, and the
            # one that took the right part away. Of equal merges the one further left comes first, which favours the border
            # over the right part only.
            if rank < used_left and rank <= used_right:
                return False
            left_older, right_older = self.halves[left][1], self.halves[right][0]
            if left_older == left and right_older == right:
                return True
            if right_older == right or (left_older != left and left > right):
                used_left, left = left, left_older
            else:
                used_right, right = right, right_older

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece of text."""
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        last: list[int] = [-1] * (len(data) + 1)
        reached: dict[int, list[tuple[int, int]]] = {}
        for end, match in self.automaton.iter(data.decode("latin-1")):
            reached.setdefault(end + 1, []).append(match)
        for end in range(1, len(data) + 1):
            for size, token in reached[end]:
                start = end - size
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                    last[end] = token
                    break
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= self.length[last[end]]
        return tuple(reversed(out))

    def encode(self, text: str, pieces) -> list[int]:
        """The ids of a text. The piece pattern is a compiled one of the regex library."""
        out: list[int] = []
        known = self.known
        for match in pieces.finditer(text):
            p = match.group()
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace"))
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out.extend(ids)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """The encoder of a rank file, built once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return PrefixEncoder(ranks)


def token_ids(text: str | Column, path: str | None = None) -> Column:
    """The ids of a text column, an array of ints without special tokens; null and empty texts give an empty array."""
    where = path or vocabulary_path()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        enc, pieces = encoder(where), regex.compile(PIECES)
        for batch in batches:
            yield pd.Series([[] if not isinstance(x, str) else enc.encode(x, pieces) for x in batch], dtype=object)

    return ids(F.col(text) if isinstance(text, str) else text)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, ids)`` of every row, also of repeated keys and null keys; further columns are left out. Texts of any
    length are encoded whole."""
    return df.select(key, token_ids(text, path).alias("ids"))
