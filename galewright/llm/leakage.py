"""Held-out evaluation texts inside a corpus (problem 8).

Each task builds an FM-index over shards of its documents: words become the ids of the test items' vocabulary, a suffix
array gives the Burrows-Wheeler transform, and a wavelet matrix answers its ranks. All phrases of all items are searched
backwards at once; occurrences are located by walking to sampled suffix positions. Hits of a document and item are
merged to spans, and a local alignment of the item against each dense span decides. The spans come out with the pair, and
those of all items merge to what has to be removed from a document. Documents never leave their
partition, so the job has no shuffle, and each shard is bounded by a number of words, not of documents.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and the Latin letters.
LOOKALIKES = str.maketrans("аеорсухкмтнвіјѕԁӏɡοανρτικεβμηυ", "aeopcyxkmthbijsdlgoavptikebmnu")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*+>")
_BREAK = re.compile(r"(?<=\w)(?:-|‐|­)[ \t]*\r?\n[ \t]*(?=\w)")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+(?:[.,]\d+)*")


def words_of(text: str) -> list[str]:
    """The words of a text without case, marks, layout, tags, accents, lookalike letters and line-break hyphens."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    text = _BREAK.sub("", _INVISIBLE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
        return _WORD.findall(text.lower().translate(LOOKALIKES))
    return _WORD.findall(text.lower())


class Vocabulary:
    """Ids from 1 for the items' words; 0 for others. Words of 4 letters and more are also known with one letter
    dropped, added, changed or two neighbours swapped, if that names one word only."""

    def __init__(self, texts: list[list[str]]):
        self.ids = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        cuts: dict[str, set[int]] = defaultdict(set)
        for w, i in self.ids.items():
            if len(w) >= 4 and w.isalpha():
                cuts[w].add(i)
                for k in range(len(w)):
                    cuts[w[:k] + w[k + 1 :]].add(i)
        self.cuts, self.words = cuts, {i: w for w, i in self.ids.items()}
        self.memory: dict[str, int] = {}

    def _near(self, word: str) -> int:
        if len(word) < 4 or not word.isalpha():
            return 0
        near = set(self.cuts.get(word, ()))
        for k in range(len(word)):
            near |= self.cuts.get(word[:k] + word[k + 1 :], set())
        near = {i for i in near if _one_edit(word, self.words[i])}
        return near.pop() if len(near) == 1 else 0

    def encode(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.int32)
        ids, memory = self.ids, self.memory
        for k, w in enumerate(words):
            i = ids.get(w)
            if i is None:
                i = memory.get(w)
                if i is None:
                    if len(memory) > 300_000:
                        memory.clear()
                    i = memory[w] = self._near(w)
            out[k] = i
        return out


def _one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s`` (ids of 0 and more) by prefix doubling from four symbols on."""
    n = len(s)
    base = int(s.max(initial=0)) + 2
    rank = s.astype(np.int64) + 1
    depth = 1
    while True:
        key = np.zeros(n, np.int64)
        key[: n - depth] = rank[depth:] if depth < n else 0
        key += rank * base
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.cumsum(np.r_[1, sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n or depth >= n:
            return order
        base, depth = n + 2, depth * 2


class FMIndex:
    """FM-index of one shard: backward search of many phrases at once, location by sampled suffix positions."""

    SAMPLE = 8

    def __init__(self, s: np.ndarray, alphabet: int):
        text = np.r_[s + 1, 0].astype(np.int64)  # 0 ends the text
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n, self.levels = len(text), max(1, int(alphabet + 1).bit_length())
        counts = np.bincount(text, minlength=alphabet + 3)
        self.first = np.r_[0, np.cumsum(counts)]
        self.ones, self.zeros = [], []
        level = bwt
        for bit in range(self.levels - 1, -1, -1):  # the wavelet matrix: one stable split per bit
            b = (level >> bit) & 1
            self.ones.append(np.r_[0, np.cumsum(b)].astype(np.int32))
            self.zeros.append(int(len(b) - b.sum()))
            level = np.r_[level[b == 0], level[b == 1]]
        self.bwt = bwt.astype(np.int32)
        self.sampled = sa % self.SAMPLE == 0
        self.sample_rank = np.r_[0, np.cumsum(self.sampled)].astype(np.int32)
        self.samples = sa[self.sampled].astype(np.int32)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol ``c`` stands in the transform before row ``i``."""
        a, z = np.zeros_like(i), i.copy()
        for k, bit in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> bit) & 1) == 1
            oa, oz = self.ones[k][a], self.ones[k][z]
            a, z = np.where(one, self.zeros[k] + oa, a - oa), np.where(one, self.zeros[k] + oz, z - oz)
        return z - a

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows (from, to) of the suffixes that begin with each phrase (one a row, ids of 1 and more)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k].astype(np.int64) + 1
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows: steps back until a sampled one."""
        rows, out, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled[rows]
            out[left[hit]] = self.samples[self.sample_rank[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            c = self.bwt[rows].astype(np.int64)
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return out


def align(item: np.ndarray, doc: np.ndarray, mismatch: float = 2.0, gap: float = 2.0) -> tuple[int, int, int, int, int]:
    """The best local alignment: (matched words, item from, item to, doc from, doc to). Ids of 0 match nothing."""
    m, n = len(item), len(doc)
    h = np.zeros((m + 1, n + 1), np.float32)
    slope = gap * np.arange(n, dtype=np.float32)
    score = np.where((item[:, None] == doc[None, :]) & (item[:, None] > 0), 1.0, -mismatch).astype(np.float32)
    for i in range(1, m + 1):
        row = np.maximum(h[i - 1, :-1] + score[i - 1], h[i - 1, 1:] - gap)
        np.maximum(row, 0, out=row)
        row += slope
        np.maximum.accumulate(row, out=row)
        np.subtract(row, slope, out=h[i, 1:])
    i, j = divmod(int(np.argmax(h)), n + 1)
    if h[i, j] <= 0:
        return 0, 0, 0, 0, 0
    ie, je, matched, a, b = i, j, 0, i, j
    while i and j and h[i, j] > 0:
        if abs(h[i, j] - h[i - 1, j - 1] - score[i - 1, j - 1]) < 1e-3:
            i, j = i - 1, j - 1
            if score[i, j] > 0:
                matched, a, b = matched + 1, i, j
        elif abs(h[i, j] - h[i - 1, j] + gap) < 1e-3:
            i -= 1
        else:
            j -= 1
    return matched, a, ie, b, je


class Searcher:
    """The items' side: vocabulary, phrases and the decision about a document and an item."""

    def __init__(self, items: list[tuple[int, str]], phrase: int = 4, least: int = 15, changes: float = 0.22):
        words = [words_of(t) for _, t in items]
        self.item_ids, self.phrase, self.least, self.changes = [i for i, _ in items], phrase, least, changes
        self.vocabulary = Vocabulary(words)
        self.items = [self.vocabulary.encode(w) for w in words]
        own = [(w[k : k + phrase], i, k) for i, w in enumerate(self.items) for k in range(len(w) - phrase + 1)]
        grams = np.array([g for g, _, _ in own], np.int32).reshape(len(own), phrase)
        self.phrases, back = np.unique(grams, axis=0, return_inverse=True) if len(own) else (grams, np.zeros(0, int))
        owners: list[list[tuple[int, int]]] = [[] for _ in range(len(self.phrases))]
        for p, (_, i, k) in zip(np.ravel(back), own):
            owners[p].append((i, k))
        self.owner_at = np.r_[0, np.cumsum([len(o) for o in owners])].astype(np.int64)
        self.needs: dict[tuple[int, int], int] = {}
        self.needed = np.array([[self.needed_for(r, len(w)) for r in range(self.least + 1)] for w in self.items], np.int64).reshape(-1, self.least + 1)
        self.owner = np.array([x for o in owners for x in o], np.int64).reshape(-1, 2)
        # A phrase of many different items is a way of asking, which tells no item from another.
        texts = {tuple(w): k for k, w in enumerate(map(tuple, self.items))}
        usual = max(4, len(texts) // 100)
        self.telling = [np.zeros(max(0, len(w) - phrase + 1), np.int64) for w in self.items]
        for o in owners:
            if len({texts[tuple(self.items[i])] for i, _ in o}) <= usual:
                for i, k in o:
                    self.telling[i][k] = 1
        # Counts of telling phrases before each place, and places of numbers, of all items one after the other.
        self.item_at = np.r_[0, np.cumsum([len(w) + 1 for w in self.items])].astype(np.int64)
        self.told = np.zeros(self.item_at[-1] + 1, np.int64)
        self.number = np.zeros(self.item_at[-1] + 1, bool)
        for k, (w, t) in enumerate(zip(words, self.telling)):
            a = self.item_at[k]
            self.told[a + 1 : a + 1 + len(t)] = np.cumsum(t)
            self.told[a + 1 + len(t) : a + len(w) + 1] = t.sum()
            self.number[a : a + len(w)] = [any(c.isdigit() for c in x) for x in w]
        # Items of fewer words than a phrase are looked for as they are.
        self.short = [(k, w) for k, w in enumerate(self.items) if 0 < len(w) < phrase]
        self.shortest = min([phrase, *(len(w) for _, w in self.short)])

    def allowed(self, size: int, least: int) -> int:
        """Changed, dropped or added words that a passage of ``size`` words may have for the alignment; for one in shorter passages see `pieces`."""
        return int(self.changes * (size - least))

    def needed_for(self, run: int, length: int) -> int:
        """How many words of the item unchanged runs of a phrase and more cover at least in any passage whose longest run
        is ``run``; beyond the item's length if there is none. A passage of s words with k changes has at most k + 1 runs; as
        many as can be are too short to hold a phrase."""
        key = (min(run, self.least), length)
        if key not in self.needs:
            least, short = min(self.least, length), self.phrase - 1
            best = length + 1
            for s in range(least, length + 1):
                k = self.allowed(s, least)
                spare = run * (k + 1) - (s - k)
                if spare >= 0:
                    lost = min(k, spare // max(1, run - short)) if run > short else k
                    best = min(best, max(run, s - k - short * lost))
            self.needs[key] = best
        return self.needs[key]

    def pieces(self, pair: np.ndarray, doc: np.ndarray, which: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the runs (item from, item to, diagonal) of all pairs: numbers of two runs of a pair that make up a passage of ``least`` words.

        They follow each other in the item, wherever they stand in the document; or they stand side by side in the
        document and one word of the item between them, no number, is changed or dropped there. Each must hold
        a phrase that tells the item from others, because ways of asking stand side by side by chance; and neither may be a part of
        a longer run of another item, which is what the document holds there.
        """
        begin, end, line = runs[:, 0], runs[:, 1], runs[:, 2]
        at = self.item_at[which]
        reach = int((end + line).max(initial=0)) + 2
        place, past = doc * reach + begin + line, doc * reach + end + line
        order = np.lexsort((past, place))
        first = np.nonzero(np.r_[True, place[order][1:] != place[order][:-1]])[0]
        furthest = np.maximum.reduceat(past[order], first) if len(first) else past
        before = np.r_[-1, np.maximum.accumulate(furthest)[:-1]]
        group = np.searchsorted(place[order][first], place)
        own = (before[group] < past) & (furthest[group] == past)
        sound = np.nonzero(own & (self.told[at + np.maximum(begin, end - self.phrase + 1)] > self.told[at + begin]))[0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(sound):
            return sound, sound
        pair, begin, end, line, at = pair[sound], begin[sound], end[sound], line[sound], at[sound]
        reach = int(end.max()) + self.phrase + 2

        def match(have: np.ndarray, want: np.ndarray, least_begin: bool) -> None:
            order = np.lexsort((begin, have)) if least_begin else np.argsort(have, kind="stable")
            sorted_have = have[order]
            place = np.minimum(np.searchsorted(sorted_have, want), len(sorted_have) - 1)
            hit = np.nonzero(sorted_have[place] == want)[0]
            first = order[place[hit]]
            good = (end[hit] - begin[first] >= self.least) & (begin[first] < begin[hit]) & (end[first] < end[hit])
            found.append((first[good], hit[good]))

        by_end = pair * reach + end
        for shared in range(self.phrase):  # both runs may hold the words at the break, if they stand on both sides of it
            match(by_end, pair * reach + begin + shared, True)
        lines = int(line.max() - line.min()) + 3
        by_line = by_end * lines + (line - line.min())
        for moved in (0, 1):
            want = (pair * reach + begin - 1) * lines + (line - line.min()) + moved
            match(by_line, np.where((begin > 0) & ~self.number[at + begin - 1], want, -1), False)
        return sound[np.concatenate([a for a, _ in found])], sound[np.concatenate([b for _, b in found])]

    def leaked(self, runs: np.ndarray, which: int, doc: np.ndarray) -> list[tuple[int, int]]:
        """The spans (from, to) of a document's words that hold a passage of an item, none if it isn't leaked; the runs are
        unchanged ones (item from, item to, diagonal).

        A passage is ``least`` words in a row (or the whole of a shorter item) with few changes; those with one change or a break
        are found by `pieces` before. The counts of `needed_for` rule out most pairs; an alignment decides about the others.
        """
        item = self.items[which]
        length = len(item)
        least = min(self.least, length)
        begin, end, line = runs[:, 0], runs[:, 1], runs[:, 2]
        size = end - begin
        if size.max() >= least:
            return [(int(x[0] + x[2]), int(x[1] + x[2])) for x in runs[size >= least]]
        # The runs of one passage lie on diagonals no further apart than its changes.
        width = max(1, self.allowed(length, least))
        for shift in (0, width):
            band = (line + shift) // (2 * width)
            for x in np.unique(band):
                own = band == x
                run = int(size[own].max())
                covered = np.zeros(length + 1, np.int32)
                np.add.at(covered, begin[own], 1)
                np.add.at(covered, end[own], -1)
                if int((np.cumsum(covered) > 0).sum()) < self.needed_for(run, length):
                    continue
                low = max(0, int((line[own] + begin[own]).min()) - length - width)
                high = min(len(doc), int((line[own] + end[own]).max()) + length + width)
                matched, a, z, b, e = align(item, doc[low:high])
                if z - a >= least and max(z - a, e - b) - matched <= self.allowed(z - a, least):
                    return [(low + b, low + e)]
        return []

    def shard(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, from, to) of each leaked passage: places in the lists, and the span in the document's words."""
        if not docs or not self.items:
            return
        starts = np.r_[0, np.cumsum([len(d) + 1 for d in docs])]
        text = np.zeros(starts[-1], np.int32)
        for d, a in zip(docs, starts):
            text[a : a + len(d)] = d
        # A run of other words says no more than one of them; nor does a run of known words too short for any phrase.
        known = text != 0
        edge = np.nonzero(np.r_[True, known[1:] != known[:-1]])[0]
        size = np.diff(np.r_[edge, len(text)])
        text = np.where(np.repeat(size, size) >= self.shortest, text, 0) if self.shortest > 1 else text
        keep = np.r_[True, (text[1:] != 0) | (text[:-1] != 0)]
        back = np.nonzero(keep)[0]
        index = FMIndex(text[keep], len(self.vocabulary.ids))

        def places(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which phrase stands where."""
            lo, hi = index.search(phrases)
            size = hi - lo
            which = np.repeat(np.arange(len(size)), size)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            return which, back[index.locate(rows)]

        for k, w in self.short:
            _, at = places(w[None, :])
            for a, d in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
                yield d, k, a - int(starts[d]), a - int(starts[d]) + len(w)
        if not len(self.phrases):
            return
        which, at = places(self.phrases)
        if not len(which):
            return
        doc = np.searchsorted(starts, at, "right") - 1
        n_own = self.owner_at[which + 1] - self.owner_at[which]
        many = np.repeat(np.arange(len(which)), n_own)
        own = self.owner[np.arange(len(many)) - np.repeat(np.cumsum(n_own) - n_own, n_own) + np.repeat(self.owner_at[which], n_own)]
        hits = np.stack([doc[many], own[:, 0], at[many] - starts[doc[many]], own[:, 1]], 1)
        # Runs of all pairs at once: hits of a pair on one diagonal that follow each other.
        pair, diagonal = hits[:, 0] * len(self.items) + hits[:, 1], hits[:, 2] - hits[:, 3]
        order = np.lexsort((hits[:, 3], diagonal, pair))
        hits, pair, diagonal = hits[order], pair[order], diagonal[order]
        first = np.r_[True, (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (hits[1:, 3] != hits[:-1, 3] + 1)]
        begin = np.nonzero(first)[0]
        size = np.diff(np.r_[begin, len(hits)]) + self.phrase - 1
        runs = np.stack([hits[begin, 3], hits[begin, 3] + size, diagonal[begin]], 1)
        owner = pair[begin]
        cut = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        ends = np.r_[cut[1:], len(owner)]
        longest, covered = np.maximum.reduceat(size, cut), np.add.reduceat(size, cut)
        which_item = hits[begin[cut], 1]
        a, b = self.pieces(owner, hits[begin, 0], hits[begin, 1], runs)
        for k in np.r_[a, b]:
            yield int(hits[begin[k], 0]), int(hits[begin[k], 1]), int(runs[k, 0] + runs[k, 2]), int(runs[k, 1] + runs[k, 2])
        enough = (longest >= self.least) | (covered >= self.needed[which_item, np.minimum(longest, self.least)])
        enough &= ~np.isin(owner[cut], owner[a])
        for a, z, d, i in zip(cut[enough], ends[enough], hits[begin[cut[enough]], 0].tolist(), which_item[enough].tolist()):
            for b, e in self.leaked(runs[a:z], i, docs[d]):
                yield d, i, b, e


@functools.lru_cache(maxsize=4)
def _searcher(items: tuple[tuple[int, str], ...]) -> Searcher:
    return Searcher(list(items))


def leaked_spans(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    shard_words: int = 200_000, block_chars: int = 8_000_000,
) -> DataFrame:
    """``(key, item_key, first_word, past_word)``: where each document holds an item's text or a passage of 15 words and more of it,
    in words of the text as `words_of` reads it, from 0.

    Case, marks, blanks, tags, lookalike letters, line-break hyphens and one-letter slips don't matter; a word may be
    changed (more in long passages), and a passage may be broken in two. Items of under 15 words count as a whole only, those of under four unchanged. The items are a
    stated query set of any size: they are fetched in blocks of at most ``block_chars`` characters (a longer item is a block
    of its own), each of which is searched in all documents, in indexes built once per shard and block. Null and empty texts hold nothing; a document key that stands in several rows comes out for each of them.
    """
    rows = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(item_key, item_text)
    kinds = f"`{key}` {dict(df.dtypes)[key]}, `{item_key}` {dict(items.dtypes)[item_key]}, first_word int, past_word int"
    blocks: list[tuple[tuple[int, str], ...]] = []
    block, size = [], 0
    for r in rows.orderBy(item_key, item_text).toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            blocks.append(tuple(block))
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    blocks.append(tuple(block))

    def search(block: tuple[tuple[int, str], ...]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searcher = _searcher(block)
            keys: list = []
            docs: list[np.ndarray] = []

            def found() -> pd.DataFrame:
                spans = [(keys[d], searcher.item_ids[i], a, z) for d, i, a, z in searcher.shard(docs)]
                keys.clear(), docs.clear()
                return pd.DataFrame(spans, columns=[key, item_key, "first_word", "past_word"])

            size = 0
            for batch in batches:
                for k, t in zip(batch[key], batch[text]):
                    if not isinstance(t, str) or not t:
                        continue
                    ids = searcher.vocabulary.encode(words_of(t))
                    if (ids > 0).sum() < searcher.shortest:
                        continue
                    keys.append(k), docs.append(ids)
                    size += len(ids)
                    if size >= shard_words:
                        yield found()
                        size = 0
            yield found()

        return run

    out = None
    for block in blocks:
        part = df.select(key, text).mapInPandas(search(block), kinds)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_items(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", **more) -> DataFrame:
    """``(key, item_key)`` of each span of `leaked_spans`; a pair with several spans comes out several times."""
    return leaked_spans(df, items, key, text, item_key, item_text, **more).select(key, item_key)


def removal_spans(spans: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """``(key, first_word, past_word, n_items)``: the spans of each document with those that overlap or touch merged, and the number of items in each."""
    earlier = Window.partitionBy(key).orderBy("first_word", "past_word").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(key).orderBy("first_word", "past_word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.when(F.col("first_word") <= F.max("past_word").over(earlier), 0).otherwise(1)
    numbered = spans.distinct().withColumn("__new", fresh).withColumn("__span", F.sum("__new").over(so_far))
    merged = numbered.groupBy(key, "__span").agg(F.min("first_word").alias("first_word"), F.max("past_word").alias("past_word"), F.countDistinct(item_key).alias("n_items"))
    return merged.drop("__span")
