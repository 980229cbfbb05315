"""Evaluation texts leaking into training text, by suffix arrays.

The corpus is cut into shards; each shard's words make a suffix array (the places at which an item could begin to match, sorted
by the words that follow). Every suffix of every item is binary-searched in it, those that begin alike once for all items: the
places that share its first words are neighbours there. A document's matches near one another, in which an item has words
enough, are followed to their full length and then carried on at both ends over small slips, which gives the passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstone.llm.spread import spread
from tickstone.llm.words import counted_words, words

SCHEMA = "doc_id bigint, item_id bigint, passage_words int, slips int, longest_match int, first_word int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
MOST_KEPT = 50_000


@dataclass(frozen=True)
class Passage:
    """``least_words`` of an item make a passage; ``slip_share`` of them may be added, dropped or altered, and ``excess`` more
    for a stretch in between. ``seed``: words of a verbatim match that is looked for. With one slip in ten, ``least_words``
    words hold at least half as many in runs of ``seed`` or more (20 words with two slips: 18 words in three runs), which is what is
    asked of a document's matches before they are followed. ``shard_words``: words of a shard. ``block_words``: words of items
    searched at a time; more items are searched block by block.
    """

    least_words: int = 20
    slip_share: float = 0.15
    excess: int = 3
    seed: int = 5
    shard_words: int = 400_000
    block_words: int = 2_000_000


def suffix_array(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` of ``text`` sorted by the ``depth`` words from there on; equal ones in the order given. ``text`` holds -1 and above."""
    if not len(places):
        return places
    bits = max(1, int(text.max() + 2).bit_length())
    each = max(1, 62 // bits)
    keys = []
    for j in range(0, depth, each):
        key = np.zeros(len(places), np.int64)
        for i in range(j, min(j + each, depth)):
            at = places + i
            key = (key << bits) | np.where(at < len(text), text[np.minimum(at, len(text) - 1)] + 1, 0)
        keys.append(key)
    return places[np.lexsort(keys[::-1])]


def search(text: np.ndarray, array: np.ndarray, queries: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query suffix the range of ``array`` whose places share its first ``length`` words; all at once."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
        while np.any(lo < hi):
            open_ = lo < hi
            mid = (lo + hi) // 2
            at = array[np.minimum(mid, len(array) - 1)]
            order = np.zeros(len(starts), np.int8)
            for j in range(length):
                a, b = text[np.minimum(at + j, len(text) - 1)], queries[starts + j]
                order = np.where(order == 0, np.sign(a.astype(np.int64) - b), order)
            right = (order < 0) | (upper & (order == 0))
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


class Items:
    """Items as numbers: one array with a gap after each item, and its suffixes in order, in classes that begin with the same words."""

    def __init__(self, rows: list[tuple[int, str | None]], p: Passage):
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        for item_id, text in rows:
            w, place = counted_words(text)
            if len(w) >= p.seed and place[-1] + 1 >= p.least_words:
                self.ids.append(item_id)
                self.texts.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int32))
                self.places.append(np.array(place))
        gap = np.full(p.seed, -1, np.int32)
        self.text = np.concatenate([x for t in self.texts for x in (t, gap)]) if self.texts else gap
        first = np.cumsum([0, *(len(t) + p.seed for t in self.texts)])
        starts = np.concatenate([f + np.arange(len(t) - p.seed + 1) for f, t in zip(first, self.texts, strict=False)]) if self.texts else np.zeros(0, int)
        array = suffix_array(self.text, starts, p.seed)
        self.item = np.searchsorted(first, array, side="right") - 1
        self.start = array - first[self.item]
        new = np.ones(len(array), bool)
        new[1:] = np.any([self.text[array[1:] + j] != self.text[array[:-1] + j] for j in range(p.seed)], axis=0) if len(array) > 1 else new[1:]
        self.first = np.append(np.flatnonzero(new), len(array))
        self.heads = array[self.first[:-1]]


def _hits(text: np.ndarray, items: Items | SimpleNamespace, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``text`` at which a suffix of an item begins, in order, and the class of suffixes of each."""
    able = np.ones(max(len(text) - seed + 1, 0), bool)
    for j in range(seed):
        able &= text[j : j + len(able)] >= 0
    array = suffix_array(text, np.flatnonzero(able), seed)
    if not len(array) or not len(items.heads):
        return np.zeros(0, int), np.zeros(0, int)
    lo, hi = search(text, array, items.text, items.heads, seed)
    n = hi - lo
    kind = np.repeat(np.arange(len(n)), n)
    at = array[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(kind))]
    order = np.argsort(at)
    return at[order], kind[order]


def _runs(at: np.ndarray, kind: np.ndarray, items: Items | SimpleNamespace, p: Passage) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Items of which enough words are in these matches, each with its maximal verbatim runs: place, start in the item, length; longest first."""
    n = items.first[kind + 1] - items.first[kind]
    member = np.repeat(items.first[kind] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, start, place = items.item[member], items.start[member], np.repeat(at, n)
    order = np.lexsort((place, item))
    i, x = item[order], place[order]
    step = np.minimum(np.diff(x, prepend=-p.seed), p.seed)
    step[np.r_[True, i[1:] != i[:-1]]] = p.seed
    words_of = np.bincount(i, step)
    keep = words_of[item] >= p.least_words // 2
    item, start, place = item[keep], start[keep], place[keep]
    order = np.lexsort((place, place - start, item))
    item, start, place = item[order], start[order], place[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] - place[:-1] != 1) | (start[1:] - start[:-1] != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(item))) + p.seed - 1
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k, f in zip(np.argsort(-length, kind="stable").tolist(), first[np.argsort(-length, kind="stable")].tolist(), strict=True):
        out.setdefault(int(item[f]), []).append((int(place[f]), int(start[f]), int(length[k])))
    return list(out.items())


def carried_on(doc: list[int], item: list[int], base: int, share: float, excess: int) -> list[tuple[int, int]]:
    """For 0, 1, 2... slips the most words of ``item`` that are carried on from its beginning, ended by a match, and the words of ``doc``.

    The furthest place on each diagonal for a number of slips follows from those for one less. Ends where the slips pass
    ``share`` of the words so far (``base`` before) by more than ``excess``.
    """
    n, m = len(doc), len(item)

    def along(j: int, k: int) -> int:
        while j < m and j + k < n and item[j] == doc[j + k]:
            j += 1
        return j

    far = {0: along(0, 0)}
    out = [(far[0], far[0])]
    while out[-1][0] < m and len(out) <= share * (base + out[-1][0]) + excess:
        best, new = out[-1], {}
        for k in range(-len(out), len(out) + 1):
            j = max(far.get(k, -2) + 1, far.get(k - 1, -1), far.get(k + 1, -2) + 1)
            if j < 0 or j > m or not 0 <= j + k <= n:
                continue
            new[k] = end = along(j, k)
            if end > j and end > best[0]:
                best = (end, end + k)
        if not new:
            break
        far = new
        out.append(best)
    return out


def passage_of(doc: np.ndarray, item: np.ndarray, places: np.ndarray, runs: list[tuple[int, int, int]], p: Passage) -> tuple[int, int, int, int] | None:
    """The longest passage of an item in a document: words, slips, longest verbatim match, first word; None if there is none.

    Every passage holds one of the maximal verbatim ``runs``; each is carried on at both ends with any number of slips.
    """
    whole, best = int(places[-1]) + 1, None
    reach = len(item) + int(p.slip_share * len(item)) + p.excess + 1
    for at, start, length in runs:
        if best and (best[0] == whole or best[3] <= at and at + length <= best[4]):
            continue
        end = at + length
        right = carried_on(doc[end : end + reach].tolist(), item[start + length :].tolist(), length, p.slip_share, p.excess)
        left = carried_on(doc[max(0, at - reach) : at][::-1].tolist(), item[:start][::-1].tolist(), length, p.slip_share, p.excess)
        for a, (back, before) in enumerate(left):
            for b, (ahead, after) in enumerate(right):
                n = int(places[start + length + ahead - 1] - places[start - back]) + 1
                if a + b <= p.slip_share * n and n >= p.least_words and (best is None or (n, -a - b) > (best[0], -best[1])):
                    best = (n, a + b, runs[0][2], at - before, end + after)
    return best[:4] if best else None


def shard_leaks(ids: list[str | None], texts: list[list[str]], items: Items | SimpleNamespace, p: Passage, kept: dict[bytes, list]) -> Iterator[tuple]:
    """Leaks in one shard's documents. ``kept`` remembers what groups of matches came to: shared openings come again and again."""
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    flat = chain.from_iterable(chain(t, ("\n",)) for t in texts)
    text = np.fromiter(map(items.number.get, flat, repeat(-1)), np.int32, first[-1])
    at, kind = _hits(text, items, p.seed)
    if not len(at):
        return
    doc = np.searchsorted(first, at, side="right") - 1
    cut = np.flatnonzero((np.diff(at) > p.seed + p.least_words) | (np.diff(doc) > 0)) + 1
    bounds = np.r_[0, cut, len(at)]
    # fewer places than the words asked for need are passed over without a look
    span = at[bounds[1:] - 1] - at[bounds[:-1]] + p.seed
    best: dict[tuple[int, int], tuple] = {}
    for k in np.flatnonzero(span >= p.least_words // 2).tolist():
        a, b = bounds[k], bounds[k + 1]
        d, near = int(doc[a]), at[a:b] - at[a]
        key = near.tobytes() + kind[a:b].tobytes()
        found = kept.get(key)
        if found is None:
            if len(kept) >= MOST_KEPT:
                kept.clear()
            found = kept[key] = _runs(near, kind[a:b], items, p)
        here = int(at[a] - first[d])
        for i, runs in found:
            got = passage_of(text[first[d] : first[d + 1] - 1], items.texts[i], items.places[i], [(x + here, s, n) for x, s, n in runs], p)
            if got and got[:2] > best.get((d, i), (0, 0))[:2]:
                best[d, i] = got
    for (d, i), got in best.items():
        yield ids[d], items.ids[i], *got


def _blocks(items: DataFrame, most_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size; the driver holds one block."""
    block, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        if r.item_id is None:
            continue
        n = len((r.text or "").split())
        if block and size + n > most_words:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    yield block


def leaks(documents: DataFrame, items: DataFrame, passage: Passage = Passage()) -> DataFrame:
    """``doc_id, item_id, passage_words, slips, longest_match, first_word``: one row a document and item it quotes.

    A document quotes an item if it carries at least ``least_words`` of its (blank-separated) words in order, apart from
    how they are written and from slips. ``longest_match`` is the longest verbatim match in words, ``first_word`` where the
    passage begins. Null and empty texts match nothing; a null ``doc_id`` is kept as null; items given twice are
    reported under each id, a repeated document once for each of its rows. No documents or no items give no rows.
    Work: no exchange but to spread too few files over the cores; whole texts, all documents, read and cut into words once. Each
    shard is searched for one block of items after the other; a task holds one block and one shard at a time, and what a
    shared opening costs does not grow with documents times items, as its matches are followed only where they can make a passage.
    """
    # ids travel as texts: pandas would turn a column with nulls into floats
    docs = spread(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id", "text")
    sc = docs.sparkSession.sparkContext
    # as plain values: an executor that has no copy of this package cannot read its classes
    sent = [sc.broadcast(vars(Items(block, passage))) for block in _blocks(items, passage.block_words)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[dict[bytes, list]] = [{} for _ in sent]

        def flush(ids: list[str | None], texts: list[list[str]]) -> pd.DataFrame:
            rows: list[tuple] = []
            for block, known in zip(sent, kept, strict=True):
                rows += shard_leaks(ids, texts, SimpleNamespace(**block.value), passage, known)
                if len(sent) > 1:
                    known.clear()
                    block._value = None
                    del block._value  # read again from the worker's disk for the next shard
            return pd.DataFrame(rows, columns=COLUMNS)

        ids: list[str | None] = []
        texts: list[list[str]] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                w = words(text)
                if len(w) < passage.seed:
                    continue
                ids.append(doc_id)
                texts.append(w)
                size += len(w)
                if size >= passage.shard_words:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    return docs.mapInPandas(run, SCHEMA.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of which ``found`` has no row; those without ``doc_id`` stay."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
