"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index holds impacts divided by the item's own score, so a passage scores 1 if it has every word of
the item; retrieval is by block-max WAND with a fixed threshold and finds all items above it. The most
common words, which alone bring no item near the threshold, have no cursors: an item needs the rest
of the threshold from its other words, and what the common ones add is looked up for those found. A found
item is a leak if its word shingles are in the passage, as a whole and in both its question (the
beginning) and its answer (the end).

Test items go to the executors in blocks of a fixed number of bytes, one pass over the documents each. Word
frequencies, the number of items and their mean length are those of all items, whatever their block. Within
a block, items of up to 64 words, 128, 256 and so on have indexes and passage lengths of their own.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, columns_as, released
from .tokens import Table, word

#: Bytes of test items that are indexed and broadcast at a time.
BLOCK_BYTES = 4 << 20
#: Words of the items of the first index, at most; a passage is twice as long.
SHORT = 64
#: Postings of a block of a list, and items of a block of the index.
POSTINGS, ITEMS = 16, 4
K1, B = 1.2, 0.75
#: Share of the threshold that common words may bring an item to without cursors of their own.
COMMON = 0.5
NOWHERE = 1 << 60


def words_of(text: str) -> list[str]:
    return [w for w in map(word, text.split()) if w]


class Postings:
    """Items of one word in order, their impacts, and the largest impact of each block."""

    def __init__(self, items: list[int], impacts: list[float]):
        self.items, self.impacts, self.most = items, impacts, max(impacts)
        self.block_last = [items[min(k + POSTINGS, len(items)) - 1] for k in range(0, len(items), POSTINGS)]
        self.block_most = [max(impacts[k : k + POSTINGS]) for k in range(0, len(items), POSTINGS)]


class Index:
    """BM25 over test items; the score of an item's own words is 1.

    ``seen``, ``n`` and ``mean``: in how many of all items each word is, their number and mean length; those
    of the given ones by default.
    """

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float, seen: dict[str, int] | None = None, n: int | None = None, mean: float | None = None):
        self.ids = [i for i, _ in items]
        texts = [words_of(t or "") for _, t in items]
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        coded = [[self.words[w] for w in t] for t in texts]
        self.reach = SHORT
        while self.reach < max(map(len, coded), default=0):
            self.reach *= 2
        if seen is None:
            n, mean = len(coded), sum(map(len, coded)) / max(1, sum(map(bool, coded)))
            seen = Counter(w for t in texts for w in set(t))
        seen = [seen[w] for w in self.words]
        lists = defaultdict(lambda: ([], []))
        for k, t in enumerate(coded):
            impact = {w: math.log(1 + (n - seen[w] + 0.5) / (seen[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(t) / mean)) for w, c in Counter(t).items()}
            whole = sum(impact.values())
            for w, x in impact.items():
                lists[w][0].append(k)
                lists[w][1].append(x / whole)
        self.postings = [Postings(*lists[w]) for w in range(len(self.words))]
        common, added = set(), [0.0] * len(coded)
        for w in sorted(range(len(self.words)), key=lambda w: -seen[w]):
            if any(added[k] + x > threshold * COMMON for k, x in zip(*lists[w], strict=True)):
                break
            common.add(w)
            for k, x in zip(*lists[w], strict=True):
                added[k] += x
        self.threshold, self.gate = threshold, threshold - max(added, default=0.0)
        self.common = {(w, k): x for w in common for k, x in zip(*lists[w], strict=True)}
        self.most = np.array([0.0 if w in common else p.most for w, p in enumerate(self.postings)] + [0.0, 0.0])
        self.peaks: list[list[tuple[int, float]]] = []  # of each word: item blocks and its largest impact there
        for p in self.postings:
            peaks: dict[int, float] = {}
            for k, x in zip(p.items, p.impacts, strict=True):
                peaks[k // ITEMS] = max(x, peaks.get(k // ITEMS, 0.0))
            self.peaks.append(list(peaks.items()))
        self.parts = [self._parts(np.array(t, np.int64), width) for t in coded]

    @staticmethod
    def _parts(t: np.ndarray, width: int) -> tuple[int, tuple[np.ndarray, ...]]:
        """Words of a shingle, and the shingles of the whole item, its question and its answer: the last
        quarter, two shingles' length or more. An item too short to part is its own question and
        answer, and one shorter than a shingle is one shingle of its own length."""
        width = max(1, min(width, len(t)))
        answer, whole = max(len(t) // 4, 2 * width), shingles(t, width)
        return width, (whole, shingles(t[:-answer], width), shingles(t[-answer:], width)) if len(t) >= answer + width else (whole, whole, whole)

    def may_hold(self, terms: set[int]) -> bool:
        """Whether the largest impacts in some block of items add up to what an item needs."""
        sums: dict[int, float] = {}
        for t in terms:
            for block, x in self.peaks[t]:
                sums[block] = sums.get(block, 0.0) + x
        return max(sums.values(), default=0.0) >= self.gate - 1e-9

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the distinct ``terms`` is at least the threshold."""
        found = self.wand([t for t in terms if self.most[t]], self.gate)
        full = ((item, score + sum(self.common.get((t, item), 0.0) for t in terms)) for item, score in found)
        return [x for x in full if x[1] >= self.threshold - 1e-9]

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the ``terms`` is at least ``threshold``: block-max WAND."""
        found, cursors = [], [[self.postings[t].items[0], 0, self.postings[t]] for t in terms]

        def move(c: list, target: int) -> None:
            c[1] = bisect_left(c[2].items, target, c[1])
            c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else NOWHERE

        while True:
            cursors = sorted((c for c in cursors if c[0] != NOWHERE), key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[2].most
                if total >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, after = 0.0, NOWHERE
            for c in cursors[: pivot + 1]:
                block = bisect_left(c[2].block_last, item)
                if block < len(c[2].block_last):
                    bound += c[2].block_most[block]
                    after = min(after, c[2].block_last[block] + 1)
            if bound < threshold - 1e-9:
                target = min([after, *(c[0] for c in cursors[pivot + 1 : pivot + 2])])
                for c in cursors[: pivot + 1]:
                    move(c, max(target, item + 1) if c[0] <= item else target)
                continue
            score = 0.0
            for c in cursors[: pivot + 1]:
                move(c, item)
                if c[0] == item:
                    score += c[2].impacts[c[1]]
                    move(c, item + 1)
            if score >= threshold - 1e-9:
                found.append((item, score))


def shingles(t: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``width`` words in a row; none of fewer words."""
    if len(t) < width:
        return np.zeros(0, np.uint64)
    words, h = t.astype(np.uint64), np.zeros(len(t) - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)] + np.uint64(1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def leaks_of(tokens: list[str], index: Index, table: Table, overlap: float, part: float) -> list[tuple]:
    """(item, score, overlap, question overlap, answer overlap, first word) of the best passage of each leak."""
    if not tokens:
        return []
    code = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
    code = code[code != -2]  # tokens without a word
    length, step = 2 * index.reach, index.reach
    starts = np.arange(0, max(1, len(code) - length + step), step)
    telling = np.flatnonzero(index.most[code] > 0)
    words = code[telling].tolist()
    begin, end = np.searchsorted(telling, starts).tolist(), np.searchsorted(telling, starts + length).tolist()
    best: dict[int, tuple] = {}
    for start, low, high in zip(starts.tolist(), begin, end, strict=True):
        if not index.may_hold(set(words[low:high])):
            continue
        passage = code[start : start + length]
        terms = np.unique(passage[passage >= 0])
        here: dict[int, np.ndarray] = {}
        for item, score in index.search(terms.tolist()):
            width, parts = index.parts[item]
            if width not in here:
                here[width] = shingles(passage, width)
            whole, question, answer = (float(np.isin(p, here[width], assume_unique=True).mean()) for p in parts)
            if whole >= overlap and question >= part and answer >= part and (item not in best or (score, whole) > best[item][1:3]):
                best[item] = (index.ids[item], score, whole, question, answer, start)
    return list(best.values())


def _finder(indexes, overlap: float, part: float):
    own = [(index, Table(lambda token, words=index.words: words.get(w, -1) if (w := word(token)) else -2)) for index in indexes.value]

    def find(text: str) -> list[tuple]:
        tokens = text.split()
        return [x for index, table in own for x in leaks_of(tokens, index, table, overlap, part)]

    return find


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, words), pa.int64()), pa.array([sorted(set(x)) for x in words], pa.list_(pa.string()))], names=["item_id", "text", "n_words", "words"])


def item_blocks(items: DataFrame, width: int, threshold: float) -> Iterator:
    """Broadcast indexes of the test items, each of at most about BLOCK_BYTES of text."""
    spark, work = items.sparkSession, Workspace(items.sparkSession, "benchmark")
    items = work.table(items.mapInArrow(released(_own_words), f"item_id {items.schema['item_id'].dataType.simpleString()}, text string, n_words long, words array<string>"), "items")
    every = items.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.avg(F.when(F.col("n_words") > 0, F.col("n_words"))).alias("mean")).first()
    blocks = -(-(every["bytes"] or 0) // BLOCK_BYTES)
    seen = work.table(items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("seen")), "seen") if blocks else None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = block.select("item_id", "text", "n_words").orderBy("item_id", "text").collect()  # BLOCK_BYTES
        known = seen.join(block.select(F.explode("words").alias("word")).distinct(), "word", "left_semi").collect()  # its words
        known = {r["word"]: r["seen"] for r in known}
        classes: dict[int, list] = defaultdict(list)
        for r in rows:
            classes[max(0, (r["n_words"] - 1) // SHORT).bit_length()].append((r["item_id"], r["text"]))
        yield spark.sparkContext.broadcast([Index(part, width, threshold, known, every["n"], every["mean"] or 1.0) for _, part in sorted(classes.items())])
    work.close()


FOUND = "item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long"


def _own_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = columns_as(items, item_id=id_col, text=text_col).select("item_id", F.col("text").cast("string").alias("text"))
    return own.where("text is not null and item_id is not null").dropDuplicates(["item_id", "text"])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8, part: float = 0.5, shingle_words: int = 5) -> DataFrame:
    """One row for each document and test item that is in it, with the scores of the best passage.

    Null and empty texts hold nothing and null items are not searched, nor are items without a word; an item
    shorter than a shingle is found where its words stand in a row. Rows that repeat are each searched; empty tables give no rows; only the named columns are read.
    """
    own = columns_as(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for index in item_blocks(_own_items(items, item_id_col, item_text_col), shingle_words, threshold):

        def run(batches, index=index):
            find = _finder(index, overlap, part)
            for batch in batches:
                rows = [(k, *x) for k, text in enumerate(batch.column(1)) for x in find(text.as_py() or "")]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    names = [x.split()[0] for x in FOUND.split(", ")]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, columns)], names=["doc_id", *names])

        found = own.mapInArrow(released(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {FOUND}")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8, part: float = 0.5, shingle_words: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item. See :func:`find_leaks`."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    out, schema = docs.select(F.struct("*").alias("row")), T.StructType([T.StructField("row", docs.schema)])
    for index in item_blocks(_own_items(items, item_id_col, item_text_col), shingle_words, threshold):

        def run(batches, index=index):
            find = _finder(index, overlap, part)
            for batch in batches:
                yield batch.filter(pa.array([not find(row[text_col].as_py() or "") for row in batch.column(0)], pa.bool_()))

        out = out.mapInArrow(released(run), schema)
    return out.select("row.*")
