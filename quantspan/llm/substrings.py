"""Deduplication of repeated byte strings by distributed prefix doubling on sampled positions.

A byte goes if a ``length``-byte string that covers it also starts anywhere else. Sorting every position of
the text, as a suffix array does, moves many times the text at each doubling; here positions stand for
others. In the ``reach`` positions from p on, the one whose next 8 bytes have the smallest hash is the anchor of
p. Equal strings have equal anchors, so a round ranks anchors only:

* an anchor's rank is that of the bytes that all strings it stands for have in common, ``length + 1 - reach``
  from it on. If no other anchor has that rank, none of those strings is repeated;
* a second rank takes in all bytes of those strings. If another anchor has the same, all are repeated;
* what is left is ranked again with a smaller reach, that is by a longer prefix, until at reach 1 the
  prefix is the string itself. Anchors of one first rank go on with one of each second rank.

Ranks are 63-bit content hashes, which makes the rank of any position known where its text is: the second
member of a rank pair need not be fetched from another machine. The pair of ranks has 126 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, columns_as, released

LENGTH = 400
#: Positions that an anchor may stand for in each round.
REACHES = (160, 16, 1)
_LAST = (1 << 63) - 1
_BITS = 28  # for the position within a piece of text
_PIECE = (1 << _BITS) - (1 << 16)


def anchors(data: bytes, reach: int, length: int, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, first, last) for runs of positions in [start, stop] that have the same anchor."""
    for low in range(start, stop + 1, _PIECE):
        high = min(stop, low + _PIECE - 1)
        count = high - low + 1
        if reach == 1:
            yield from ((p, p, p) for p in range(low, high + 1))
            continue
        n = count + reach - 1
        grams = np.ndarray((n,), "<u8", buffer=data, offset=low, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams >>= np.uint64(_BITS)
        grams <<= np.uint64(_BITS)
        grams |= np.arange(n, dtype=np.uint64)  # of equal hashes the leftmost is smallest
        width = 1
        while 2 * width <= reach:
            grams = np.minimum(grams[:-width], grams[width:])
            width *= 2
        if width < reach:
            grams = np.minimum(grams[: count], grams[reach - width : reach - width + count])
        at = (grams[:count] & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], count) - 1
        yield from zip((at[first] + low).tolist(), (first + low).tolist(), (last + low).tolist(), strict=True)


def _ranked(reach: int, length: int):
    """From batches of (u, text[, intervals]) to rows (prefix, whole, u, low, high)."""
    rank, common = xxhash.xxh3_64_intdigest, length + 1 - reach

    def rows(batches):
        for batch in batches:
            spans = batch.column(2) if batch.num_columns > 2 else None
            for k in range(batch.num_rows):
                data = (batch.column(1)[k].as_py() or "").encode()
                if len(data) < length:
                    continue
                u = batch.column(0)[k].as_py()
                parts = {(s["low"], s["high"]) for s in spans[k].as_py()} if spans is not None else [(0, len(data) - length)]
                view = memoryview(data)
                for start, stop in parts:
                    for a, low, high in anchors(data, reach, length, start, stop):
                        yield rank(view[a : a + common], reach) >> 1, rank(view[low : high + length], (a - low) * 1009 + high - low) >> 1, u, low, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 20_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.int32()) for c in columns[3:])], names=["prefix", "whole", "u", "low", "high"])


RANKED = "prefix long, whole long, u long, low int, high int"


def _round(ranked: DataFrame, work: Workspace, name: str, final: bool) -> tuple[DataFrame, DataFrame | None]:
    """Repeated runs of positions (u, low, high), and those to rank again."""
    place = F.xxhash64("u", "low")
    by = ["prefix", "whole"] if final else ["prefix"]  # the prefix is the string itself: 126 bits of it
    shared = ranked.groupBy(*by).agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one <> other").select(*by)
    candidates = work.table(ranked.join(shared, by, "left_semi").distinct(), f"{name}-candidates")
    if final:
        return candidates.select("u", "low", "high"), None
    wholes = candidates.groupBy("prefix", "whole").agg(F.min(place).alias("one"), F.max(place).alias("other"))
    kinds = wholes.groupBy("prefix").agg(F.count("*").alias("kinds"))
    known = work.table(wholes.join(kinds, "prefix").where("one <> other or kinds > 1").select("prefix", "whole", "one", (F.col("one") != F.col("other")).alias("repeated"), (F.col("kinds") > 1).alias("mixed")), f"{name}-known")
    told = candidates.join(known, ["prefix", "whole"])
    repeated = told.where("repeated").select("u", "low", "high")
    again = told.where(F.col("mixed") & (place == F.col("one"))).select("u", "low", "high")
    return repeated, again


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 256):
                part = batch.slice(b, 256)
                out = []
                for text, full, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    data = (text or "").encode()
                    ends: list[list[int]] = [[0, len(data)]] if full and len(data) >= length else []
                    for low, high in sorted((s["low"], s["high"] + length) for s in spans or ()) if not ends else ():
                        if ends and low <= ends[-1][1]:
                            ends[-1][1] = max(ends[-1][1], high)
                        else:
                            ends.append([low, high])
                    kept, at = [], 0
                    for low, high in ends:
                        kept.append(data[at:low])
                        at = high
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    out.append((len(data), len(data) - len(rest), len(ends), rest))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, reaches: tuple[int, ...] = REACHES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) for every row.

    A null text is taken as an empty one. Rows that repeat are occurrences of their own, so both lose all
    repeated bytes; null ids are ids as any. An empty table gives no rows; only the named columns are read.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "substrings")
    own = columns_as(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(3)).alias("u"), "text")
    ids = work.table(own.select("doc", "u"), "ids")
    texts = work.table(ids.groupBy("u").agg(F.count("*").alias("rows"), F.min("doc").alias("doc")), "texts")

    ranked = work.table(own.select("u", "text").mapInArrow(released(_ranked(reaches[0], length)), RANKED), "ranked-0")
    covered = None
    for k, reach in enumerate(reaches):
        found, again = _round(ranked, work, str(k), reach == 1)
        found = work.table(found, f"found-{k}")
        covered = found if covered is None else covered.unionByName(found)
        if again is None:
            work.drop(f"ranked-{k}", f"{k}-candidates")
            break
        again = work.table(again.groupBy("u").agg(F.collect_list(F.struct("low", "high")).alias("spans")).join(texts, "u").select("doc", "u", "spans"), f"again-{k}")
        work.drop(f"ranked-{k}", f"{k}-candidates", f"{k}-known")
        source = own.join(again.hint("shuffle_hash"), ["doc", "u"]).select("u", "text", "spans")
        ranked = work.table(source.mapInArrow(released(_ranked(reaches[k + 1], length)), RANKED), f"ranked-{k + 1}")

    spans = covered.groupBy("u").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    cuts = texts.select("u", (F.col("rows") > 1).alias("full")).join(spans, "u", "left").where("full or spans is not null")
    cuts = cuts.select("u", "full", F.when(~F.col("full"), F.col("spans")).alias("spans"))
    cuts = work.table(ids.distinct().join(cuts, "u").select("doc", "u", "full", "spans"), "cuts")
    both = own.join(cuts.hint("shuffle_hash"), ["doc", "u"], "left").select("doc_id", "text", F.coalesce("full", F.lit(False)).alias("full"), "spans")
    return both.mapInArrow(released(_cut(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
