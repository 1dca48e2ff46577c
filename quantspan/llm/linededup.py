"""Line deduplication by winnowing.

The lines of a text that are not blank are hashed. In every window of ``window`` lines the position of the
smallest hash (the leftmost of equals) is selected as a fingerprint, so a run of at least that many lines has
the same fingerprints wherever it stands. Only selected positions leave a text; those whose fingerprint stands
nowhere else are dropped. From each other one the match is extended to the left and right, over the windows
that chose it: their 128-bit digests are grouped, which joins a position with all others of its hash without
making pairs of them. A window that stood earlier (in an earlier document, or higher up in the same
one) is a repeat. Repeated windows that touch make a run; runs are deleted, the first occurrence stays.

What is deleted is thus exactly each line covered by ``window`` consecutive lines that occur earlier. With
``least_words``, shorter windows of that many words count too, down to a single line: each is its own fingerprint.
A line has as many words as blanks divide it into, or one for every eight bytes if those are more (scripts
without blanks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, released

WINDOW = 3
BYTES_A_WORD = 8
_LAST = (1 << 63) - 1


def line_digests(text: str) -> tuple[list[str], np.ndarray, list[bytes]]:
    """All lines, the places of those that are not blank, and the 128-bit digests of these."""
    lines = text.split("\n")
    at = [k for k, x in enumerate(lines) if x.strip()]
    return lines, np.array(at, np.int64), [xxhash.xxh3_128_digest(lines[k]) for k in at]


def positions(text: str, size: int, least_words: int | None = None) -> list[tuple]:
    """A row for each position that is a fingerprint: the first line of the first window that chose it, the lines of
    a window, the fingerprint, whether that stands at another position of this text too; and of the windows
    that chose it, which follow one another to its left and right, the digest and whether the
    same window stands further up in this text."""
    lines, at, digests = line_digests(text)
    found: list[tuple] = []
    seen: set[bytes] = set()

    def add(start: int, count: int, fingerprint: int, windows: int) -> None:
        wholes = [xxhash.xxh3_128_digest(b"".join(digests[k : k + count])) for k in range(start, start + windows)]
        earlier = []
        for x in wholes:
            earlier.append(x in seen)
            seen.add(x)
        found.append((start, count, fingerprint, wholes, earlier))

    if (n := len(digests) - size + 1) > 0:
        h = np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64).view(np.int64)
        place = np.lib.stride_tricks.sliding_window_view(h, size).argmin(1) + np.arange(n)
        chosen, first, windows = np.unique(place, return_index=True, return_counts=True)
        for p, k, c in zip(chosen.tolist(), first.tolist(), windows.tolist(), strict=True):
            add(k, size, int(h[p]), c)
    if least_words is not None:
        words = np.fromiter((max(len(lines[k].split()), len(lines[k].encode()) // BYTES_A_WORD) for k in at), np.int64, len(at))
        for short in range(1, min(size, len(digests) + 1)):
            for k in np.flatnonzero(np.convolve(words, np.ones(short, np.int64), "valid") >= least_words).tolist():
                add(k, short, xxhash.xxh3_64_intdigest(b"".join(digests[k : k + short])) >> 1, 1)
    times: dict[int, int] = {}
    for row in found:
        times[row[2]] = times.get(row[2], 0) + 1
    return [(start, count, fingerprint, times[fingerprint] > 1, wholes, earlier) for start, count, fingerprint, wholes, earlier in found]


POSITIONS = pa.schema([("start", pa.int32()), ("lines", pa.int32()), ("fingerprint", pa.int64()), ("again", pa.bool_()), ("wholes", pa.list_(pa.binary())), ("seen", pa.list_(pa.bool_()))])


def _positions(size: int, least_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [positions(x or "", size, least_words) for x in part.column(2).to_pylist()]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                flat = [row for f in found for row in f]
                columns = [pa.array([row[c] for row in flat], field.type) for c, field in enumerate(POSITIONS)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *columns], names=["doc", "text_hash", *POSITIONS.names])

    return run


def _without(size: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 256):
                part = batch.slice(b, 256)
                texts, counts = [], []
                for row, spans in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    lines, at, _ = line_digests(row[text_col].as_py())
                    gone = np.zeros(len(at), bool)
                    for s in spans:
                        gone[s // size : s // size + s % size + 1] = True
                    drop = set(at[gone].tolist())
                    texts.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
                    counts.append((len(lines), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())))
                n_lines, n_removed, n_runs = (pa.array(c, pa.int64()) for c in zip(*counts, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), n_lines, n_removed, n_runs], names=["row", "kept", "n_lines", "n_removed", "n_runs"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_words: int | None = None) -> DataFrame:
    """Every row of ``docs`` with all its columns, and ``kept_text, n_lines, n_removed, n_runs``.

    Columns of ``docs`` that are named like one of these four give way to them.

    Documents are ordered by id, null ids last; rows that share an id are not earlier than one another.
    A null text stays null and has one blank line, as an empty one has. Blank lines are no part of runs
    and stay. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "linededup")
    docs = docs.drop(*({"kept_text", "n_lines", "n_removed", "n_runs"} - {id_col, text_col})).withColumn(text_col, F.col(text_col).cast("string"))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.col(text_col), F.lit(1)).alias("text_hash"), F.struct("*").alias("row"))
    found = keyed.select("doc", "text_hash", F.col("row")[text_col].alias("text")).mapInArrow(released(_positions(window, least_words)), "doc long, text_hash long, start int, lines int, fingerprint long, again boolean, wholes array<binary>, seen array<boolean>")
    found = work.table(found, "positions")
    met = found.groupBy("fingerprint").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("again").alias("again")).where("first < last or again")
    matched = found.join(met.select("fingerprint"), "fingerprint", "left_semi")
    each = F.posexplode(F.arrays_zip("wholes", "seen")).alias("k", "window")
    matched = matched.select("doc", "text_hash", "start", "lines", each).select("doc", "text_hash", (F.col("start") + F.col("k")).alias("start"), "lines", F.col("window.wholes").alias("whole"), F.col("window.seen").alias("seen"))
    origin = matched.groupBy("whole").agg(F.min("doc").alias("origin"))
    repeats = matched.join(origin, "whole").where("doc > origin or seen")
    span = F.col("start").cast("long") * window + F.col("lines") - 1
    repeats = work.table(repeats.groupBy("doc", "text_hash").agg(F.collect_set(span).alias("spans")), "repeats")
    work.drop("positions")
    both = keyed.join(repeats.hint("shuffle_hash"), ["doc", "text_hash"], "left").select("row", "spans")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("kept", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_runs"))])
    changed = both.where("spans is not null").mapInArrow(released(_without(window, text_col)), schema)
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    lines = (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")
    same = both.where("spans is null").select("row", F.col("row")[text_col].alias("kept"), lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_runs"))
    return same.unionByName(changed).select("row.*", F.col("kept").alias("kept_text"), "n_lines", "n_removed", "n_runs")
