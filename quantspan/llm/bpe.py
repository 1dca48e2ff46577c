"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each match of the split pattern is encoded by itself. A segment tree over its byte positions stores
the leftmost position with the smallest pair rank; a merge changes at most three leaves (the merged
pair, the pair it swallows and the pair before it), each a logarithmic update. Short pieces that a
worker has not met are encoded together, one tree a row of an array, so that numpy makes one merge of
every piece at a time; long pieces have a tree of their own. Encoded pieces are remembered in a table
that is emptied when full, so memory is bounded.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_as, released

#: Rows are sent on when their texts and ids reach about this many bytes.
BATCH_BYTES = 4 << 20
#: Pieces that a worker remembers; more only while one block of texts needs them.
REMEMBERED = 400_000
#: Texts are encoded in blocks of so many characters, a longer text so many matches at a time.
LONG_TEXT, MATCHES = 1 << 20, 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: the pair of lowest rank, leftmost first, is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    rank_of, none = ranks.get, (1 << 62) - 1
    size = 1 << (n - 1).bit_length()
    blank = [none] * (2 * size)
    tree = blank if n < 4096 else array("q", blank)
    after, before = (list(x) if n < 4096 else array("i", x) for x in (range(1, n + 1), range(-1, n - 1)))
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left < right else right
            if tree[k] == least:
                return
            tree[k] = least

    def rank_at(i: int) -> int:
        """The leaf of the pair that starts at ``i``."""
        j = after[i]
        rank = rank_of(piece[i : after[j]]) if j < n else None
        return none if rank is None else rank * n + i

    while (least := tree[1]) != none:
        i = least % n
        j = after[i]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, rank_at(i))
        if before[i] >= 0:
            put(before[i], rank_at(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairTable:
    """From pairs of token ids to the rank of their concatenation, as an open-addressing hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.byte = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        bits = max(10, int(len(found) * 4).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        keys = left << 32 | right
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot, one stays
            self.ranks[slot[self.keys[slot] == keys]] = rank[self.keys[slot] == keys]
            rest = self.keys[slot] != keys
            keys, rank, slot = keys[rest], rank[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """Ranks, or ``none`` where the pair makes no token."""
        keys = left << 32 | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], none)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            held = self.keys[slot[rest]]
            same = held == keys[rest]
            out[rest[same]] = self.ranks[slot[rest[same]]]
            rest = rest[~same & (held >= 0)]
        return out


def encode_pieces(pieces: list[bytes], pairs: PairTable, width: int) -> list[bytes]:
    """Ids of pieces of 1 to ``width`` bytes (a power of two), as little-endian 32-bit integers.

    Row r of ``tree`` is the segment tree of piece r; its root holds rank * width + position.
    """
    count, none = len(pieces), 1 << 40
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(count, width)
    columns = np.arange(width)
    token = np.where(columns < lengths[:, None], pairs.byte[data], -1)
    token = np.concatenate([token, np.full((count, 1), -1)], 1)  # what follows the last position
    after, before = np.tile(np.arange(1, width + 2), (count, 1)), np.tile(np.arange(-1, width), (count, 1))
    tree = np.full((count, 2 * width), none * width)
    rank = pairs(token[:, :-1].ravel(), token[:, 1:].ravel(), none).reshape(count, width)
    tree[:, width:] = np.where((token[:, 1:] < 0) | (rank == none), none * width, rank * width + columns)
    half = width
    while half > 1:
        np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
        half //= 2
    flat_tree, flat_token, flat_after, flat_before = tree.ravel(), token.ravel(), after.ravel(), before.ravel()

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        base, k = rows * (2 * width), at + width
        flat_tree[base + k] = value
        while len(rows) and k[0] > 1:
            k = k >> 1
            two = base + 2 * k
            flat_tree[base + k] = np.minimum(flat_tree[two], flat_tree[two + 1])

    def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        left = rows * (width + 1)
        follower = flat_token[left + np.minimum(flat_after[left + at], width)]
        found = pairs(flat_token[left + at], follower, none)
        return np.where((follower < 0) | (found == none), none * width, found * width + at)

    rows = np.flatnonzero(tree[:, 1] < none)
    while len(rows):
        least = tree[rows, 1]
        at = least % width
        base = rows * (width + 1)
        swallowed = flat_after[base + at]
        following = flat_after[base + swallowed]
        flat_token[base + at] = least // width
        flat_token[base + swallowed] = -2  # no longer live
        flat_after[base + at] = following
        flat_before[base + np.minimum(following, width)] = at
        put(rows, swallowed, none * width)
        put(rows, at, leaf(rows, at))
        previous = flat_before[base + at]
        has = previous >= 0
        put(rows[has], previous[has], leaf(rows[has], previous[has]))
        rows = rows[tree[rows, 1] < none]
    live = token >= 0
    ends = np.cumsum(live.sum(1)) * 4
    packed = token[live].astype("<u4").tobytes()
    return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """From texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.pairs, self.known = ranks, regex.compile(pattern), PairTable(ranks), {}
        # The standard library's engine splits faster; it is used for texts on which both agree.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.plain = None if "\\p" in plain else re.compile(plain)
        kinds = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
        unlike = "".join(c for c in map(chr, range(0x250)) if any(bool(regex.match(a, c)) != bool(re.match(b, c)) for a, b in kinds))
        self.unlike = re.compile(f"[{re.escape(unlike)}\u0250-\U0010ffff]")

    def _split(self, text: str) -> list[str]:
        return (self.pattern if self.plain is None or self.unlike.search(text) else self.plain).findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Encode those of the pieces that are not known; what else is known may be forgotten."""
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = pieces
        waiting: dict[int, list[tuple[str, bytes]]] = {8: [], 16: [], 32: []}
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = struct.pack("<I", whole)
            elif len(raw) > 32:
                ids = encode_piece(raw, self.ranks)
                self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                waiting[8 if len(raw) <= 8 else 16 if len(raw) <= 16 else 32].append((piece, raw))
        for width, found in waiting.items():
            for k in range(0, len(found), 1 << 14):
                part = found[k : k + (1 << 14)]
                self.known.update(zip([x[0] for x in part], encode_pieces([x[1] for x in part], self.pairs, width), strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; those not known are learnt for all texts together."""
        if sum(map(len, texts)) <= LONG_TEXT:
            split = list(map(self._split, texts))
            self.learn(set().union(*split))
            yield from (b"".join(map(self.known.__getitem__, x)) for x in split)
        elif len(texts) > 1:
            half = len(texts) // 2
            yield from self.encode_all(texts[:half])
            yield from self.encode_all(texts[half:])
        else:
            matches, parts = (m[0] for m in self.pattern.finditer(texts[0])), []
            while part := list(islice(matches, MATCHES)):
                self.learn(set(part))
                parts.append(b"".join(map(self.known.__getitem__, part)))
            yield b"".join(parts)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + len(row[-1])
        if weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers).

    Special tokens are ordinary text. A null or empty text has no ids, rows that repeat are each
    encoded, an empty table gives no rows, and columns other than id and text are not read.
    """
    own = columns_as(docs, doc_id=id_col, text=text_col)
    own = own.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranks = own.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # a vocabulary file, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema = Encoder(ranks.value, pattern), None

        def rows():
            texts = _texts(watched())
            while block := list(islice(texts, 256)):
                for (doc_id, _), ids in zip(block, encoder.encode_all([x[1] for x in block]), strict=True):
                    yield doc_id, len(ids) // 4, ids

        def watched():
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([batch.schema.field(0), ("n_tokens", pa.int64()), ("ids", pa.binary())])
                yield batch

        source = rows()
        first = next(source, None)
        if first is not None:
            yield from _sent((row for part in ([first], source) for row in part), schema)

    return own.mapInArrow(released(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded`` (the bytes that ``ids`` stand for) to what :func:`bpe_encode` returns."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = [b""] * (max(ranks.value.values()) + 1)
        for k, v in ranks.value.items():
            token[v] = k
        for batch in batches:
            schema = pa.schema([*batch.schema, ("decoded", pa.binary())])

            def rows(batch=batch):
                for row in _texts([batch]):
                    ids = np.frombuffer(row[2], "<u4")
                    yield *row, b"".join(b"".join(map(token.__getitem__, ids[k : k + LONG_TEXT].tolist())) for k in range(0, len(ids), LONG_TEXT))

            yield from _sent(rows(), schema)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(released(run), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
