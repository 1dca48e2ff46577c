"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

1. Every text becomes the set of its word shingles. Equal sets (by a 128-bit digest) are one node; from here
   on copies are never met again. A node's signature is ``VALUES`` MinHash values of 16 bits.
2. Signatures are cut into chunks of ``c`` values. If two differ in fewer than chunks * (e + 1) values,
   some chunk differs in at most ``e`` of its values (pigeonhole); leaving out every choice of ``e``
   values gives keys, at least one of which they share. So all pairs under that distance meet in a bucket.
3. In each bucket every node is compared with the smallest one, and links are joined to components.
4. A bucket that still holds several components is cut into blocks of bounded size; the nodes of its largest
   component have blocks of their own, which are never compared with one another. Block meets block in one
   task: first by signature, which leaves few nodes, then on the full sets. A pair that shares several
   buckets is compared only in the first of them, which its two signatures tell. No pair is a row
   unless it is a link, and of links only those that join two components of a task.

Every compared pair must pass a generous signature distance and is then confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, columns_as, released

#: Values of a signature, values of a chunk and errors allowed in it. A pair of Jaccard similarity 0.8 that
#: shares no key is as rare as (1 - .8^5 - 5 * .2 * .8^4)^10, about 2 in a million.
VALUES, CHUNK, ERRORS = 50, 5, 1
KEYS = VALUES // CHUNK * CHUNK  # a way to leave out one value, of every chunk
#: Pairs whose signatures differ in more values are not confirmed; at similarity 0.8 that is 4 in 10^8.
MOST_DIFFERENT = 25
#: A block has about so many nodes or shingles at most; what a task holds is two blocks.
BLOCK, BLOCK_ITEMS = 2048, 1 << 21

def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words.

    A-Z are lower-cased and words end at white space of ASCII. Fewer words make one shingle; none, none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def _multipliers(values: int) -> tuple[np.ndarray, np.ndarray]:
    rule = np.random.default_rng(20240229)
    both = rule.integers(0, 1 << 63, (2, values), dtype=np.uint64)
    return both[0] * np.uint64(2) + np.uint64(1), both[1]


def minhash(shingles: np.ndarray, times: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """16 bits of the smallest hash under each of the permutations."""
    least = np.full(len(times), np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 2048):
        part = (shingles[k : k + 2048, None] ^ masks) * times
        np.minimum(least, part.min(0), out=least)
    return ((least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2")


def digest_of(shingles: np.ndarray) -> bytes:
    """Equal sets have the same digest."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _texts(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield part.column(0), [shingle_hashes(x or "", width) for x in part.column(1).to_pylist()]


def marks(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, digest, sig`` of each text."""

    def run(batches):
        times, masks = _multipliers(VALUES)
        for ids, sets in _texts(batches, width):
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array([digest_of(s) for s in sets], pa.binary()), "sig": pa.array([minhash(s, times, masks).tobytes() for s in sets], pa.binary())})

    return docs.mapInArrow(released(run), "doc_id long, n_shingles long, digest binary, sig binary")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for _, sets in _texts(batches, width):
            yield pa.RecordBatch.from_pydict({"digest": pa.array([digest_of(s) for s in sets], pa.binary()), "items": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    return docs.mapInArrow(released(run), "digest binary, items array<long>")


def signatures(column: pa.Array, values: int = VALUES) -> np.ndarray:
    """[rows, values] of a column of signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, values)


def signature_keys(nodes: DataFrame) -> DataFrame:
    """``key, node``: of every chunk, each way to leave out one of its values; the key's last 6 bits say which."""

    def run(batches):
        for batch in batches:
            sig, node = signatures(batch.column(1)).astype(np.uint64), batch.column(0).to_numpy()
            for slot in range(KEYS):
                h = np.full(len(sig), slot + 1, np.uint64)
                for k in range(slot - slot % CHUNK, slot - slot % CHUNK + CHUNK):
                    if k != slot:
                        h = (h ^ (h >> np.uint64(29)) ^ sig[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(31)
                yield pa.RecordBatch.from_pydict({"key": ((h >> np.uint64(6) << np.uint64(6)) | np.uint64(slot)).view(np.int64), "node": node})

    return nodes.select("node", "sig").mapInArrow(released(run), "key long, node long")


def first_slots(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of each pair of signatures, the first of the keys that they share; KEYS where there is none."""
    same = (one == other).reshape(len(one), -1, CHUNK)
    near = same.sum(2) >= CHUNK - ERRORS
    chunk = near.argmax(1)
    left_out = (~same[np.arange(len(one)), chunk]).argmax(1)  # 0 if all are equal
    return np.where(near.any(1), chunk * CHUNK + left_out, KEYS)


def buckets(keys: DataFrame) -> DataFrame:
    """The rows of keys that two nodes or more have, with the smallest of them."""
    shared = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last")
    return keys.join(shared.select("key", "lead"), "key")


def _signature_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = (signatures(batch.column(4)) != signatures(batch.column(5))).sum(1) <= MOST_DIFFERENT
        yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep))


def groups_of(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """The rows of a partition sorted by its first ``by`` columns, one table for each of their values."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(by)], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(key[low])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def open_pairs(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (x, y) and equal values of the pairs of a task's group that are compared here: of different
    components, similar by size and signature, and with this bucket as the first that they share."""
    slot, within = group["key"][0].as_py() & 63, group["one"][0].as_py() == group["other"][0].as_py()
    sig, size, component, block = signatures(group["sig"].combine_chunks()), *(group[c].to_numpy() for c in ("n_shingles", "component", "block"))
    xs = np.flatnonzero(block == group["one"][0].as_py())
    ys = xs if within else np.flatnonzero(block != group["one"][0].as_py())
    columns = np.ascontiguousarray(sig[ys].T)
    out = []
    for k in range(0, len(xs), 256):
        x = xs[k : k + 256]
        equal = np.zeros((len(x), len(ys)), np.uint8)
        for v in range(VALUES):
            equal += sig[x, v][:, None] == columns[v]
        close = (equal >= VALUES - MOST_DIFFERENT) & (component[x][:, None] != component[ys])
        close &= np.minimum(size[x][:, None], size[ys]) * 100 >= np.maximum(size[x][:, None], size[ys]) * percent
        if within:
            close &= x[:, None] < ys
        i, j = np.nonzero(close)
        for p in range(0, len(i), 1 << 16):
            at, to = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
            here = first_slots(sig[x[at]], sig[ys[to]]) == slot
            out.append((x[at[here]], ys[to[here]], equal[at[here], to[here]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


GROUPED = "key long, one int, other int, block int, node long, component long, n_shingles long, sig binary"


def _screen(percent: int):
    """Of each task's rows, those that are in a pair to compare."""

    def run(batches):
        for group in groups_of(batches, 3):
            x, y, _ = open_pairs(group, percent)
            if len(x):
                yield from group.take(pa.array(np.unique(np.concatenate([x, y])))).combine_chunks().to_batches()

    return run


def _links(percent: int):
    """Links that join two components of a task's rows, confirmed on the full sets."""

    def run(batches):
        for group in groups_of(batches, 3):
            x, y, equal = open_pairs(group, percent)
            node, component = group["node"].to_numpy(), group["component"].to_numpy()
            items = group["items"].combine_chunks()
            flat, ends = items.values.to_numpy(), items.offsets.to_numpy()
            above: dict[int, int] = {}

            def top(c: int, above=above) -> int:
                while c in above:
                    c = above[c]
                return c

            found = []
            for k in np.argsort(-equal.astype(np.int16), kind="stable").tolist():
                i, j = int(x[k]), int(y[k])
                p, q = top(int(component[i])), top(int(component[j]))
                if p == q:
                    continue
                one, other = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
                shared = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * shared >= percent * (len(one) + len(other) - shared):
                    above[max(p, q)] = min(p, q)
                    found.append((node[i], node[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


class Join:
    """The steps of one near-duplicate join."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.work = Workspace(docs.sparkSession, "neardup")
        self.marks = self.work.table(marks(docs, width), "marks")
        nodes = self.marks.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        self.nodes = self.work.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """``node, items``: the full sets of the given nodes, from one text of each."""
        wanted = self.nodes.join(nodes, "node", "left_semi").select("node", "digest", F.col("rep").alias("doc_id"))
        wanted = self.work.table(wanted, f"{name}-wanted")
        texts = self.docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        return self.work.table(sets_of(texts, self.width).join(wanted.select("node", "digest"), "digest").select("node", "items"), name)

    def stars(self, bucketed: DataFrame) -> DataFrame:
        """Links between the smallest node of a bucket and each other one, confirmed on the full sets."""
        pairs = bucketed.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        one = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        near = pairs.join(one("a"), "a").join(one("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        near = near.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(released(_signature_filter), "a long, b long, n_a long, n_b long")
        near = self.work.table(near, "near")
        sets = self.sets(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), "star-sets")
        both = near.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
        shared = F.size(F.array_intersect("items_a", "items_b"))
        links = both.where(shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * self.percent).select("a", "b")
        return self.work.table(links, "star-links")

    def open(self, bucketed: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of buckets with more than one component and more than the one pair that is compared
        already, once for each pair of blocks ``one, other`` that they are compared in."""
        rows = bucketed.join(found, "node", "left").join(self.nodes.select("node", "n_shingles"), "node").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
        rows = self.work.table(rows, "labelled")
        parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"))
        most = F.max(F.struct("n", "component", "items"))
        sizes = parts.groupBy("key").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("items").alias("items")).where("n > most.n and n > 2")
        cut = lambda n, items: F.ceil(F.greatest(n / BLOCK, items / BLOCK_ITEMS)).cast("int")
        sizes = sizes.select("key", F.col("most.component").alias("major"), cut(F.col("n") - F.col("most.n"), F.col("items") - F.col("most.items")).alias("minor_blocks"), cut(F.col("most.n"), F.col("most.items")).alias("major_blocks"))
        rows = rows.join(sizes, "key")
        minor = F.col("component") != F.col("major")
        dealt = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
        block = F.when(minor, dealt("minor_blocks")).otherwise(F.col("minor_blocks") + dealt("major_blocks"))
        met = F.sequence(F.lit(0), F.col("minor_blocks") + F.when(minor, F.col("major_blocks")).otherwise(F.lit(0)) - 1)
        rows = rows.select("key", "node", "n_shingles", "component", block.alias("block"), F.explode(met).alias("met"))
        return rows.select("key", F.least("block", "met").alias("one"), F.greatest("block", "met").alias("other"), "block", "node", "component", "n_shingles")

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Links between components within open buckets."""
        tasks = ["key", "one", "other"]
        held = rows.join(self.nodes.select("node", "sig"), "node").select(*(c.split()[0] for c in GROUPED.split(", ")))
        held = held.repartition(*tasks).sortWithinPartitions(*tasks).mapInArrow(released(_screen(self.percent)), GROUPED)
        held = self.work.table(held, "screened")
        sets = self.sets(held.select("node").distinct(), "block-sets")
        full = held.join(sets, "node").select(*held.columns, "items").repartition(*tasks).sortWithinPartitions(*tasks)
        return self.work.table(full.mapInArrow(released(_links(self.percent)), "a long, b long"), "block-links")

    def run(self) -> DataFrame:
        work = self.work
        bucketed = work.table(buckets(signature_keys(self.nodes)), "buckets")
        links = self.stars(bucketed)
        work.drop("near", "star-sets", "star-sets-wanted")
        found = components(links, work, "star-components")
        links = links.unionByName(self.blocks(self.open(bucketed, found)))
        work.drop("buckets", "labelled", "screened", "block-sets", "block-sets-wanted")
        found = components(links, work, "components")
        group = self.nodes.join(found, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
        group = work.table(group, "groups")
        least = group.groupBy("component").agg(F.min("rep").alias("component_id"))
        group = group.join(least, "component").select("digest", "component_id")
        out = self.marks.join(group, "digest", "left")
        own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts whose shingle sets have 100 * intersection >= ``percent`` * union are linked; ``component_id``
    is the smallest id reachable by links. A null or empty text has no shingles and is linked with
    nothing. Rows that share an id are one document as far as components go; a row with a null id is
    linked with nothing, its component is null and it is kept. An empty table gives no rows; only the
    named columns are read.
    """
    own = columns_as(docs, doc_id=id_col, text=text_col)
    return Join(own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shingle_words, percent).run()
