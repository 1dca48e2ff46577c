"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Equal vectors of a label are one node. Nodes of a label are dealt into shards of bounded size, each with
a graph; blocks of queries go to every shard of their label. A query whose beam is full of links is
searched again with a wider beam, and each task audits some of its queries against all vectors of the
shard and widens every beam until the audit finds enough of the links. Links are confirmed by cosine
in double precision and joined to components.

Searches and insertions are made for many vectors at a time, step by step, with numpy.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, columns_as

#: Vectors of a shard and of a query block, about.
SHARD, BLOCK = 8192, 1024
#: Neighbours in the lowest layer and above; candidates kept while building; nodes compared with all others.
LOW, HIGH, BUILD_BEAM, BRUTE = 32, 16, 64, 512
#: First beam, nodes expanded in a step, audited queries of a block, the links they must have and the recall to reach.
BEAM, STEP, AUDIT, LINKS, RECALL = 64, 4, 48, 32, 0.99
#: Blocks of queries that follow one copy of a graph.
GROUP = 8


@dataclass
class Layer:
    nodes: np.ndarray  # which vectors are in it
    near: np.ndarray  # [vectors of the shard, neighbours], -1 where there is none


def _select(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, from the most similar on: those nearer to it than to any chosen before;
    free places go to the most similar of the rest. ``ids`` -1: no candidate."""
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    out = np.full((len(ids), most), -1, np.int32)
    for k in range(0, len(ids), 512):
        s, c = sims[k : k + 512], ids[k : k + 512]
        found = vectors[c]
        among = np.matmul(found, found.transpose(0, 2, 1))
        chosen, valid = np.zeros(c.shape, bool), c >= 0
        for j in range(c.shape[1]):
            closest = np.where(chosen, among[:, :, j], -np.inf).max(1)
            chosen[:, j] = valid[:, j] & (s[:, j] > closest) & (chosen.sum(1) < most)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
        first = np.argsort(rank, axis=1)[:, :most]
        out[k : k + 512, : first.shape[1]] = np.take_along_axis(np.where(valid, c, -1), first, 1)
    return out


def beam_search(near: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nodes of a layer found most similar to each query: ids (-1: none) and similarities."""
    m, rows = len(queries), np.arange(len(queries))[:, None]
    ids, sims = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = entry, (vectors[entry] * queries).sum(1)
    done, seen = np.zeros((m, beam), bool), np.zeros((m, len(vectors)), bool)
    seen[rows[:, 0], entry] = True
    active = np.arange(m)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, sims[active])
        pick = np.argpartition(-open_, min(STEP, beam) - 1, axis=1)[:, :STEP]
        good = np.take_along_axis(open_, pick, 1) > -np.inf
        going = good.any(1)
        active, pick, good = active[going], pick[going], good[going]
        if not len(active):
            break
        done[active[:, None], pick] |= good
        new = np.where(good[:, :, None], near[np.take_along_axis(ids[active], pick, 1)], -1).reshape(len(active), -1)
        new = np.where(seen[active[:, None], new], -1, new)
        order = np.sort(new, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1  # two expanded nodes may share a neighbour
        valid = order >= 0
        at, col = np.nonzero(valid)
        seen[active[at], order[at, col]] = True
        score = np.full(order.shape, -np.inf, np.float32)
        score[at, col] = np.einsum("ij,ij->i", vectors[order[at, col]], queries[active[at]])
        all_ids, all_sims = np.concatenate([ids[active], order], 1), np.concatenate([sims[active], score], 1)
        all_done = np.concatenate([done[active], np.zeros(order.shape, bool)], 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
        ids[active] = np.where(np.isneginf(sims[active]), -1, ids[active])
    return ids, sims


class Graph:
    """Layers from the highest to the lowest over unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(HIGH)).astype(int)
        order = np.argsort(-level, kind="stable")
        top = 0
        while top < level.max(initial=0) and (level >= top).sum() > BRUTE:
            top += 1
        self.layers: list[Layer] = []
        for low in range(top, -1, -1):
            self.layers.append(Layer(order[level[order] >= low], np.full((n, LOW if low == 0 else HIGH), -1, np.int32)))
            self._build(self.layers[-1])

    def _build(self, layer: Layer) -> None:
        most = layer.near.shape[1]
        start = layer.nodes[:BRUTE]
        sims = self.vectors[start] @ self.vectors[start].T
        np.fill_diagonal(sims, -np.inf)
        keep = min(BUILD_BEAM, len(start))
        best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        s = np.take_along_axis(sims, best, 1)
        self._connect(layer, start, s, np.where(np.isneginf(s), -1, start[best]), most)
        done = len(start)
        while done < len(layer.nodes):
            part = layer.nodes[done : done + min(done, 1024)]
            ids, sims = self._descend(self.vectors[part], BUILD_BEAM)
            own = self.vectors[part] @ self.vectors[part].T
            np.fill_diagonal(own, -np.inf)
            keep = min(BUILD_BEAM, len(part))
            best = np.argpartition(-own, keep - 1, axis=1)[:, :keep]
            s = np.take_along_axis(own, best, 1)
            self._connect(layer, part, np.concatenate([sims, s], 1), np.concatenate([ids, np.where(np.isneginf(s), -1, part[best])], 1), most)
            done += len(part)

    def _connect(self, layer: Layer, new: np.ndarray, sims: np.ndarray, ids: np.ndarray, most: int) -> None:
        layer.near[new] = _select(sims, ids, self.vectors, most)
        source, target = np.repeat(new, most), layer.near[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sim = np.einsum("ij,ij->i", self.vectors[source], self.vectors[target])
        order = np.lexsort((-sim, target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.diff(target, prepend=-1))
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        to, row = np.unique(target, return_inverse=True)
        more = np.full((len(to), 2 * most), -1, np.int64)
        fits = place < 2 * most
        more[row[fits], place[fits]] = source[fits]
        both = np.concatenate([layer.near[to], more], 1)
        both[:, most:][(both[:, most:, None] == both[:, None, :most]).any(2)] = -1  # known already
        sims = np.where(both >= 0, np.einsum("ijk,ik->ij", self.vectors[both], self.vectors[to]), -np.inf)
        layer.near[to] = _select(sims, both, self.vectors, most)

    def _descend(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Search the layers that there are, with one path in all but the last."""
        entry = np.full(len(queries), self.layers[0].nodes[0])
        for layer in self.layers[:-1]:
            ids, sims = beam_search(layer.near, self.vectors, queries, entry, STEP)
            entry = ids[np.arange(len(queries)), sims.argmax(1)]
        return beam_search(self.layers[-1].near, self.vectors, queries, entry, beam)

    def links(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) whose similarity is about ``threshold`` or more; full beams are widened."""
        floor, waiting, found = threshold - 1e-4, np.arange(len(queries)), []
        while len(waiting):
            beam = min(beam, len(self.vectors))
            full = []
            for k in range(0, len(waiting), max(32, BLOCK * BEAM // beam)):
                part = waiting[k : k + max(32, BLOCK * BEAM // beam)]
                ids, sims = self._descend(queries[part].astype(np.float32), beam)
                hit = (ids >= 0) & (sims >= floor)
                again = hit.all(1) if beam < len(self.vectors) else np.zeros(len(part), bool)
                full.append(part[again])
                at, col = np.nonzero(hit & ~again[:, None])
                found.append((part[at], ids[at, col]))
            waiting, beam = np.concatenate(full), 4 * beam
        return np.concatenate([x[0] for x in found] or [np.zeros(0, np.int64)]), np.concatenate([x[1] for x in found] or [np.zeros(0, np.int64)])


def audited_links(graph: Graph, exact: np.ndarray, queries: np.ndarray, threshold: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Links of all queries in double precision, with beams widened until the audited ones have RECALL of theirs;
    and of the audited links how many were found, and how many there are.

    ``own``: of each query the node that is the query itself, or -1; it is no evidence. More queries are audited
    until they have LINKS links in the shard, or all are.
    """
    own = np.full(len(queries), -1) if own is None else own
    count = min(AUDIT, len(queries))
    while True:
        audited = np.unique(np.linspace(0, len(queries) - 1, count).astype(int))
        truth = queries[audited] @ exact.T >= threshold
        is_own = own[audited] >= 0
        truth[np.flatnonzero(is_own), own[audited][is_own]] = False
        if truth.sum() >= LINKS or count == len(queries):
            break
        count = min(2 * count, len(queries))
    beam = min(BEAM, len(exact))
    while True:
        q, node = graph.links(queries[audited], threshold, beam)
        hit = np.zeros(truth.shape, bool)
        hit[q, node] = True
        if beam >= len(exact) or (hit & truth).sum() >= RECALL * truth.sum():
            break
        beam *= 2
    q, node = graph.links(queries, threshold, beam)
    keep = np.einsum("ij,ij->i", queries[q], exact[node]) >= threshold
    return q[keep], node[keep], int((hit & truth).sum()), int(truth.sum())


def _matrix(rows: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row, and ``audited_recall``: of all links that audits knew of,
    the share that the graphs found (1 if there was none).

    Vectors of one label and one length are linked if their cosine is ``threshold`` or more. Null labels,
    null and zero vectors and vectors with null or non-finite components are linked with nothing; so
    are rows with a null id, which have a null component and are kept. Rows that repeat are linked with
    each other as other vectors are. An empty table gives no rows; only the named columns are read.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "hnsw")
    own = columns_as(vectors, vec_id=id_col, vector=vector_col, label=label_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), "label")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = own.select("vec_id", "vector", "label", F.when(usable, F.xxhash64("label", F.size("vector"), "vector")).alias("node"))
    marks = work.table(rows, "rows")
    nodes = marks.where("node is not null").groupBy("node", "label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = work.table(nodes.withColumn("length", F.size("vector")), "nodes")
    sizes = nodes.groupBy("label", "length").agg(F.ceil(F.count("*") / SHARD).alias("shards"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = nodes.join(sizes, ["label", "length"]).select("node", "vector", "label", "length", F.pmod(F.xxhash64("node", F.lit(1)), "shards").alias("shard"), F.pmod(F.xxhash64("node", F.lit(2)), "blocks").alias("block"))
    kind = nodes.schema["label"].dataType.simpleString()

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        exact = _matrix(group["vector"])
        held = pickle.dumps((group["node"].to_numpy(), exact, Graph(exact)))
        return pd.DataFrame({"label": [group["label"].iloc[0]], "length": [group["length"].iloc[0]], "shard": [group["shard"].iloc[0]], "graph": [held]})

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        held = pickle.dumps((group["node"].to_numpy(), _matrix(group["vector"])))
        return pd.DataFrame({"label": [group["label"].iloc[0]], "length": [group["length"].iloc[0]], "block": [group["block"].iloc[0]], "queries": [held]})

    graphs = work.table(dealt.groupBy("label", "length", "shard").applyInPandas(build, f"label {kind}, length int, shard long, graph binary"), "graphs")
    blocks = work.table(dealt.groupBy("label", "length", "block").applyInPandas(pack, f"label {kind}, length int, block long, queries binary"), "blocks")
    # A shard's graph comes first, its blocks of queries follow it one by one; it is sent once for GROUP blocks.
    group = F.floor(F.col("block") / GROUP)
    asked = blocks.join(graphs.select("label", "length", "shard"), ["label", "length"]).select("label", "length", "shard", group.alias("part"), "block", F.col("queries").alias("held"))
    each = blocks.select("label", "length", group.alias("part")).distinct()
    sent = graphs.join(each, ["label", "length"]).select("label", "length", "shard", "part", F.lit(-1).cast("long").alias("block"), F.col("graph").alias("held"))
    keys = ["label", "length", "shard", "part"]
    tasks = sent.unionByName(asked).repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "block")

    def search(batches):
        own = exact = net = None
        for batch in batches:
            for block, held in zip(batch["block"], batch["held"], strict=True):
                if block < 0:
                    own, exact, net = pickle.loads(held)
                    continue
                asked, wanted = pickle.loads(held)
                at = np.searchsorted(own, asked).clip(max=len(own) - 1)  # a shard's nodes are in order
                q, node, found, true = audited_links(net, exact, wanted, threshold, np.where(own[at] == asked, at, -1))
                a, b = asked[q], own[node]
                yield pd.DataFrame({"a": np.minimum(a, b)[a != b], "b": np.maximum(a, b)[a != b], "found": 0, "true": 0})
                yield pd.DataFrame({"a": [0], "b": [0], "found": [found], "true": [true]})

    rows = work.table(tasks.select("block", "held").mapInPandas(search, "a long, b long, found long, true long").groupBy("a", "b").agg(F.sum("found").alias("found"), F.sum("true").alias("true")), "links")
    links, audit = rows.where("a <> b").select("a", "b"), rows.where("a = b")
    recall = audit.agg(F.coalesce(F.try_divide(F.sum("found"), F.sum("true")), F.lit(1.0)).cast("double").alias("audited_recall"))
    copies = nodes.select("node", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(copies.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("linked")).select(F.col("a").alias("node"), "linked")
    found = components(links, work)
    group = nodes.join(found, "node", "left").join(degree, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    group = work.table(group, "groups")
    least = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = marks.select("vec_id", "node").join(group.join(least, "component").select("node", "n_links", "component_id"), "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out.join(F.broadcast(recall), F.lit(True))  # one row
