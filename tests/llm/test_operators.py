"""Operators against brute force, exact round trips and held-out labels, with nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns whose names clash with the operators' own."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quantspan.llm import bpe, components, decontaminate, hnsw, linededup, neardup, quality, sharding, shared, substrings, toxicity, warc
from quantspan.llm.shared import Workspace

CLASH = "doc_id long, text string, part int, node long, u long, row string, kept string"


def frame(spark, rows, schema="doc_id long, text string"):
    """The rows with extra columns named as operators name their own."""
    plain = spark.createDataFrame(rows, schema)
    return plain.selectExpr("*", "1 as part", "2L as node", "3L as u", "'r' as row", "'k' as kept", "0 as shard", "'z' as label")


def texts(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts with exact and near copies, shared passages, nulls, empty and very long ones."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    line = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    block = [line(9) for _ in range(6)]
    out = [(None, line(30)), (1, None), (2, ""), (3, " \n\n "), (4, "x"), (5, line(6000)), (6, "ab" * 900)]
    for k in range(7, n):
        lines = [line(rnd.randint(3, 12)) for _ in range(rnd.randint(1, 9))]
        if k % 3 == 0:
            lines[rnd.randrange(len(lines) + 1) : 0] = block
        if k % 7 == 0 and out[-1][1]:
            w = out[-1][1].split(" ")
            w[rnd.randrange(len(w))] = "changed"
            out.append((k, " ".join(w)))
        elif k % 11 == 0:
            out.append((k, out[-2][1]))
        else:
            out.append((k, "\n".join(lines)))
    return out + [out[-1], (9, "same id, other text " * 60)]


def test_sharding_is_minimax(spark):
    rows = texts()
    got = sharding.minimax_shards(frame(spark, rows), shards=5).toPandas()
    assert len(got) == len(rows) and got.columns.tolist() == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    groups: dict = {}
    for i, t in rows:
        first, size = groups.get(t or "", (None, 0))
        groups[t or ""] = (min((x for x in (first, i) if x is not None), default=None), size + len((t or "").encode()) + 1)
    sizes = [s for _, s in sorted(groups.values(), key=lambda g: (g[0] is not None, g[0] or 0))]

    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= 5

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    assert got.groupby("shard")["size"].sum().max() <= least and set(got.shard) <= set(range(5))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    by_text = collections.defaultdict(set)
    for r in got.itertuples():
        by_text[(r.text_crc32, r.size)].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.minimax_shards(frame(spark, []), shards=5).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "a\nb", "x" * 1000), (2, None, "x" * 1000), (2, None, "x" * 1000), (None, "u", None), (5, "u", ""), (6, "ü", "é" * 70_001), (7, "u", "é" * 70_001)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "0L as uid", "1 as sha1")
    got = warc.warc_round_trip(pages, chunk_bytes=100).toPandas()
    assert len(got) == len(rows)
    key = lambda r: (int(r.page_id) if r.page_id == r.page_id else -1, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to == r.refers_to else None)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    x, e, none = b"x" * 1000, ("é" * 70_001).encode(), b""
    want = [(-1, 0, sha(none), "revisit", 5), (1, 1000, sha(x), "response", None), (2, 1000, sha(x), "revisit", 1), (2, 1000, sha(x), "revisit", 1), (5, 0, sha(none), "response", None), (6, len(e), sha(e), "response", None), (7, len(e), sha(e), "revisit", 6)]
    assert sorted(map(str, map(key, got.itertuples()))) == sorted(map(str, want))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    kept = warc.warc_round_trip(pages, min_bytes=2000).where("record_type = 'revisit'").toPandas()
    assert kept.page_id.tolist() == [7]
    work = Workspace(spark, "test")
    root, manifest = warc.write_archives(pages, work, chunk_bytes=1000)
    chunks = warc.read_archives(root, manifest, with_data=True).where("page_id = 6").orderBy("chunk_no").toPandas()
    assert b"".join(chunks.data) == e and chunks["last"].tolist()[-1]


def test_bpe_equals_the_library(spark):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    odd = ["a" * 5000, "é" * 3000, "=" * 900 + "<|endoftext|>", "日本語\u0000\n\n  x" * 40, "x²½\x1c\x1f y z  ", "word " * 300_000]
    rows = [*texts(), *enumerate(odd, 100), *((200 + k, "".join(rnd.choice("ab é1²_ .\n日") for _ in range(200))) for k in range(50))]
    got = bpe.bpe_decode(bpe.bpe_encode(frame(spark, rows), path, tokenizers.PATTERN), path).toPandas()
    have = sorted((r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got.itertuples())
    want = sorted((len(i := library.encode_ordinary(t or "")), np.array(i, "<u4").tobytes(), (t or "").encode()) for _, t in rows)
    assert have == want
    assert bpe.bpe_encode(frame(spark, []), path, tokenizers.PATTERN).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rows = texts(2)
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as starts", "3 as window"), window=3).toPandas()
    first: dict = {}
    place = lambda r: 1 << 62 if r[0] is None else r[0]
    split = lambda t: [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    for r in rows:
        at = split(r[1])
        for p in range(len(at) - 2):
            key = tuple(x for _, x in at[p : p + 3])
            first[key] = min(first.get(key, 1 << 63), place(r))
    want = []
    for r in rows:
        at, gone, seen = split(r[1]), set(), set()
        for p in range(len(at) - 2):
            key = tuple(x for _, x in at[p : p + 3])
            if first[key] < place(r) or key in seen:
                gone.update(k for k, _ in at[p : p + 3])
            seen.add(key)
        want.append((r[0], r[1] if not gone else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone), len(gone)))
    have = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.kept_text, r.n_removed) for r in got.itertuples()]
    assert sorted(map(str, have)) == sorted(map(str, want)) and sum(w[2] for w in want) > 20
    assert linededup.line_dedup(frame(spark, [])).count() == 0


def test_long_lines_equal_brute_force(spark):
    """One and two lines of many words are repeats too, also in documents that have no third line."""
    rnd, least = random.Random(9), 12
    long = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(k)) for k in (12, 13, 11, 7, 6, 5)] + ["字" * 40, "字" * 20]
    rows = texts(2) + [(100 + k, "\n".join(rnd.choice(long) for _ in range(1 + k % 5))) for k in range(60)] + [(None, long[0]), (9, long[0])]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as spans", "3 as lines"), window=3, least_words=least).toPandas()
    place = lambda r: 1 << 62 if r[0] is None else r[0]
    size = lambda x: max(len(x.split()), len(x.encode()) // 8)

    def spans(t):
        at = [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip()]
        for p in range(len(at)):
            for k in (1, 2, 3):
                key = tuple(x for _, x in at[p : p + k])
                if len(key) == k and (k == 3 or sum(map(size, key)) >= least):
                    yield key, {x for x, _ in at[p : p + k]}

    first: dict = {}
    for r in rows:
        for key, _ in spans(r[1]):
            first[key] = min(first.get(key, 1 << 63), place(r))
    want, short = [], 0
    for r in rows:
        gone, seen = set(), set()
        for key, lines in spans(r[1]):
            if first[key] < place(r) or key in seen:
                gone |= lines
                short += len(key) < 3
            seen.add(key)
        runs = sum(k - 1 not in gone for k in gone) if "\n\n" not in (r[1] or "") else None
        want.append((r[0], r[1] if not gone else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone), len(gone), runs))
    have = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.kept_text, r.n_removed, r.n_runs if "\n\n" not in (r.text or "") else None) for r in got.itertuples()]
    assert sorted(map(str, have)) == sorted(map(str, want)) and short > 50


@pytest.mark.parametrize("length, reaches", [(60, (24, 5, 1)), (substrings.LENGTH, substrings.REACHES)])
def test_repeated_strings_equal_brute_force(spark, length, reaches):
    rows = texts(3)
    shared = rows[5][1]
    rows += [(200 + k, f"{'x' * k}{shared[100 * k : 100 * k + 380 + 15 * k]}{'y' * k}") for k in range(9)]
    got = substrings.remove_repeats(frame(spark, rows), length=length, reaches=reaches).toPandas()
    counts = collections.Counter(d[p : p + length] for d in ((t or "").encode() for _, t in rows) for p in range(len(d) - length + 1))
    want = []
    for i, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if counts[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    have = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.itertuples()]
    assert sorted(map(str, have)) == sorted(map(str, want)) and sum(w[2] for w in want) > 1000
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def sets(rows, width):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = texts(4)
    for k in range(60):  # copies around the threshold of one another
        w = list(base)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        rows.append((1000 + k, " ".join(w)))
    got = neardup.near_duplicates(frame(spark, rows), shingle_words=width).toPandas()
    s, parent = sets(rows, width), {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    want = [(None if i is None else i, len(x), None if i is None else find(i) if x else i) for (i, _), x in zip(rows, s, strict=True)]
    have = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.n_shingles, None if r.component_id != r.component_id else int(r.component_id)) for r in got.itertuples()]
    assert sorted(map(str, have)) == sorted(map(str, want)) and len({w[2] for w in want}) < len(rows) - 20
    assert (got.kept == [(r.doc_id == r.component_id) or r.doc_id != r.doc_id for r in got.itertuples()]).all()
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}}


def test_search_finds_all_above_the_threshold_and_leaks(spark, monkeypatch):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    item = lambda n: " ".join(rnd.choice(words[:40] if rnd.random() < 0.5 else words) for _ in range(n))
    items = [(k, item(rnd.randint(3, 40))) for k in range(120)]
    for threshold in (0.2, 0.6):
        index = decontaminate.Index(items, 5, threshold)
        for _ in range(60):
            terms = rnd.sample(range(len(index.words)), 80)
            scores = collections.Counter()
            for t in terms:
                for k, x in zip(index.postings[t].items, index.postings[t].impacts, strict=True):
                    scores[k] += x
            assert {k for k, _ in index.search(terms)} == {k for k, x in scores.items() if x >= threshold}
    benchmark = spark.createDataFrame([*((k, t) for k, t in items if len(t.split()) >= 12), (900, None), (901, "")], "item_id long, text string")
    long = [(k, t) for k, t in items if len(t.split()) >= 20]
    rows = [(1, None), (2, ""), (3, item(50)), (4, f"{item(200)} {long[0][1]} {item(150)}"), (5, f"{long[1][1].upper()}!"), (5, f"{long[1][1].upper()}!"), (6, " ".join(long[2][1].split()[:8]))]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, rows), benchmark).collect()}
    assert found == {(4, long[0][0]), (5, long[1][0])}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), benchmark).collect()) == [1, 2, 3, 6]
    assert decontaminate.find_leaks(frame(spark, rows), benchmark.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "zz top hit"), (2, "unseen words"), (3, " ".join(f"v{k}" for k in range(300)))], "item_id long, text string")
    rows = [(1, f"{item(200)} Zz top, hit! {item(90)}"), (2, "top zz hit"), (3, f"{item(70)} " + " ".join(f"v{k}" for k in range(300)) + f" {item(700)}"), (4, "hit " * 50_000)]
    want = {(1, 1), (3, 3)}
    found = decontaminate.find_leaks(frame(spark, rows), short).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)  # scores do not depend on the blocks
    parted = decontaminate.find_leaks(frame(spark, rows), short).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in parted) == sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in found)
    assert decontaminate.decontaminate(frame(spark, []), benchmark).count() == 0


def labelled(spark, n: int = 400):
    rnd = random.Random(8)
    rows, labels = [(n + 1, None), (n + 2, ""), (n + 1, None), (None, "some words")], [(n + 5, None, None), (1, None, 0)]
    for k in range(n):
        good, toxic = k % 3 != 0, k % 5 == 0
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 6))) for _ in range(rnd.randint(10, 60))]
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["zzoloz", "qvequxx"]) + rnd.choice("ab")
        rows.append((k, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((k, int(good), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("of, label", [(quality.quality_scores, 1), (toxicity.toxicity_scores, 2)])
def test_classifiers_on_held_out_rows(spark, of, label):
    docs, labels, known = labelled(spark)
    got = of(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    truth = {r[0]: r[label] for r in known if r[label] is not None}
    held = got[got.held_out & got.doc_id.isin(truth)]
    assert all(zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held.doc_id) and len(held) > 50
    assert (held.predicted == [truth[int(i)] for i in held.doc_id]).mean() > 0.93
    assert of(docs.limit(0), labels).count() == 0 and of(docs, labels.limit(0)).count() == len(got)


def test_dual_descent_equals_projected_gradient():
    """The same dual problem, solved by plain projected gradient steps."""
    rng = np.random.default_rng(12)
    rows = [np.unique(rng.integers(0, 25, rng.integers(2, 8))).astype(np.int32) for _ in range(60)]
    values = [rng.uniform(0.2, 1, len(r)).astype(np.float32) for r in rows]
    y = np.array([int(rng.random() < (0.8 if 3 in r or 7 in r else 0.3)) for r in rows])
    cost = np.full(60, 0.7)
    x = np.zeros((60, 26))
    for k, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[k, r], x[k, 25] = v, 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    gram, alpha = (x * sign[:, None]) @ (x * sign[:, None]).T, np.zeros(60)
    for _ in range(20_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, cost)
    want = (alpha * sign) @ x
    w, bias = quality.dual_descent(rows, values, y, cost, 3000)
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    got = np.append(w[:25], bias)
    assert not w[25:].any() and primal(got) <= primal(want) * 1.001 and np.abs(got - want).max() < 0.05
    ratio = quality.log_ratios(rows, y)
    for f in range(25):
        n = [sum(f in r for r, v in zip(rows, y, strict=True) if v == c) for c in (0, 1)]
        size = [(y == 0).sum(), (y == 1).sum()]
        assert ratio[f] == pytest.approx(np.log((n[1] / size[1] + 1 / 60) / (n[0] / size[0] + 1 / 60)))


def test_ordinal_fit_equals_plain_descent():
    """The penalised likelihood that plain descent by numeric slopes reaches is not below the fitted one by much."""
    rng = np.random.default_rng(13)
    keys, n, penalty = np.arange(100, 108), 80, 3e-3
    rows = [np.flatnonzero(rng.random(8) < 0.4).astype(np.int32) for _ in range(n)]
    force = np.array([2.0, 1.0, 0, 0, -1.0, 0, 0.5, 0])
    y = np.array([int(force[r].sum() + rng.logistic() > 0.5) for r in rows])
    dense = np.array([max(0.0, force[r].sum() + rng.normal()) for r in rows])
    cuts = np.quantile(dense[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (dense[:, None] > cuts).sum(1), 0)
    has = np.zeros((n, 8))
    for k, r in enumerate(rows):
        has[k, r] = 1

    def loss(w, theta):
        if (np.diff(theta) <= 0).any():
            return np.inf
        below = 1 / (1 + np.exp(-(np.concatenate([[-np.inf], theta, [np.inf]])[None, :] - (has @ w)[:, None])))
        return -np.log(below[np.arange(n), grade + 1] - below[np.arange(n), grade]).mean() + penalty * np.abs(w).sum()

    model = toxicity.fit_rows(rows, dense, y, keys, penalty=penalty, steps=4000)
    own = np.array([model.weight.get(int(k), 0.0) for k in keys])
    v, rate = np.concatenate([np.zeros(8), [0.0, 1.0, 2.0]]), 0.5
    best = loss(v[:8], v[8:])
    for _ in range(600):
        slope = np.array([(loss(*np.split(v + 1e-6 * e, [8])) - loss(*np.split(v - 1e-6 * e, [8]))) / 2e-6 for e in np.eye(11)])
        while rate > 1e-12 and not loss(*np.split(v - rate * slope, [8])) <= best:
            rate /= 2
        if rate <= 1e-12:
            break
        v, best, rate = v - rate * slope, loss(*np.split(v - rate * slope, [8])), rate * 1.5
    assert (np.diff(model.thresholds) > 0).all()
    assert loss(own, model.thresholds) <= best + 0.01
    assert own[0] > own[1] > 0 > own[4]


def test_training_rows_are_bounded_after_the_join(spark):
    """Labels without a document take no place, and rows that share an id count once."""
    from quantspan.llm.tokens import training_rows

    docs = spark.createDataFrame([(k % 40, f"text {k % 40}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(-200, 40)], "doc_id long, quality int")
    got = training_rows(docs, labels, "quality", 10, Workspace(spark, "test")).collect()
    assert len(got) == 10 and len({r["text"] for r in got}) == 10


def test_blocks_of_open_buckets(spark, monkeypatch):
    """Small blocks, so that block meets block: the result is that of one block."""
    rnd = random.Random(14)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rnd.randint(1, 7)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(40)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle_words=2).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 5)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle_words=2).collect()} == want


def test_severity_is_ordered():
    model = toxicity.Model({}, np.array([1.0, 2.0, 4.0]))
    reach = model.at_least(2.5)
    assert (np.diff(reach) < 0).all() and model.at_least(9.0).sum() > reach.sum()


@pytest.mark.parametrize("shard", [60, 5000])
def test_embedding_links_equal_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "BLOCK", 64)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    x = [centres[k % 12] + rng.normal(size=16) * (0.05 + 0.02 * (k % 9)) for k in range(300)]
    rows = [(k, [float(v) for v in x[k]], k % 2) for k in range(300)]
    rows += [(300, rows[5][1], 1), (300, rows[5][1], 1), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] + [1.0] * 15, 1), (305, rows[5][1], None), (None, rows[5][1], 1), (306, [1.0, 2.0], 1), (307, [], 0), (308, [1e-200] * 16, 0), (309, [1e200] * 16, 0)]
    got = hnsw.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as shard")).toPandas()
    usable = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links, parent = collections.Counter(), {r[0]: r[0] for r in rows if r[0] is not None}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    unit = [np.array(r[1]) / np.abs(r[1]).max() for r in usable]
    unit = [u / np.linalg.norm(u) for u in unit]
    for a in range(len(usable)):
        for b in range(len(usable)):
            if a != b and usable[a][2] == usable[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[usable[a][0], a] += 1
                p, q = find(usable[a][0]), find(usable[b][0])
                parent[max(p, q)] = min(p, q)
    n_links = collections.defaultdict(list)
    for k, r in enumerate(usable):
        n_links[r[0]].append(links[r[0], k])
    for r in got.itertuples():
        if r.vec_id == r.vec_id:
            assert r.component_id == find(int(r.vec_id)) and r.n_links in n_links.get(int(r.vec_id), [0])
        else:
            assert r.n_links == 0 and r.component_id != r.component_id and r.kept
    assert sum(links.values()) > 500 and len(got) == len(rows) and got.audited_recall.between(hnsw.RECALL, 1).all()


def test_graph_recall():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 24))
    x = np.concatenate([c + rng.normal(size=(20, 24)) * 0.12 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, node, found, true = hnsw.audited_links(hnsw.Graph(x), x, x, 0.93, np.arange(len(x)))
    truth = int((x @ x.T >= 0.93).sum())
    assert len(q) >= 0.98 * truth and len(set(zip(q.tolist(), node.tolist(), strict=True))) == len(q)
    assert true >= hnsw.LINKS and found >= hnsw.RECALL * true
    lonely = np.eye(24)
    assert hnsw.audited_links(hnsw.Graph(lonely), lonely, lonely, 0.93, np.arange(24))[2:] == (0, 0)


def test_workers_are_sent_few_rows_and_give_memory_back(spark, monkeypatch):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, 10_000)
        rows = [(k, f"line {k % 7}\n" * 4) for k in range(3 * shared.ROWS_AT_ONCE)]
        out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
        assert out.count() == len(rows) and int(spark.conf.get(setting)) == shared.ROWS_AT_ONCE
        sizes = spark.range(0, len(rows), 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").toPandas().n
        assert sizes.sum() == len(rows) and sizes.max() <= shared.ROWS_AT_ONCE
        spark.conf.set(setting, 50)
        Workspace(spark, "batches")
        assert int(spark.conf.get(setting)) == 50
    finally:
        spark.conf.set(setting, before)

    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))
    assert list(shared.released(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and calls == [1]
    with pytest.raises(ZeroDivisionError):
        list(shared.released(lambda batches: (1 // x for x in batches))(iter([1, 0])))
    assert calls == [1, 1]
    kind, wrapped = type(spark.range(0)), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, way=kind.mapInArrow: wrapped.append(hasattr(f, "__wrapped__")) or way(self, f, *a))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    nodes = neardup.marks(docs, 2).selectExpr("doc_id as node", "sig")
    neardup.sets_of(docs, 2), neardup.signature_keys(nodes), linededup.line_dedup(docs)
    assert len(wrapped) == 5 and all(wrapped)
