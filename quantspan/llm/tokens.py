"""Sparse n-gram features of whole texts, shared by the text classifiers.

A worker maps each token to a small code once and remembers it; n-grams are then made by numpy from the
codes. The table of remembered tokens is emptied when full.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, released

REMEMBERED = 300_000
#: Hashed words, hashed word pairs, and hashed n-grams of token shapes.
WORDS = PAIRS = 1 << 19
SHAPES = 1 << 16
FEATURES = WORDS + PAIRS + SHAPES


class Table(dict):
    """Token codes by a rule, remembered."""

    def __init__(self, rule: Callable[[str], int]):
        super().__init__()
        self.rule = rule

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[token] = self.rule(token)
        return code


def shape(token: str) -> str:
    """Letter case or kind of the token, and the marks it ends with."""
    body = token.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    end = token[len(body) :][:4]
    if not body:
        return "mark" + end
    if body.isdigit():
        return "number" + end
    kind = "upper" if body.isupper() and len(body) > 1 else "title" if body[:1].isupper() and body[1:].islower() | (len(body) == 1) else "lower" if body.islower() else "mixed"
    return kind + end


def word(token: str) -> str:
    """The token in lower case without the marks around it."""
    return token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()


def token_code(token: str) -> int:
    """Hash of the word and hash of the shape in one integer."""
    return zlib.crc32(word(token).encode()) << 16 | zlib.crc32(shape(token).encode()) & 0xFFFF


def ngram_features(text: str, table: Table) -> np.ndarray:
    """Distinct features: words, word pairs, and one to three token shapes in a row, where a token that
    repeats the one before it has a shape of its own."""
    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.int32)
    code = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
    words, shapes = code >> 16, code & 0xFFFF
    shapes[1:] += 0x10000 * (words[1:] == words[:-1])
    found = [words % WORDS]
    if len(code) > 1:
        found.append(WORDS + (words[:-1] * 0x5BD1E995 + words[1:] & 0x7FFFFFFFFFFF) * 0x9E3779B1 % (1 << 61) % PAIRS)
    row = shapes * 0x9E3779B1 & 0xFFFFFFFF
    found.append(WORDS + PAIRS + row % SHAPES)
    for _ in range(2):
        if len(row) < 2:
            break
        row = (row[:-1] * 0x85EBCA6B + shapes[-len(row) + 1 :] + 1) * 0xC2B2AE35 & 0xFFFFFFFF
        found.append(WORDS + PAIRS + row % SHAPES)
    return np.unique(np.concatenate(found)).astype(np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, work: Workspace) -> DataFrame:
    """At most ``rows`` labelled documents that may be learnt from: ``label, text``, written as a table.

    Those with crc32(doc_id as text) mod 4 = 2 are held out. The rest are taken in the order of a hash
    of their id, so that the sample does not depend on how the tables are stored. Labels without a
    document take no place; of rows that share an id, one text is learnt from; an id with both labels
    has a place for each.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1) and crc32(cast(doc_id as string)) % 4 <> 2")
    marks = docs.select("doc_id", F.xxhash64("text").alias("mark")).where("doc_id is not null").groupBy("doc_id").agg(F.min("mark").alias("mark"))
    sample = marks.join(usable.distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(F.broadcast(sample), ["doc_id", "mark"])  # ``rows`` ids at most
    return work.table(found.groupBy("doc_id", "label").agg(F.first("text").alias("text")).select("label", "text"), "sample")


def scored(docs: DataFrame, score: Callable[[], Callable[[str], tuple]], fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """``doc_id`` and what ``score()`` makes of each whole text; ``score`` is called once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [of(x or "") for x in part.column(1).to_pylist()]
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=pa.schema([part.schema.field(0), *fields]))

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ddl}")
