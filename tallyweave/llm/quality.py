"""Quality scores by votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import (SPACED, WordBatch, arrow_map, byte_rule, documents, gram_hashes,
                                   mixed, word_batches)

#: Hashed terms (the first half for shapes, the second for words), what words weigh beside shapes,
#: latent dimensions, neighbours that vote, labelled documents kept at most.
TERMS, WORD_SHARE, RANK, VOTES, MAX_LABELLED = 4096, 0.35, 48, 30, 3000
_HALF = np.uint64(TERMS // 2)
_PLAIN = byte_rule(b"\x20\x09\x0a\x0b\x0c\x0d", False)


def _shape_rule() -> tuple[np.ndarray, np.ndarray]:
    """Letters read as a or A, digits as 0, every other mark as itself."""
    inside, read = byte_rule(b"\x20\x09\x0a\x0b\x0c\x0d", False)
    read[65:91], read[97:123], read[48:58], read[128:] = 65, 97, 48, 97
    return inside, read


_SHAPE = _shape_rule()


def _shapes(words: WordBatch) -> WordBatch:
    """The same words as shapes: runs of one kind of character are written once."""
    data = _SHAPE[1][words.data]
    keep = np.ones(len(data), bool)
    keep[1:] = data[1:] != data[:-1]
    keep[words.edges[words.edges < len(data)]] = True
    edges = np.concatenate([[0], np.cumsum(keep)])[words.edges]
    return WordBatch(data[keep], edges, _PLAIN)


def term_counts(words: WordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each text: word shapes, pairs of shapes, word lengths, how much of it are
    repeated runs and words that echo the word before, and the words themselves and their pairs."""
    shapes = _shapes(words).hashes
    size = np.minimum(words.ends - words.starts, 40).astype(np.uint64)
    pairs = mixed(shapes[:-1] * np.uint64(3) + shapes[1:]) if len(shapes) else shapes
    runs, two = gram_hashes(words.hashes, 4), gram_hashes(words.hashes, 2)
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if a == b:
            yield np.empty(0, np.int64), np.empty(0)
            continue
        own = np.concatenate([shapes[a:b], pairs[a:b - 1], mixed(size[a:b] + np.uint64(77))])
        said = np.concatenate([words.hashes[a:b], two[a:b - 1]])
        terms, counts = np.unique(np.concatenate([own % _HALF, _HALF + said % _HALF]),
                                  return_counts=True)
        part = runs[a:b - 3]
        fresh = len(np.unique(part)) / len(part) if len(part) > 0 else 1.0
        echo = float((words.hashes[a + 1:b] == words.hashes[a:b - 1]).mean()) if b - a > 1 else 0.0
        again = mixed(np.array([1000 + int(10 * (1 - fresh)), 2000 + int(10 * echo)],
                               np.uint64)) % _HALF
        yield (np.concatenate([terms, again]).astype(np.int64),
               np.concatenate([counts, [b - a, b - a]]).astype(float))


@dataclass
class VoteModel:
    """Term weights, projection, and the labelled vectors that vote."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> VoteModel:
        """Latent space of the labelled documents by a randomised singular value decomposition."""
        matrix = np.zeros((len(rows), TERMS), np.float32)
        for i, (terms, counts) in enumerate(rows):
            np.add.at(matrix[i], terms, np.log1p(counts))
        weights = np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 0.1
        weights[TERMS // 2:] *= WORD_SHARE
        matrix = _unit(matrix * weights)
        rng = np.random.default_rng(7)
        basis = rng.standard_normal((TERMS, min(RANK + 12, TERMS))).astype(np.float32)
        for _ in range(3):
            basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
        _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
        projection = (basis @ right.T[:, :RANK]).astype(np.float32)
        labels = np.array(labels, np.float32)
        return cls(weights, projection, _unit(matrix @ projection), labels,
                   float(labels.mean()) if len(labels) else 0.5)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        out = np.full(len(rows), self.base)
        filled = [i for i, (terms, _) in enumerate(rows) if len(terms)]
        if not len(self.labels) or not filled:
            return out
        latent = np.zeros((len(filled), self.projection.shape[1]), np.float32)
        for j, i in enumerate(filled):
            terms, counts = rows[i]
            v = np.log1p(counts).astype(np.float32) * self.weights[terms]
            latent[j] = v @ self.projection[terms]
        near = _unit(latent) @ self.vectors.T  # exact cosine with every labelled vector
        votes = min(VOTES, near.shape[1])
        last = np.partition(near, near.shape[1] - votes, axis=1)[:, -votes, None]
        # equal similarities at the last place share what is left of the votes
        first, same = near > last, near == last
        share = (votes - first.sum(axis=1)) / same.sum(axis=1)
        for j, i in enumerate(filled):
            at = np.flatnonzero(first[j] | same[j])
            weight = np.maximum(near[j, at], 0).astype(float) ** 8 + 1e-9
            weight[same[j, at]] *= share[j]
            out[i] = weight @ self.labels[at] / weight.sum()
        return np.clip(out, 0, 1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _terms_of(column: pa.Array) -> Iterator[tuple[int, list]]:
    for row, words in word_batches(column, SPACED):
        yield row, list(term_counts(words))


def fit_votes(df: DataFrame, id_col: str, text_col: str, labelled: DataFrame,
              max_labelled: int = MAX_LABELLED) -> VoteModel:
    """Model from ``labelled`` (id, label 0 or 1).

    At most ``max_labelled`` of its ids are used, those with the least hashes, so that the model
    broadcast later has a fixed bound; their texts become term counts on the executors.
    """
    chosen = (labelled.where("id is not null and label is not null")
              .groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    known = [(r["id"], int(r["label"])) for r in chosen.collect()]
    ids = df.sparkSession.createDataFrame(known, "id long, label int")
    texts = documents(df, id_col, text_col).join(F.broadcast(ids), "id")

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row, rows in _terms_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(rows)), batch.column(2).slice(row, len(rows)),
                     pa.array([t.astype(np.int16).tobytes() for t, _ in rows], pa.binary()),
                     pa.array([c.astype(np.float32).tobytes() for _, c in rows], pa.binary())],
                    ["id", "label", "terms", "counts"])
        return work
    rows = (arrow_map(texts.select("id", "text", "label"),
                      "id long, label int, terms binary, counts binary", make)
            .orderBy(F.xxhash64("id"), "id", "terms").limit(max_labelled).collect())
    return VoteModel.fit([(np.frombuffer(r["terms"], np.int16).astype(np.int64),
                           np.frombuffer(r["counts"], np.float32).astype(float)) for r in rows],
                         [r["label"] for r in rows])


def quality_scores(df: DataFrame, id_col: str, text_col: str, model: VoteModel,
                   threshold: float = 0.3) -> DataFrame:
    """One row per document: id, score (0 to 1, higher for label 1), predicted (1 from
    ``threshold`` on).

    Every whole text becomes a vector of hashed terms, is projected into the latent space, and
    compared exactly, in blocks, with all labelled vectors; the nearest vote with their
    similarity, and equal ones at the last place share its vote. The model has at most MAX_LABELLED vectors, so the broadcast does not grow.

    Cases: texts that are null or without words get the share of label 1 among the labelled (0.5
    without any); repeated rows score alike; an empty table gives an empty result; further columns
    are not looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row, rows in _terms_of(batch.column(1)):
                score = shared.value.score(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(rows)), pa.array(score),
                     pa.array((score >= threshold).astype(np.int32))],
                    ["id", "score", "predicted"])
        return work
    return arrow_map(documents(df, id_col, text_col), "id long, score double, predicted int", make)


def keep_quality(df: DataFrame, text_col: str, model: VoteModel,
                 threshold: float = 0.3) -> DataFrame:
    """Rows of ``df``, all columns as they are, whose text scores ``threshold`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row, rows in _terms_of(batch.column(at)):
                keep = shared.value.score(rows) >= threshold
                yield batch.slice(row, len(rows)).filter(pa.array(keep))
        return work
    return arrow_map(df, df.schema, make)
