"""Operator 6, document quality by nearest-neighbour voting in a latent-semantic space.

Texts become weighted counts of hashed words, of word shapes (letter cases, digits, symbols, repeats of
the word before) and of common signs; a singular-value decomposition over a bounded sample of labelled
training rows gives the latent axes. The labelled vectors of that sample are broadcast (a fixed size);
every document takes exact blocked cosine products with all of them, and its nearest neighbours vote with
the square of their similarity as weight. Of neighbours that are equally near at the last place any may vote.

Contract: `per_class` bounds the labelled sample; its labels come from rows that aren't held out. An empty
or null text scores 0. Without labelled rows of both classes every score is the known class (or 0.5). A
null doc_id counts as a training row that carries no label. Repeated rows give repeated results; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import remainder
from ripplefold.llm.labelled import labelled_sample
from ripplefold.llm.words import Block, mixed, text_blocks

WORD_BINS, SHAPE_BINS = 768, 768
AXES = 48
PER_CLASS = 1500
NEIGHBOURS = 15


def _classes() -> list[np.ndarray]:
    tables = [np.zeros(256, np.int64) for _ in range(6)]
    tables[0][97:123] = tables[1][65:91] = tables[2][48:58] = tables[3][128:] = 1
    for c in b"#*$%&|<>@^~=+_\\/{}[]":
        tables[4][c] = 1
    for c in b"!?.,;:'\"()-":
        tables[5][c] = 1
    return tables


TABLES = _classes()


def features(block: Block) -> np.ndarray:
    """One row of log counts per text: hashed words, then hashed shapes."""
    hashed = block.hashes()
    doc = np.repeat(np.arange(len(block.counts)), block.counts)
    rough = [np.digitize(block.sums(t), (1, 2, 4, 9)) for t in TABLES]
    again = np.zeros(len(hashed), np.int64)
    again[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    shape = again
    for r in rough:
        shape = shape * 5 + r
    shape_bin = (mixed(shape.astype(np.uint64), np.uint64(3)) % np.uint64(SHAPE_BINS)).astype(np.int64)
    word_bin = (hashed % np.uint64(WORD_BINS)).astype(np.int64)
    n = len(block.counts)
    width = WORD_BINS + SHAPE_BINS
    counts = np.bincount(np.concatenate([doc * width + word_bin, doc * width + WORD_BINS + shape_bin]), minlength=n * width).reshape(n, width).astype(np.float32)
    size = np.maximum(block.counts, 1)[:, None]
    # shares rather than counts, so that a long text is like a short one
    return np.sqrt(counts / size).astype(np.float32)


def _feature_rows(batches):
    for batch, block in text_blocks(batches, 1_000_000):
        rows = [x.tobytes() for x in features(block)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])


class Model:
    """Latent axes, the labelled vectors, and the vote."""

    def __init__(self, x: np.ndarray, y: np.ndarray, neighbours: int = NEIGHBOURS) -> None:
        seen = (x > 0).sum(0)
        # shapes are few and telling: they weigh as much as all words together
        self.weight = np.log((1 + len(x)) / (1 + seen)).clip(0.2, 4).astype(np.float32)
        self.weight[WORD_BINS:] *= 3
        z = x * self.weight
        self.mean = z.mean(0)
        gram = (z - self.mean).T @ (z - self.mean)
        _, axes = np.linalg.eigh(gram.astype(np.float64))
        self.axes = axes[:, ::-1][:, :AXES].astype(np.float32)
        self.known, self.label, self.neighbours = self.latent(x), y.astype(np.float32), neighbours

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    @classmethod
    def restored(cls, state: dict | None):
        """From the plain arrays that were broadcast."""
        if state is None:
            return None
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def score(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        out = []
        k = min(self.neighbours, len(self.known))
        for i in range(0, len(x), block):
            cos = self.latent(x[i : i + block]) @ self.known.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 1e-3) ** 2
            out.append((w * self.label[near]).sum(1) / w.sum(1))
        return np.concatenate(out) if out else np.empty(0)


def _scores(sent, constant: float):
    def run(batches):
        model = Model.restored(sent.value)
        for batch, block in text_blocks(batches, 1_500_000):
            x = features(block)
            score = model.score(x).astype(np.float64) if model is not None else np.full(len(batch), constant)
            score[block.counts == 0] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.3, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = sorted(labelled_sample(docs, labels, "quality", modulus, held_out, per_class, _feature_rows, "doc_id long, label int, x binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], np.int64)
    model = Model(np.array([np.frombuffer(r["x"], np.float32) for r in rows]), y) if len(set(y.tolist())) == 2 else None
    sent = docs.sparkSession.sparkContext.broadcast(model and vars(model))
    texts = docs.select("doc_id", "text", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"))
    scored = texts.mapInArrow(_scores(sent, float(y.mean()) if len(y) else 0.5), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
