"""Operator 10, toxicity by weak supervision.

Voters are lexicons and patterns: fixed word lists, lexicons of words and of word beginnings mined from
labelled training rows, sums of such words' odds over several bounds, address, and a few patterns of tone.
A generative label model turns their votes into posterior labels: by expectation-maximisation over
labelled and unlabelled training rows it estimates, for the hidden label, the prior and how often each
voter fires given the label and given the vote of the one voter that it depends on most (the tree of the
strongest pairwise dependences). Gold labels choose the voters and, by their odds, the words and word beginnings that the
classifier sees, and tell which side is toxic; they are no targets. A linear classifier over those is trained on
the posteriors, and scores every whole document.

Contract: `per_class` bounds the labelled sample, and twice as many rows the unlabelled one; no row of either is
held out. A null or empty text has no features and scores the classifier's base rate. Without labelled rows of
both classes every score is 0. A null doc_id counts as a training row that carries no label. Repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import packed, remainder, unpacked
from ripplefold.llm.labelled import labelled_sample, unlabelled_sample
from ripplefold.llm.words import Block, mixed, text_blocks

PER_CLASS = 2000
PREFIX = 5
FEATURES = 3000
MINED_VOTERS = 12
MOST_FALSE = 0.01
# Insulting words, by kind.
LEXICONS = {
    "mind": "idiot moron stupid imbecile fool dumb cretin dummkopf idiota imbécile estúpido tonto blöd crétin",
    "worth": "worthless loser pathetic clown useless failure versager wertlos perdedor inútil nul minable",
    "disgust": "scum trash disgusting filth garbage vermin vile abschaum müll dreck basura asqueroso ordure dégoûtant",
}


def _by_text(words: str) -> np.ndarray:
    data = " ".join(words.split()).encode()
    return np.unique(Block(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes())


ADDRESS = _by_text("you your you're du dich dein ihr euch tu toi ton vous tú ti vosotros usted")  # fixed values: words of address


def terms_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word or word beginning) for all words, and per text the shares of shouted words, of those with an exclamation and of address."""
    doc = np.repeat(np.arange(len(block.counts)), block.counts)
    upper, sign = np.zeros(256, np.int64), np.zeros(256, np.int64)
    upper[65:91] = 1
    sign[ord("!")] = 1
    size = np.maximum(block.counts, 1)
    hashed = block.hashes()
    marks = [block.sums(upper) > 1, block.sums(sign) > 0, np.isin(hashed, ADDRESS)]
    tone = np.stack([np.bincount(doc, x, len(block.counts)) / size for x in marks], 1)
    return np.concatenate([doc, doc]), np.concatenate([hashed, mixed(block.hashes(prefix=PREFIX), np.uint64(4242))]), tone


def _term_rows(batches):
    for batch, block in text_blocks(batches, 1_500_000):
        doc, term, tone = terms_of(block)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(batch) + 1))
        rows = [packed(np.unique(term[order[a:b]]), tone[i]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])


def mined_terms(terms: list[np.ndarray], y: np.ndarray, least: int = 3, certain: float = 12.0) -> tuple[np.ndarray, np.ndarray]:
    """Terms found in at least so many sample texts, with their smoothed log odds between the classes; only those whose
    likelihood ratio against equal shares is `certain`: a term that clean texts never hold needs few toxic ones at any sample size."""
    def counted(label):
        mine = [t for t, v in zip(terms, y) if v == label]
        return np.unique(np.concatenate(mine), return_counts=True) if mine else (np.empty(0, np.uint64), np.empty(0, np.int64))

    (t1, n1), (t0, n0) = counted(1), counted(0)
    every = np.union1d(t1, t0)
    pos, neg = np.zeros(len(every)), np.zeros(len(every))
    pos[np.searchsorted(every, t1)] = n1
    neg[np.searchsorted(every, t0)] = n0
    share = y.mean()
    odds = np.log((pos + share) / (y.sum() + 1)) - np.log((neg + 1 - share) / ((1 - y).sum() + 1))
    part = lambda n, expected: np.where(n > 0, n * np.log(np.maximum(n, 1) / expected), 0.0)
    ratio = 2 * (part(pos, (pos + neg) * share) + part(neg, (pos + neg) * (1 - share)))
    keep = (pos + neg >= least) & (ratio >= certain)
    return every[keep], odds[keep]


class LabelModel:
    """Posterior of a hidden binary label from votes (1 fires, 0 doesn't), without any gold label.

    Given the label, a voter depends on at most one other, its parent: the tree that gathers most mutual information
    given the label. Tables of firing rates and the prior come from expectation-maximisation, started from the number of votes.
    """

    def __init__(self, votes: np.ndarray, rounds: int = 30) -> None:
        v = votes.astype(int)
        # of voters that nearly always go together only the first counts for the start
        rest = votes - votes.mean(0)
        spread = np.sqrt((rest * rest).mean(0)) + 1e-9
        together = rest.T @ rest / len(v) / spread[:, None] / spread[None, :]
        first = v[:, ~(np.triu(together, 1) > 0.9).any(0)]
        p = np.where(first.sum(1) >= max(2, first.shape[1] // 5), 0.9, np.where(v.any(1), 0.4, 0.02))
        self.parent = [-1] * v.shape[1]
        for i in range(rounds):
            if i in (1, 10):
                self.parent = self._tree(v, p)
            self.prior = float(np.clip(p.mean(), 1e-3, 0.5))
            self.rates = []
            for k, parent in enumerate(self.parent):
                up = v[:, parent] if parent >= 0 else np.zeros(len(v), int)
                table = np.zeros((2, 2))  # by label and the parent's vote: how often it fires
                for label, weight in enumerate((1 - p, p)):
                    fires, seen = np.bincount(up, weight * v[:, k], 2), np.bincount(up, weight, 2)
                    overall = (fires.sum() + 0.5) / (seen.sum() + 1)
                    table[label] = (fires + 2 * overall) / (seen + 2)
                self.rates.append(np.clip(table, 1e-4, 1 - 1e-4))
            p = self.posterior(v)

    @staticmethod
    def _tree(v: np.ndarray, p: np.ndarray) -> list[int]:
        """For each voter its parent, -1 for the first: Prim's algorithm over mutual information given the label."""
        m = v.shape[1]
        gain = np.zeros((m, m))
        for weight in (1 - p, p):
            total = weight.sum() + 4
            both = (v * weight[:, None]).T @ v
            one = np.diag(both)
            cells = [(both, one[:, None], one[None, :], 1, 1), (one[:, None] - both, one[:, None], one[None, :], 1, 0), (one[None, :] - both, one[:, None], one[None, :], 0, 1), (weight.sum() - one[:, None] - one[None, :] + both, one[:, None], one[None, :], 0, 0)]
            for n, a, b, x, y in cells:
                pa_, pb = ((a if x else weight.sum() - a) + 2) / total, ((b if y else weight.sum() - b) + 2) / total
                share = (np.maximum(n, 0) + 1) / total
                gain += total * share * np.log(share / (pa_ * pb))
        parent, inside = [-1] * m, {0}
        while len(inside) < m:
            best = max(((gain[i, j], i, j) for i in inside for j in range(m) if j not in inside), default=None)
            parent[best[2]] = best[1]
            inside.add(best[2])
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(int)
        z = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for k, (parent, rates) in enumerate(zip(self.parent, self.rates)):
            up = v[:, parent] if parent >= 0 else np.zeros(len(v), int)
            fires, silent = np.log(rates[1] / rates[0])[up], np.log((1 - rates[1]) / (1 - rates[0]))[up]
            z += np.where(v[:, k] == 1, fires, silent)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def linear_fit(rows: list[np.ndarray], width: int, target: np.ndarray, passes: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets over presence features, by full-batch gradients with momentum scaling."""
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b, seen = np.zeros(width), 0.0, np.full(width, 1e-3)
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6))
    for _ in range(passes):
        z = np.bincount(who, w[at], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance / len(rows)
        grad = np.bincount(at, g[who], width) + decay * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
        b -= rate * g.sum()
    return w, b


class Model:
    """The features in sorted order, their weights, and the base rate."""

    def __init__(self, rows: list[bytes], y: np.ndarray) -> None:
        """rows: the feature rows of the texts with the labels y, and those of texts without labels after them."""
        parts = [unpacked(x) for x in rows]
        terms, tone = [p[0] for p in parts], np.array([p[1] for p in parts])
        found, odds = mined_terms(terms[: len(y)], y)
        telling = odds > 1.0
        best = np.argsort(-odds, kind="stable")[: FEATURES // 10]
        best = found[best[odds[best] > 2.0]]
        groups = [best[i::MINED_VOTERS] for i in range(MINED_VOTERS)]
        lexicons = [_by_text(words) for words in LEXICONS.values()] + [g for g in groups if len(g)]
        votes = [[np.isin(t, lex, assume_unique=True).any() for lex in lexicons] for t in terms]
        sums = np.array([odds[telling & np.isin(found, t, assume_unique=True)].sum() for t in terms])  # long texts hold more of all others
        votes = np.concatenate([np.array(votes, float), sums[:, None] > np.array([2.5, 5.0, 9.0]), tone > np.array([0.2, 0.2, 0.0])], 1)
        # a voter that fires for no text, for too many clean ones, or is none for the toxic side, is left out
        rate = lambda label: (votes[: len(y)][y == label].sum(0) + 0.5) / ((y == label).sum() + 1)
        votes = votes[:, (votes.sum(0) > 0) & (rate(1) > 1.5 * rate(0)) & (rate(0) < MOST_FALSE)]
        posterior = LabelModel(votes).posterior(votes) if votes.shape[1] else np.full(len(votes), 0.02)
        if len(set(y.tolist())) == 2 and posterior[: len(y)][y == 1].mean() < posterior[: len(y)][y == 0].mean():
            posterior = 1 - posterior
        strong = np.argsort(-np.abs(odds), kind="stable")[:FEATURES]
        self.terms = np.unique(np.concatenate([found[strong], *lexicons]))
        self.weights, self.base = linear_fit([np.flatnonzero(np.isin(self.terms, t, assume_unique=True)) for t in terms], len(self.terms), posterior)

    @classmethod
    def restored(cls, terms: np.ndarray, weights: np.ndarray, base: np.ndarray):
        """From the arrays that were broadcast."""
        model = cls.__new__(cls)
        model.terms, model.weights, model.base = terms, weights, float(base[0])
        return model

    def score(self, block: Block) -> np.ndarray:
        doc, term, _ = terms_of(block)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        pair = np.unique(doc[hit] * np.int64(len(self.terms)) + at[hit])
        z = np.bincount(pair // len(self.terms), self.weights[pair % len(self.terms)], len(block.counts)) + self.base
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scores(sent):
    def run(batches):
        model = Model.restored(*sent.value) if sent.value else None
        for batch, block in text_blocks(batches):
            score = model.score(block) if model is not None else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.select([c for c in batch.schema.names if c != "text"]).columns, pa.array(score)], [*[c for c in batch.schema.names if c != "text"], "score"])

    return run


def _fit(table: pa.Table) -> pa.Table:
    """The classifier from the bounded sample, or no row where a class lacks labels."""
    table = table.sort_by("doc_id")
    labelled, rest = table.filter(table.column("label").is_valid()), table.filter(table.column("label").is_null())
    y, blobs = labelled.column("label").to_numpy().astype(np.int64), []
    if len(np.unique(y)) == 2:
        model = Model([*labelled.column("x").to_pylist(), *rest.column("x").to_pylist()], y)
        blobs.append(packed(model.terms, model.weights, np.array([model.base])))
    return pa.table({"model": pa.array(blobs, pa.binary())})


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, modulus: int = 5, held_out: int = 0) -> tuple | None:
    """The classifier's arrays; one task fits them from at most 4 * per_class rows, so that no text's features reach the driver."""
    schema = "doc_id long, label int, x binary"
    known = labelled_sample(docs, labels, "toxic", modulus, held_out, per_class, _term_rows, schema)
    rows = known.unionByName(unlabelled_sample(docs, labels, modulus, held_out, 2 * per_class, _term_rows, schema))
    found = rows.groupBy().applyInArrow(_fit, "model binary").first()
    return unpacked(found["model"]) if found else None


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fitted(docs, labels, modulus=modulus, held_out=held_out)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "text")
    scored = texts.mapInArrow(_scores(sent), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _kept(sent, threshold: float):
    def run(batches):
        model = Model.restored(*sent.value) if sent.value else None
        for batch, block in text_blocks(batches):
            yield batch if model is None else batch.filter(pa.array(model.score(block) < threshold))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    model = fitted(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*(c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)))  # names without dots, which are read as paths
    return plain.mapInArrow(_kept(sent, threshold), plain.schema).toDF(*docs.columns)
