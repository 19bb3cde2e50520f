"""Operators over embeddings against brute force: links of tight clusters, whitening, hard negatives."""

import numpy as np
import pytest
from oracle import differences, views

from ripplefold.llm import box_tree, cover_tree, embedding_dedup, hard_negatives, queries, whitening
from ripplefold.llm.common import Forest

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<double>, x string, row long, length string, n long"


def table(spark, rows):
    """(vec_id, label, vector) with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, label, None if v is None else [None if c is None else float(c) for c in v], "a", 1, "b", 2) for i, label, v in rows], VECTORS).repartition(3)


def two_clusters(length, each, wide, seed=1):
    """Two tight clusters whose directions are a little over the angle of cosine 0.9 apart, so that some pairs link."""
    rnd = np.random.default_rng(seed)
    a, b = np.linalg.qr(rnd.normal(size=(length, 2)))[0].T
    angle = np.arccos(0.9) + 2e-4
    centres = [a, np.cos(angle) * a + np.sin(angle) * b]
    x = np.concatenate([c + rnd.normal(size=(each, length)) * wide / length**0.5 for c in centres])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_links(x):
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("length,each,wide", [(64, 300, 4e-4), (1024, 150, 4e-4), (64, 300, 1e-9), (8, 400, 0.2)])
def test_no_link_is_lost(length, each, wide):
    x = two_clusters(length, each, wide)
    near, n, names = brute_links(x), len(x), list(range(len(x)))
    forest = Forest()
    counts, _ = cover_tree.link_near(x, x, True, 0.9, np.ones(n, np.int64), np.ones(n, np.int64), names, names, forest)
    assert (counts == near.sum(1)).all() and near.sum() > 0
    half = n // 2
    a, b = cover_tree.link_near(x[:half], x[half:], False, 0.9, np.ones(half, np.int64), np.ones(n - half, np.int64), names[:half], names[half:], Forest())
    assert (a == near[:half, half:].sum(1)).all() and (b == near[:half, half:].sum(0)).all()


@pytest.mark.parametrize("block", [12_288, 64])
def test_tight_clusters_through_the_operator(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x = two_clusters(64, 300, 4e-4)
    near = brute_links(x)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table(spark, [(i, 0, v) for i, v in enumerate(x)])).collect()}
    assert sum(n for n, _ in got.values()) == near.sum() > 2 * 300 * 299
    assert got == {i: (int(near[i].sum()), 0) for i in range(600)}


def brute_whitening(rows, most=4):
    """By length, what the fit gives."""
    out = {}
    good = [(i, np.floor(256 * np.array(v, float))) for i, _, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for length in {len(x) for _, x in good} - {0}:
        fit = np.array(sorted({tuple(x) for _, x in good if len(x) == length}))
        mean = fit.mean(0)
        e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
        order = [j for j in np.argsort(-e, kind="stable")[:most] if e[j] > 1e-12 * e.max()]
        out[length] = (len(fit), fit.sum(0), mean, e[order], v[:, order], e.sum())
    return good, out


def check_whitening(got, rows):
    good, fits = brute_whitening(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by, key=str) == sorted({i for i, x in good if len(x) in fits and len(fits[len(x)][3])}, key=str)
    signs = {}
    for i, x in good:
        n, sums, mean, e, v, trace = fits.get(len(x), (0, 0, 0, [], 0, 0))
        own = [r for r in by.get(i, []) if r.n == n] if len(e) else []
        assert {r.component for r in own} == set(range(1, len(e) + 1))
        for r in own:
            c, want = r.component - 1, ((x - mean) @ v[:, r.component - 1]) / e[r.component - 1] ** 0.5
            assert r.deviation == sum(int(n * a - s) ** 2 for a, s in zip(x, sums))
            assert abs(r.explained / (e[c] / trace) - 1) < 1e-6 and r.identity_error < 1e-6
            if abs(want) > 1e-3:
                signs.setdefault((len(x), c), set()).add(r.whitened * want > 0)
            assert abs(abs(r.whitened) - abs(want)) < 1e-7
    assert all(len(s) == 1 for s in signs.values())


def test_whitening(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(90, 6)) * [1, 0.5, 2, 0.1, 0.7, 3]
    rows = [(i, 0, v) for i, v in enumerate(base)] + [(i + 200, 0, base[0]) for i in range(40)] + [(300, 1, None), (301, 1, [float("nan")] * 6), (302, 1, [1.0, None, 0, 0, 0, 0]), (303, 1, [float("inf")] * 6)]
    check_whitening(whitening.whitened(table(spark, rows)).collect(), rows)
    assert whitening.whitened(table(spark, [])).count() == 0


def test_whitening_of_flat_data(spark):
    """Directions without variance, vectors of unlike lengths, one vector alone, null ids, sums that doubles can't hold."""
    rnd = np.random.default_rng(5)
    flat = rnd.normal(size=(50, 3)) @ rnd.normal(size=(3, 12))
    flat = np.round(rnd.normal(size=(50, 2)) * 4) @ np.round(rnd.normal(size=(2, 7)) * 3)  # whole numbers, rank 2
    rows = [(i, 0, v) for i, v in enumerate(flat)] + [(500 + i, 0, v) for i, v in enumerate(rnd.normal(size=(30, 3)))] + [(700, 0, [1.0, 2.0]), (701, 0, [1.0, 2.0]), (702, 0, [])]
    got = whitening.whitened(table(spark, rows)).collect()
    check_whitening(got, rows)
    assert {r.component for r in got if r.vec_id < 100} == {1, 2} and not [r for r in got if r.vec_id >= 700]
    wide = [(None, 0, [1e6, 0.0]), (None, 0, [-1e6, 1.0]), (3, 0, [0.0, 5.0])]
    check = whitening.whitened(table(spark, wide)).collect()
    assert len(check) == 6 and {r.deviation for r in check if r.vec_id == 3} == {(3 * 1280 - 1536) ** 2}


def test_whitening_of_the_given_table(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whitening(spark, SF).collect(), rows)


def brute_negatives(rows, every=50, positives=5, negatives=3):
    good = [(i, label, [int(np.floor(256 * c)) for c in v]) for i, label, v in rows if label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for k, (i, label, a) in enumerate(good):
        if i is None or i % every:
            continue
        scored = [(sum(p * q for p, q in zip(a, b)), j, other == label) for m, (j, other, b) in enumerate(good) if m != k and len(b) == len(a)]
        for ps, p, _ in sorted((s for s in scored if s[2]), key=key)[:positives]:
            window = [s for s in scored if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps]
            out += [(i, p, r + 1, j, ps, ns) for r, (ns, j, _) in enumerate(sorted(window, key=key)[:negatives])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,slab,leaf", [(8192, 1024, 256), (40, 3, 8)])
def test_hard_negatives(spark, block, slab, leaf, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SLAB", slab)
    monkeypatch.setattr(box_tree.BoxTree.__init__, "__defaults__", (leaf, 4))
    rnd = np.random.default_rng(7)
    x = np.round(rnd.normal(size=(400, 5)) + 1, 1)
    x[100:220] = x[50]  # a large group of copies, with ties
    rows = [(i, int(rnd.integers(0, 3)), v) for i, v in enumerate(x)] + [(50, 1, x[3]), (50, 1, x[3]), (None, 0, x[3]), (None, 1, x[4])]
    rows += [(1000, None, x[0]), (1050, 1, None), (1100, 1, [1.0, None, 0, 0, 0]), (1150, 1, [float("inf")] * 5), (1200, 0, [1.0, 2.0]), (1201, 0, [1.0, 2.5]), (1202, 1, [0.5, 1.6]), (1250, 7, [3.0]), (1300, 7, [1e8, 1e8, 0.0]), (1301, 7, [1e5, 1.0, 0.0]), (1302, 8, [6e4, 1.0, 0.0])]
    from pyspark.sql import functions as F

    got = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = brute_negatives(rows)
    assert sorted(map(tuple, got), key=str) == want and {w[0] for w in want} >= {0, 50, 100, 1200, 1300}
    assert hard_negatives.hard_negatives(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_hard_negatives_sql(spark, tmp_path):
    assert differences(queries.QUERIES["op12_hard_negatives"](spark, SF), views(SF), queries.ORACLE_SQL["op12_hard_negatives"]) == ""
    rnd = np.random.default_rng(8)
    rows = [(int(rnd.integers(0, 120)), int(rnd.integers(0, 10)) if k % 9 else None, rnd.normal(size=4).round(1) + 0.7 if k % 8 else None) for k in range(240)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    assert differences(got, views(str(tmp_path)), queries.ORACLE_SQL["op12_hard_negatives"]) == ""
