"""Substring deduplication against brute force and SQL: repeats in one text and over texts, nulls, short and very long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import differences, views

from ripplefold.llm import queries, substring_dedup

DOCS = "doc_id long, text string, row string, seed long, start int, kept string"


def brute(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    windows = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - width + 1) if windows[tuple(w[i : i + width])] > 1 for j in range(width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    vocabulary = ["the", "a", "é", "中文", "İ", "A", "x y"] + ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    some = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    line, other = some(40), some(36)
    out = [(0, None), (1, ""), (2, " \n\t\x0b "), (3, "one two"), (4, some(34)), (4, some(35))]
    out += [(10 + i, some(rnd.randint(0, 90)) + rnd.choice([" ", "\n", "\r\n"]) + line + " " + some(rnd.randint(0, 90))) for i in range(60)]  # one passage everywhere, its edges differ
    out += [(100 + i, some(50) + " " + other[: rnd.randint(60, len(other))] + " " + some(50)) for i in range(12)]
    base = some(300).split()
    for i in range(8):  # near copies
        copy = list(base)
        for _ in range(3):
            copy[rnd.randrange(300)] = "changed"
        out.append((200 + i, " ".join(copy)))
    out += [(300, "same " * 200), (301, "a b " * 100), (302, line + " " + line), (303, some(20_000)), (303, "x" * 9000)]
    out += [(None, base[0] + " " + some(60))] * 3 + [(305, some(33) + " tail")] * 2 + [(306, some(35))] * 2
    return out


@pytest.mark.parametrize("width,seed", [(35, 12), (8, 3)])
def test_against_brute_force(spark, rows, width, seed):
    docs = spark.createDataFrame([(i, t, "clash", 1, 2, "clash") for i, t in rows], DOCS).repartition(5)
    got = substring_dedup.without_repeats(docs, width, seed).collect()
    want = sorted(((str(i), *w) for (i, _), w in zip(rows, brute([t for _, t in rows], width))), key=str)
    assert sorted(((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got), key=str) == want
    text = {r.row: re.findall(r"[^\x20\x09-\x0D]+", next(t for i, t in rows if i == r.doc_id and len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) == r.n_words) or "") for r in got if r.doc_id is not None and sum(i == r.doc_id for i, _ in rows) == 1}
    for r in got:  # every factor stands at its source too
        for f in r.factors:
            assert f.length >= width and (f.source, f.source_start) != (r.row, f.start)
            if r.row in text and f.source in text:
                assert text[r.row][f.start : f.start + f.length] == text[f.source][f.source_start : f.source_start + f.length]
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


def test_least_of_each():
    x = np.random.default_rng(1).integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 5, 24):
        assert substring_dedup.least_of_each(x, width).tolist() == [i + int(x[i : i + width].argmin()) for i in range(len(x) - width + 1)]


def test_sql(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "clash", 1, 2, "clash") for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        assert differences(queries.QUERIES["op13_substring_dedup"](spark, sf), views(sf), queries.ORACLE_SQL["op13_substring_dedup"]) == ""


def test_digest(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "clash", 1, 2, "clash") for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(i), w[0], w[1], hashlib.sha256(w[2].encode()).hexdigest()) for (i, _), w in zip(rows, brute([t for _, t in rows], 35)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in queries.op13_substring_dedup(spark, str(tmp_path)).collect()) == want
