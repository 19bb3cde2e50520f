"""The evaluators of patterns agree with each other and with Python's regular expressions."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from ripplefold.operators import chunks as K
from ripplefold.operators import patterns as Q

SYMBOLS = "sfo"
PATTERNS = [
    Q.seq(Q.one("s"), Q.star(Q.but("f")), Q.one("f")),
    Q.contains(Q.one("s"), Q.one("f")),
    Q.star(Q.alt(Q.one("s"), Q.seq(Q.one("f"), Q.anyone()))),
    Q.EMPTY,
    Q.alt(Q.one("s"), Q.seq(Q.star(Q.anyone()), Q.one("o"), Q.but("o"))),
]


@pytest.mark.parametrize("pattern", PATTERNS, ids=Q.regex)
def test_automaton_is_the_regex(pattern):
    table, accepting = Q.automaton(pattern, SYMBOLS)
    for n in range(6):
        for word in itertools.product(SYMBOLS, repeat=n):
            state = 0
            for c in word:
                state = table[state][SYMBOLS.index(c)]
            assert accepting[state] == bool(re.fullmatch(Q.regex(pattern), "".join(word)))


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_evaluators_agree(spark, chunk, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", chunk)
    words = ["sof", "sff", "", "ososf", "oof", "fs", "s", "sssof"]
    rows = [(k, i, c) for k, w in enumerate(words) for i, c in enumerate(w)]
    df = spark.createDataFrame(rows, "k int, pos int, c string")
    for pattern in PATTERNS:
        want = {k: bool(re.fullmatch(Q.regex(pattern), w)) for k, w in enumerate(words) if w}
        for found in (Q.match(df, ["k"], ["pos"], F.col("c"), pattern), Q.match_by_fold(df, ["k"], ["pos"], F.col("c"), pattern, SYMBOLS), K.match_chunked(df, ["k"], ["pos"], F.col("c"), pattern, SYMBOLS)):
            assert {r["k"]: r["matched"] for r in found.collect()} == want
