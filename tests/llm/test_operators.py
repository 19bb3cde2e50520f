"""The corpus operators against brute force on small tables with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import inspect
import random
import re
import zlib

import numpy as np
import pytest
from oracle import differences, views

from ripplefold.llm import bpe_tree, common, embedding_dedup, html_text, jaccard_join, lm_score, packing, quality_knn, quality_rules, queries, secret_scan, toxicity
from ripplefold.llm.bpe_words import WordCodes, tokenizer, vocabulary
from ripplefold.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, node string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = ["the", "of", "and"] + ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (None, "no id here " * 30), (5, "x" * 5000), (5, "x" * 5000)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([8, 60, 400]))] for _ in range(25)]
    for i, b in enumerate(base):
        for k in range(rnd.choice([1, 2, 5])):
            c = list(b)
            for _ in range(k // 2):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            out.append((100 + 10 * i + k, " ".join(c) + ("\nsame line\nsame line" if k == 1 else "")))
    out.append((900, "password = 'abcdef123' at 10.1.2.3 and AKIA" + "Z9" * 9 + " " + "a1" * 14 + " token=x token: yyyyyy"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_lm_base(docs, rows, none):
    got = lm_score.score_documents(docs).collect()
    learns = [zlib.crc32(str(i).encode()) % 7 != 2 if i is not None else True for i, _ in rows]
    counts = {}
    for (i, t), use in zip(rows, learns):
        for w in [*words(low(t)), "</end>"] if use else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(words(t)) + 1, sum(counts.get(w, 0) > 0 for w in [*words(low(t)), "</end>"]), round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*words(low(t)), "</end>"]), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_score.score_documents(none).count() == 0


def test_filter_counts():
    keys = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    counts = np.random.default_rng(2).integers(1, 500, 4000)
    seg = lm_score.filter_segment(keys, counts, 16.0, 10**9).tobytes()
    found = lm_score.LogFrequencyFilter(seg, [len(seg)]).counts(keys)
    exact = lm_score.count_of(lm_score.level_of(counts))
    assert (found >= exact).all() and (found == exact).mean() > 0.9


def test_filter_has_no_cap(docs, rows):
    """Scores of a filter with many bits an entry are those of exact quantised counts, whatever bound it can be given."""
    bound = {"max_filter_mb": 0.004} if "max_filter_mb" in inspect.signature(lm_score.score_documents).parameters else {}
    got = lm_score.score_documents(docs, bits_per_entry=256.0, **bound).collect()
    one, two = {}, {}
    texts = [(i, [*words(low(t)), "</end>"]) for i, t in rows]
    for i, w in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            for a, b in zip(["</end>", *w], w):
                one[b], two[a, b] = one.get(b, 0) + 1, two.get((a, b), 0) + 1
    n, v = sum(one.values()), len(one)
    level = lambda c: lm_score.level_of(np.array([c]))
    least = lambda c: float(lm_score.count_of(level(c))[0]) if c else 0.0
    most = lambda c: float(lm_score.most_of(level(c))[0]) if c else 0.0
    want = []
    for i, w in texts:
        total = 0.0
        for a, b in zip(["</end>", *w], w):
            own = (least(one[b]) - 0.75) / n if one.get(b) else 0.75 * v / n / (v + 1)
            total += np.log10((min(least(two.get((a, b), 0)), least(one.get(b, 0)), most(one.get(a, 0))) + 200.0 * own) / (most(one.get(a, 0)) + 200.0))
        want.append((str(i), round(total, 6)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted(want)


def test_probabilities_sum_to_one():
    """After each token of a small corpus, over all known tokens and as many unknown ones (and one more)."""
    rnd = random.Random(5)
    tokens = [rnd.choice("abcdefgh") if rnd.random() < 0.9 else "end" for _ in range(400)]
    one, two = {}, {}
    for a, b in zip(["end", *tokens], tokens):
        one[b], two[a, b] = one.get(b, 0) + 1, two.get((a, b), 0) + 1
    n, v = len(tokens), len(one)
    quantised = lambda f, c: float(f(lm_score.level_of(np.array([c])))[0]) if c else 0.0
    known = {w: float(lm_score.alone(np.array([quantised(lm_score.count_of, c)]), n, v)[0]) for w, c in one.items()}
    unknown = float(lm_score.alone(np.zeros(1), n, v)[0])
    for a in [*one, "unseen"]:
        before = quantised(lm_score.most_of, one.get(a, 0))
        total = sum(lm_score.after(quantised(lm_score.count_of, two.get((a, b), 0)) if before else 0.0, before, p, 5.0) for b, p in known.items())
        total += (v + 1) * lm_score.after(0.0, before, unknown, 5.0)
        assert 0.6 < total <= 1 + 1e-9


def test_nonsense_scores_below_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**9 + i, " ".join(f"zq{i}x{k}" for k in range(200))) for i in range(20)], "doc_id long, text string")
    rows = [r for r in lm_score.score_documents(docs.unionByName(odd)).collect() if r.held_out and r.n_tokens > 60]
    per = lambda keep: [r.score / r.n_tokens for r in rows if keep(r)]
    assert max(per(lambda r: r.doc_id >= 10**9)) < np.median(per(lambda r: r.doc_id < 10**9)) - 0.5


def test_squeezed_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 5000, np.uint64))
    for b in range(7):
        mine = keys[lm_score.bucket_of(keys, 7) == b]
        assert (lm_score.restored(lm_score.squeezed(mine, 7), 7, b) == mine).all()
    assert not len(lm_score.restored(lm_score.squeezed(keys[:0], 7), 7, 3))


def test_full_segment_ends():
    keys = np.arange(10, dtype=np.uint64)
    assert (lm_score.LogFrequencyFilter(b"\xff" * 8, [8], 3).counts(keys) == lm_score.count_of(np.array([3]))).all()


def repeats(w):
    seen, cover = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(j for i in at for j in (i, i + 1, i + 2))
    return len(cover)


def test_quality_base(docs, rows, none):
    got = quality_rules.judged(docs).collect()
    want = []
    for i, t in rows:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeats(w)))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(want)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert quality_rules.judged(none).count() == 0


def test_repeats_of_a_very_long_text(spark):
    """Over 2^20 words: only the windows that come twice count, not those whose hashes are alike in some bits."""
    w = [f"w{i}" for i in range(1_600_000)] + ["w7", "w8", "w9"]
    text = " ".join(w)
    got = quality_rules.judged(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert (got.n_words, got.n_repeat_words) == (len(w), 6)


def linked(sets, num, den):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(sets))]


def test_jaccard_tasks_are_bounded(spark):
    """Members of small groups are dealt to more tasks as their sets grow."""
    members = spark.range(4000).selectExpr("id as node", "id div 2 as grp", "100000L as n", "1 as band")
    dealt = jaccard_join._small_tasks(members)
    most = dealt.groupBy("task").sum("n").agg({"sum(n)": "max"}).first()[0]
    assert dealt.count() == 4000 and most <= 5_000_000
    assert dealt.groupBy("grp").agg({"task": "min"}).count() == dealt.select("grp", "task").distinct().count()


@pytest.mark.parametrize("leaf", [1024, 2])
def test_jaccard(docs, rows, none, leaf, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    got = jaccard_join.join_documents(docs).collect()
    sets = []
    for _, t in rows:
        w = words(low(t))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    label = linked(sets, 85, 100)
    least = {}
    for (i, _), g in zip(rows, label):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = sorted((str(i), len(s), str(least[g] if s else i)) for (i, _), s, g in zip(rows, sets, label))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert jaccard_join.join_documents(none).count() == 0


@pytest.mark.parametrize("per_task", [500_000, 9])
def test_components(spark, per_task, monkeypatch):
    monkeypatch.setattr(common, "LINKS_PER_TASK", per_task)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu one</a></nav><div class='ad'>Buy the best of the things.</div><article><h1>Head &amp; line</h1><p>The  text of\nthe first part is <b>here</b> and it goes on for a while to be long.<p>Short.</article><div class=comments><p>I think that the text of this is good and that it is so for all.</p></div><footer>&copy; the end</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(df).collect()}
    text = "Head & line\nThe text of the first part is here and it goes on for a while to be long.\nShort."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("", 0)}


def test_secrets(docs, rows, none):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in sorted(spans))
        want.append((str(i), *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    got = secret_scan.scan_documents(docs).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    assert "endpoint:" in next(r.spans for r in got if r.doc_id == 900)
    clean = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    assert "abcdef123" not in clean[900] and "AKIA" not in clean[900] and clean[3] == "One two" and clean[0] is None
    assert secret_scan.scan_documents(none).count() == 0


def digests(codec, text):
    ids = codec.encode(text or "", add_special_tokens=False).ids
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), codec.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("leaf", [16384, 37])
def test_bpe(docs, rows, none, leaf):
    codec = tokenizer(vocabulary())
    want = sorted((str(i), *digests(codec, t)) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in bpe_tree.encode_documents(docs, leaf_chars=leaf).collect()) == want
    assert bpe_tree.encode_documents(none).count() == 0


def test_bpe_joins():
    codec, codes, rnd = tokenizer(vocabulary()), WordCodes(vocabulary()), random.Random(8)
    for _ in range(600):
        alphabet = rnd.choice(["ab", "abcé ", "!'s ab", "ñß日本 ́e", "12ab'", "a=\u0338<>| ", "é.É, ll'"])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 400)))
        leaf = rnd.choice([3, 17, 60])
        data, parts, at = text.encode(), [], 0
        for i in range(0, len(text), leaf):
            n = len(text[i : i + leaf].encode())
            parts.append(bpe_tree.encoded(codes, data, at, at + n))
            at += n
        assert bpe_tree.tree(codes, data, parts).ids.tolist() == codec.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(docs, rows, none):
    codec = tokenizer(vocabulary())
    pieces = packing.pack_documents(docs).collect()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        at = 0
        for p in s:
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    want = sorted((str(i), len(codec.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows if i != 5)
    got = {}
    for p in pieces:
        got.setdefault(str(p.doc_id), []).append(p)
    assert sorted((k, sum(p.length for p in v)) for k, v in got.items() if k != "5") == want
    for i, t in rows:
        ids = np.array([*codec.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p in got[str(i)]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("block", [12_288, 16])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(60, 8))
    x = [*base, *(base[:20] + rnd.normal(size=(20, 8)) * 0.15), *([base[0]] * 5)]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8)]
    rows += [(300, [1.0, 2.0]), (301, [2.0, 4.0]), (302, [1e300, 2e300]), (303, [3.0]), (None, [-1.0, 1.0]), (305, [-1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = linked([{i} for i in range(len(x))], 1, 1)
    label = list(range(len(x)))
    for _ in x:
        label = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    want = {i: (int(near[i].sum()), label[i], label[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in (*range(200, 204), 303)}
    want |= {300: (2, 300, True), 301: (2, 300, False), 302: (2, 300, False), 305: (1, 305, True), None: (1, 305, True)}
    assert got == want
    odd = spark.createDataFrame([(7, [1.0, 0.0], "a", "b", 3), (7, [1.0, 0.0], "a", "b", 3)], "vec_id long, embedding array<float>, name string, length string, m long")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(odd).collect()] == [(7, 1, 7, True)] * 2
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def against_sql(spark, tmp_path, query, table, df):
    """Differences between a registered query and its SQL on a table of our own."""
    df.write.parquet(f"{tmp_path}/{table}.parquet")
    return differences(queries.QUERIES[query](spark, str(tmp_path)), views(str(tmp_path)), queries.ORACLE_SQL[query])


@pytest.mark.parametrize("query", ["op2_quality_rules", "op3_jaccard_join", "op5_secret_scan"])
def test_sql_on_odd_rows(spark, docs, none, tmp_path, query):
    assert against_sql(spark, tmp_path / "rows", query, "documents", docs.coalesce(1)) == ""
    assert queries.QUERIES[query](spark, str(tmp_path / "rows")).count() == docs.count()


@pytest.mark.parametrize("query", sorted(queries.ORACLE_SQL))
def test_sql_on_given_rows(spark, query):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[query](spark, sf), views(sf), queries.ORACLE_SQL[query]) == ""


def test_long_weak_secrets(spark, tmp_path):
    """An opaque token is linked on either side of an access identifier, however long it is; and not beyond the reach."""
    key, token = "AKIA" + "Q7" * 9, "Zk9" * 200
    far = "word " * 60
    rows = [(1, f"{token} x {key}"), (2, f"{key} x {token}"), (3, f"{key} {far}{token}"), (4, token), (5, f"{token} {key} http://a.b/c {token}"), (6, ("x " * 50_000) + f"{key} {token[:80]}"), (6, ("x " * 50_000) + f"{key} {token[:80]}")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.spans.count("opaque") for r in secret_scan.scan_documents(df).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 2, 6: 1}
    assert against_sql(spark, tmp_path / "rows", "op5_secret_scan", "documents", df.coalesce(1)) == ""


def test_pages_of_many_kinds(spark):
    """Hand-made pages with their main text: nothing of it may be lost, nothing else kept."""
    long = "This is the text of a part that goes on for quite a while, and it has all of the words that are usual in it."
    more = "And here is the other part of it, which is also long enough to be known as text by the words that it has."
    cases = [
        (f"<article><p title=\"a>{long}</p></article>", [long]),
        (f"<article><p title='x > y'>{long}</p></article>", [long]),
        (f"<article><h1>One</h1><p>{long}<p>{more}<p>To.</article><footer>the end of it</footer>", ["One", long, more, "To."]),
        (f"<article><p>{long}</p><p>Subscribe</p><p>{more}</p></article>", [long, more]),
        (f"<article><p>{long}</p><div>Advertisement</div><p>Short one.</p></article>", [long, "Short one."]),
        (f"<main><p>{long}</p><ul><li><a href=x>{more}</a></li></ul></main>", [long]),
        (f"<div class=no-sidebar><article><p>{long}</p></article></div>", [long]),
        (f"<div id=page class='has-comments'><main><p>{long}</p></main></div>", [long]),
        (f"<body><div>{long}</div><div class=sidebar><p>{more}</p></div></body>", [long]),
        (f"<nav><ul><li>Home</li></ul></nav><h1>Head</h1><p>{long}</p><p>{more}</p><p>Short.</p>", ["Head", long, more, "Short."]),
        (f"<article><p>{long}</p></article><section class=comments><article><p>{more}</p></article></section>", [long]),
        (f"<form><p>{more}</p><input value='the of and'></form><article><p>{long}</p></article>", [long]),
        (f"<script>var a='</p><p>{more}'</script><article><p>{long}</p></article>", [long]),
        (f"<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;{long}</p></article>", [f"a & b <c> é {long}"]),
        (f"<article><pre>x\n  y\t z</pre><p>{long}</p></article>", ["x y z", long]),
        (f"<ARTICLE><P>{long}<BR>{more}</P></ARTICLE>", [f"{long} {more}"]),
        (f"<article><table><tr><td>one</td><td>two</td></tr></table><p>{long}</p></article>", ["one", "two", long]),
        (f"<!-- <p>{more}</p> --><article><p>{long}</p><!-- x --></article>", [long]),
        (f"<article><p>{long}</p><aside>{more}</aside><p>End of <b>it</b>.</p></article>", [long, "End of it."]),
        (f"<div class='cookie-notice'>{more}</div><main><article><p>{long}</p></article></main>", [long]),
        (f"<header><h1>Site</h1></header><article><header><h1>Own</h1></header><p>{long}</p></article>", ["Own", long]),
        (f"<article><p>{long}", [long]),
        (f"<p><a href=a>one</a> <a href=b>two</a></p><p>{long}</p>", [long]),
        (f"<article><p>{long} 1 < 2 and 3 > 2</p></article>", [f"{long} 1 < 2 and 3 > 2"]),
    ]
    found = [html_text.main_text(f"<html><body>{page}</body></html>").split("\n") for page, _ in cases]
    wrong = [(page, got, want) for (page, want), got in zip(cases, found) if got != want]
    hits = sum(len([x for x in got if x in want]) for (_, want), got in zip(cases, found))
    assert hits / sum(len(x) for x in found) > 0.95 and hits / sum(len(want) for _, want in cases) > 0.95, wrong
    assert len(wrong) <= 1, wrong
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    repeated = pages.unionByName(pages).withColumn("text", pages["url"]).withColumn("n_chars", pages["page_id"])
    rows = html_text.extract_pages(repeated).collect()
    assert len(rows) == repeated.count() and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.main_text(f"<article>{f'<p>{long}</p>' * 20_000}</article>").count("\n") == 19_999


@pytest.mark.parametrize("score,target", [(quality_knn.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers(spark, docs, none, score, target):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = score(d, labels).join(labels, "doc_id").where("held_out").collect()
    good = sum(r.predicted == r[target] for r in rows) / len(rows)
    assert len(rows) > 40 and good > 0.93
    few = score(docs, labels.limit(0)).collect()
    assert len(few) == docs.count() and all(0 <= r.score <= 1 for r in few)
    assert score(none, labels).count() == 0


def test_toxic_recall(spark):
    """On held-out rows of the larger table: nearly all toxic ones, hardly any clean one."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(d, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n.get((0, 1), 0) / n[0, 0] < 0.01


def test_label_model():
    """Posteriors from votes alone, where two of the voters copy a third."""
    rnd = np.random.default_rng(2)
    y = rnd.random(4000) < 0.2
    votes = np.stack([np.where(y, rnd.random(4000) < on, rnd.random(4000) < off) for on, off in [(0.7, 0.02), (0.6, 0.03), (0.8, 0.05), (0.5, 0.01), (0.4, 0.1)]], 1)
    votes = np.concatenate([votes, votes[:, [4]], votes[:, [4]]], 1).astype(float)
    assert ((toxicity.LabelModel(votes).posterior(votes) > 0.5) == y).mean() > 0.95


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, number long, spans string, base string, key string, kept string, n_words string, score string, node string, label string, _t string, `a.b` string"


def test_pipeline_stages(spark):
    """Each stage on repeated and null ids, null, empty and repeated texts, columns of any name, and nothing at all."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    given = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    text = next(r.text for r in given if len(r.text.split()) > 200)
    rows = [(r.doc_id, r.text, r.lang) for r in given[:40]] + [(3, text, "en"), (5, text, "en"), (None, text, None), (3, "other words " * 9, "en"), (9001, text + " end", "en"), (9002, None, "en"), (9003, "", "en")]
    odd = spark.createDataFrame([(i, t, g, "s", len(t or ""), *["x"], 7, *["x"] * 10) for i, t, g in rows], ODD).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        if name != "packing":
            assert out.columns == odd.columns
            assert {(r.doc_id, r.row, r.number) for r in out.collect()} <= {(i, "x", 7) for i, _, _ in rows}
        assert stage(spark, odd.limit(0), sf).count() == 0
    quality = [r.text for r in corpus_pipeline.quality(spark, odd, sf).collect()]
    judged = quality_rules.judged(odd, keep=["doc_id", "text", "lang"]).collect()
    assert sorted(quality) == sorted(r.text for r in judged if r["kept"] is True) and quality
    hidden = corpus_pipeline.secrets(spark, odd, sf).collect()
    assert len(hidden) == len(rows) and {r.n_chars for r in hidden if r.text is None} == {0} and {r["a.b"] for r in hidden} == {"x"}

    left = corpus_pipeline.near_duplicates(spark, odd, sf).collect()
    sets = []
    for _, t, _ in rows:
        w = words(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = linked(sets, 80, 100)
    groups = len({g if s else (k, "alone") for k, (g, s) in enumerate(zip(label, sets))})
    assert len(left) == groups
    same = [r.doc_id for r in left if r.text and r.text.startswith(text)]
    assert len(same) == 1 and same[0] is not None


def test_pipeline(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(pieces) > 50 and {"doc_id", "sequence_id"} <= set(pieces[0].asDict())
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_words_are_encoded_as_in_whole_texts():
    """Signs parted from words, over a mix of characters that meet, compose and case-fold."""
    import random

    import numpy as np
    import pyarrow as pa

    from ripplefold.llm.bpe_words import WordCodes, signs_apart
    from ripplefold.llm.words import starts_of, text_blocks

    draw = random.Random(1)
    characters = [*"aZéß×÷漢'sÃ.,~<|=-“—🙂3²ªİΣ_\\^`[ \n", "ll", "̸", "́", "\xa0", "<|endoftext|>"]
    texts = ["".join(draw.choices(characters, k=draw.randint(0, 14))) for _ in range(5000)] + ["", None, "a", "."]
    codes, codec = WordCodes(vocabulary()), tokenizer(vocabulary())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found = []
    for part, block in text_blocks([batch], 10_000):
        slots = codes.slots(signs_apart(block))
        at = starts_of(codes.lengths[slots])[starts_of(block.counts)]
        found += [x.tolist() for x in np.split(codes.ids(slots), at[1:-1])]
    assert found == [codec.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_of_letters_are_encoded_by_lines(monkeypatch):
    """As each word alone, and no such word goes the slower way."""
    import random

    import numpy as np

    from ripplefold.llm.bpe_words import WordCodes, signs_apart
    from ripplefold.llm.words import Block, starts_of

    draw = random.Random(9)
    latin = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    words = ["".join(draw.choices([*"abcdefghijklmnopqrstuvwxyzABCXYZ", *latin], k=draw.randint(1, 9))) for _ in range(3000)] + latin
    others = ["don't", "a1", "<|endoftext|>", "日本", "Σας", "×", "é", "a|B", "A|b"]
    codes, codec, slow = WordCodes(vocabulary()), tokenizer(vocabulary()), []
    one_by_one = WordCodes._one_by_one
    monkeypatch.setattr(WordCodes, "_one_by_one", lambda self, words: slow.extend(words) or one_by_one(self, words))
    for _ in range(2):  # new words, then known ones
        draw.shuffle(words)
        mixed = words + others
        raw = [w.encode() for w in mixed]
        block = signs_apart(Block(np.frombuffer(b"".join(raw), np.uint8), starts_of(np.array([len(w) for w in raw]))))
        slots = codes.slots(block)
        at = starts_of(codes.lengths[slots])[starts_of(block.counts)]
        assert [x.tolist() for x in np.split(codes.ids(slots), at[1:-1])] == [e.ids for e in codec.encode_batch_fast(mixed, add_special_tokens=False)]
    assert len(slow) < 20 and set(slow) <= {*others, "<", "<|endoftext", "|endoftext|", ">"}


def test_scoring_lets_the_first_shuffle_go(spark, monkeypatch):
    """Before the levels are shuffled back, Spark's files of the n-grams sent to the buckets are gone."""
    import os
    import re
    import time

    def files():
        folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
        return {int(re.match(r"shuffle_(\d+)_", name)[1]) for home in folders for _, _, names in os.walk(home) for name in names if name.startswith("shuffle_")}

    real, left = lm_score.written, []

    def written(df, *more):
        before, out = files(), real(df, *more)
        for _ in range(50):  # the files go in the background
            if files() <= before:
                break
            time.sleep(0.1)
        left.append(files() - before)
        return out

    monkeypatch.setattr(lm_score, "written", written)
    docs = spark.createDataFrame([(i, f"word{i % 50} and other words {i}") for i in range(500)], "doc_id long, text string")
    scored = lm_score.score_documents(docs)
    assert left == [set()]
    assert scored.count() == 500
