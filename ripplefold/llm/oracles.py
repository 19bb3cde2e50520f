"""DuckDB SQL for the operators that SQL can express, written from their contracts and methods rather than from their plans."""

from __future__ import annotations

from ripplefold.llm.quality_rules import CLASSES, COMMON_WORDS, LISTED
from ripplefold.llm.secret_scan import ACCESS, ASSIGN, ENDPOINT, HEX, KINDS, OPAQUE, REACH

SPACE, NO_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Documents as lists of words, with a row number, since ids may repeat.
WORDS = f"d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents)"
#: Smallest label reachable over l(a, b), which has both directions, from n(node): rounds of minima end when nothing changes.
REACHED = "reach(node, other) AS (SELECT node, node FROM n UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.other)"


def _quality() -> str:
    def distance(shares: list[str], reference: list[str]) -> str:
        terms = [f"CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln(2 * {q} / ({p} + {q})) ELSE 0 END" for p, q in zip(shares, reference)]
        return f"sqrt(greatest(({' + '.join(terms)}) / 2 / ln(2), 0))"

    classes, langs = list(CLASSES), sorted(COMMON_WORDS)
    shares = [f"(c_{c} / chars)" for c in classes]
    shares.append("(" + " - ".join(["1.0", *shares]) + ")")
    chars = {g: distance(shares, [f"{g}.c{i}" for i in range(len(classes) + 1)]) for g in langs}
    words = {}
    for g in langs:
        own = [f"(wc[{LISTED.index(w) + 1}] / words)" for w in COMMON_WORDS[g]]
        words[g] = distance([*own, "(" + " - ".join(["1.0", *own]) + ")"], [f"{g}.w{i}" for i in range(len(own) + 1)])
    sums = [f"sum(c_{c}) / sum(word_chars) AS c{i}" for i, c in enumerate(classes)] + [f"1.0 - ({' + '.join(f'sum(c_{c})' for c in classes)}) / sum(word_chars) AS c{len(classes)}"]
    refs = []
    for g in langs:
        own = [f"sum(wc[{LISTED.index(w) + 1}])" for w in COMMON_WORDS[g]]
        of = [f"{x} / sum(n_words) AS w{i}" for i, x in enumerate(own)] + [f"1.0 - ({' + '.join(own)}) / sum(n_words) AS w{len(own)}"]
        refs.append(f"{g} AS (SELECT {', '.join(sums + of)} FROM m WHERE NOT base_failed AND lang = '{g}')")
    signs = {c: x.replace("'", "''") for c, x in CLASSES.items()}
    listed = ", ".join(f"'{w}'" for w in LISTED)
    counts = ", ".join(f"length(a) - length(regexp_replace(a, '[{x}]', '', 'g')) AS c_{c}" for c, x in signs.items())
    near = lambda found: f"least({', '.join(f'CASE WHEN {g}.c0 IS NOT NULL THEN {found[g]} END' for g in langs)})"  # noqa: E731  a language without references counts for nothing
    return f"""WITH {WORDS},
 x AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
 k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM x),
 p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY r),
 b AS (SELECT r, doc_id, lang, len(w) AS n_words, array_to_string(w, '') AS a, w, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '{NO_SPACE}')) AS lines FROM d),
 m0 AS (SELECT r, doc_id, lang, n_words, length(a) AS word_chars, {counts}, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  list_transform([{listed}], lambda v: len(list_filter(w, lambda y: y = v))) AS wc FROM b LEFT JOIN p USING (r)),
 m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(word_chars, 1)::DOUBLE AS chars, greatest(n_words, 1)::DOUBLE AS words FROM m0),
 {', '.join(refs)},
 v AS (SELECT m.*, coalesce({near(chars)}, 0) AS cd, CASE WHEN n_words >= 120 THEN coalesce({near(words)}, 0) ELSE 0 END AS wd FROM m, {', '.join(langs)})
SELECT doc_id, n_words, word_chars, c_symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS char_divergence, round(wd, 6) AS word_divergence,
 NOT base_failed AND cd <= 0.33 AND wd <= 0.24 AS kept FROM v"""


def _jaccard(width: int = 4, num: int = 85, den: int = 100) -> str:
    low = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + SPACE + "'), lambda x: x <> '')"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS w FROM documents),
 s AS (SELECT DISTINCT r, array_to_string(w[i : i + {width - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
 z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
 c AS (SELECT r, min(r) OVER (PARTITION BY h, n) AS k FROM (SELECT r, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS h FROM s GROUP BY r)),
 u AS (SELECT s.r, g FROM s JOIN c ON c.r = s.r AND c.k = s.r),
 o AS (SELECT x.r AS a, y.r AS b, count(*) AS o FROM u x JOIN u y ON x.g = y.g AND x.r < y.r GROUP BY 1, 2),
 e AS (SELECT a, b FROM o JOIN z p ON p.r = a JOIN z q ON q.r = b WHERE {den} * o >= {num} * (p.n + q.n - o)),
 l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), n AS (SELECT DISTINCT k AS node FROM c), {REACHED},
 t AS (SELECT node, min(other) AS top FROM reach GROUP BY node),
 f AS (SELECT c.r, top, min(doc_id) OVER (PARTITION BY top) AS component_id FROM c JOIN t ON t.node = c.k JOIN d ON d.r = c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN z USING (r) LEFT JOIN f USING (r)"""


def _secrets() -> str:
    quoted = lambda x: x.replace("'", "''")

    def spans(kind: str, pattern: str, source: str, value: str = "true") -> str:
        q = quoted(pattern)
        return f"""{kind} AS (SELECT r, {KINDS.index(kind)} AS k, s, s + length(m) AS e FROM (SELECT r, m[i] AS m, {value} AS good,
  list_sum(list_transform(p[1 : i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda y: length(y))), 0) AS s
  FROM (SELECT r, m, p, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{q}') AS m, regexp_split_to_array(t, '{q}') AS p, {f"regexp_extract_all(t, '{q}', 2)" if value != "true" else "NULL"} AS v FROM {source}))) WHERE good)"""

    near = lambda a, b: f"greatest({a}.s, {b}.s) - least({a}.e, {b}.e)"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = lambda where: f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e){where}, '')"
    count = lambda k: f"count(*) FILTER (k = {KINDS.index(k)}) AS n_{k}"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 {spans("assign", ASSIGN, "d", "length(v[i]) >= 6")}, {spans("access", ACCESS, "d")}, {spans("hex", HEX, "d")},
 base AS (FROM assign UNION ALL FROM access UNION ALL FROM hex), h AS (SELECT * FROM d WHERE r IN (SELECT r FROM base)),
 {spans("endpoint", ENDPOINT, "h")}, {spans("opaque", OPAQUE, "h")},
 weak AS (SELECT * FROM (FROM endpoint UNION ALL FROM opaque) w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND w.s < b.e AND b.s < w.e)),
 ends AS (SELECT * FROM weak w WHERE k = 3 AND EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND {near("w", "b")} <= {REACH})),
 anchors AS (SELECT * FROM base WHERE k = 1 UNION ALL FROM ends),
 opq AS (SELECT * FROM weak w WHERE k = 4 AND EXISTS (SELECT 1 FROM anchors b WHERE b.r = w.r AND {near("w", "b")} <= {REACH})),
 every AS (FROM base UNION ALL FROM ends UNION ALL FROM opq)
SELECT doc_id, {count("assign")}, {count("access")}, {count("hex")}, sha256({text(" FILTER (k < 3)")}) AS base_sha256, {text("")} AS spans FROM d LEFT JOIN every USING (r) GROUP BY r, doc_id"""


def _embeddings(least: float = 0.9) -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 g AS (SELECT r, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM d WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 n AS (SELECT r AS node FROM g), e AS (SELECT x.r AS a, y.r AS b FROM g x JOIN g y ON x.r < y.r AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= {least}),
 l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), {REACHED}, t AS (SELECT node, min(other) AS top FROM reach GROUP BY node), c AS (SELECT a, count(*) AS n FROM l GROUP BY a),
 f AS (SELECT g.r, coalesce(n, 0) AS n_links, min(vec_id) OVER (PARTITION BY top) AS component_id FROM g JOIN t ON t.node = g.r LEFT JOIN c ON c.a = g.r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, CASE WHEN f.r IS NULL THEN vec_id ELSE component_id END AS component_id, coalesce(vec_id = CASE WHEN f.r IS NULL THEN vec_id ELSE component_id END, TRUE) AS kept FROM d LEFT JOIN f USING (r)"""


def _negatives() -> str:
    return """WITH d AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, embedding FROM embeddings),
 g AS (SELECT r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM d WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS r, b.vec_id AS vec_id, list_dot_product(a.x, b.x)::BIGINT AS score FROM g a JOIN g b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5),
 w AS (SELECT DISTINCT anchor, positive_score FROM p),
 n AS (SELECT anchor, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor, positive_score ORDER BY score DESC, vec_id NULLS LAST, r) AS rank
  FROM w JOIN s USING (anchor) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM p JOIN n USING (anchor, positive_score) WHERE rank <= 3"""


def _substrings(width: int = 35) -> str:
    return f"""WITH {WORDS.replace("lang, ", "")},
 k AS (SELECT r, i, md5(array_to_string(w[i : i + {width - 1}], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d WHERE len(w) >= {width})),
 c AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY g) > 1),
 x AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + {width})) AS j FROM c)),
 p AS (SELECT r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS j FROM d),
 m AS (SELECT p.r, string_agg(v, ' ' ORDER BY p.j) AS kept, count(*) AS n FROM p LEFT JOIN x ON x.r = p.r AND x.j = p.j WHERE x.r IS NULL GROUP BY p.r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m ON m.r = d.r"""


ORACLE_SQL = {"op2_quality_rules": _quality(), "op3_jaccard_join": _jaccard(), "op5_secret_scan": _secrets(), "op8_embedding_dedup": _embeddings(), "op12_hard_negatives": _negatives(), "op13_substring_dedup": _substrings()}
