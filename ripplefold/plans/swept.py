"""The registered sweep over candidates of several parts and the user folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefold.functions.expressions import seconds
from ripplefold.operators import folds
from ripplefold.operators.templates import sweep_shapes

REQUIRED = 0.4


def _pairs(s: str, x: str) -> str:
    """Tables with prefix x; {x}j has the pairs of s (program_id, label, trace_id, pos, neg)."""
    return f"""{x}p AS (SELECT program_id, pos, row_number() OVER (PARTITION BY program_id ORDER BY pos, trace_id) AS ip FROM {s} WHERE label = 1), {x}n AS (SELECT program_id, neg, row_number() OVER (PARTITION BY program_id ORDER BY neg DESC, trace_id) AS ineg FROM {s} WHERE label = 0),
 {x}z AS (SELECT program_id, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM {s} GROUP BY program_id), {x}k AS (SELECT program_id, np, nn, unnest(range(1, greatest(np, nn) + 1)) AS i FROM {x}z),
 {x}j AS (SELECT k.program_id, k.i, pos, neg, pos <= neg OR pos < 0 OR neg < 0 AS wrong FROM {x}k k JOIN {x}p p ON p.program_id = k.program_id AND p.ip = ceil(k.i * np / greatest(np, nn)) JOIN {x}n n ON n.program_id = k.program_id AND n.ineg = ceil(k.i * nn / greatest(np, nn)))"""


SQL = f"""WITH t AS (SELECT src % 2 AS label, src AS trace_id, len, dst, row_number() OVER (PARTITION BY src ORDER BY ts, pkt_id) AS n FROM {{pk}} WHERE src IS NOT NULL),
 v AS (SELECT idx, v, row_number() OVER (PARTITION BY idx ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY idx) AS n FROM (SELECT DISTINCT 0 AS idx, len AS v FROM t UNION SELECT DISTINCT 1, dst FROM t) WHERE v IS NOT NULL),
 g AS (SELECT idx || ':1' || (pos // (1 << (length(bin(n - 1)) - 1))) AS atom, idx, min(v) AS low, max(v) AS high FROM v GROUP BY ALL),
 h AS (SELECT atom, label, trace_id, n, coalesce(CASE idx WHEN 0 THEN len ELSE dst END BETWEEN low AND high, FALSE) AS hit FROM t CROSS JOIN g),
 c AS (SELECT atom, label, trace_id, count(*) FILTER (hit) AS c, arg_max(hit, n) AS at_end FROM h GROUP BY ALL),
 runs AS (SELECT atom, trace_id, n - row_number() OVER (PARTITION BY atom, trace_id ORDER BY n) AS island FROM h WHERE hit), b AS (SELECT atom, trace_id, max(k) AS run FROM (SELECT atom, trace_id, island, count(*) AS k FROM runs GROUP BY ALL) GROUP BY ALL),
 two AS (SELECT x.atom AS one, y.atom AS other, x.label, x.trace_id, count(*) FILTER (x.hit) AS nx, count(*) FILTER (y.hit) AS ny, string_agg(CASE WHEN x.hit AND y.hit THEN 'b' WHEN x.hit THEN 'p' WHEN y.hit THEN 'q' ELSE 'o' END, '' ORDER BY x.n) AS word FROM h x JOIN h y ON x.trace_id = y.trace_id AND x.n = y.n AND x.atom <> y.atom GROUP BY ALL),
 o AS (SELECT 'count ' || atom AS program_id, 2780 AS complexity, label, trace_id, c AS bound, c AS v FROM c UNION ALL SELECT 'ends ' || atom, 1700, label, trace_id, c, CASE WHEN at_end THEN c END FROM c
  UNION ALL SELECT 'burst ' || c.atom, 3200, label, c.trace_id, c, coalesce(run, 0) FROM c LEFT JOIN b ON b.atom = c.atom AND b.trace_id = c.trace_id
  UNION ALL SELECT 'pairs ' || one || ' ' || other, 4160, label, trace_id, least(nx, ny), len(regexp_extract_all(word, '[pb][op]*[qb]')) FROM two
  UNION ALL SELECT 'after ' || one || ' ' || other, 4580, label, trace_id, ny, CASE WHEN nx > 0 THEN length(regexp_replace(regexp_replace(word, '^[oq]*[pb]', ''), '[op]', '', 'g')) END FROM two),
 may AS (SELECT program_id, label, trace_id, bound AS pos, 0 AS neg FROM o), {_pairs("may", "m")},
 s AS (SELECT program_id, complexity, label, trace_id, coalesce(v, -1) AS pos, coalesce(v, -1) AS neg FROM o WHERE program_id IN (SELECT program_id FROM mj GROUP BY program_id HAVING count(*) FILTER (wrong) <= {1 - REQUIRED} * count(*))), {_pairs("s", "d")},
 l AS (SELECT program_id, count(*) FILTER (wrong) AS invalid, arg_min(floor((pos + neg) / 2)::BIGINT, i) FILTER (NOT wrong) AS threshold FROM dj GROUP BY program_id HAVING count(*) FILTER (wrong) <= {1 - REQUIRED} * count(*)),
 r AS (SELECT program_id, complexity, threshold, invalid, round(avg((pos > threshold)::INT) FILTER (label = 1), 6) AS tpr, round(avg((pos <= threshold)::INT) FILTER (label = 0), 6) AS tnr FROM s JOIN l USING (program_id) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY tpr + tnr DESC, complexity, program_id) AS place, program_id, threshold, invalid, tpr, tnr, complexity FROM r"""


def register(add) -> None:
    traces = lambda p: p.where("src is not null").select((F.col("src") % 2).alias("label"), F.col("src").alias("trace_id"), "ts", "pkt_id", "len", "dst")
    add("l09_sweep_shapes", lambda p: sweep_shapes(traces(p), ["len", "dst"], ["ts", "pkt_id"], 1, REQUIRED), SQL)
    order = ["ts", "pkt_id"]
    add("x03_token_bucket", lambda p: folds.token_bucket(p.withColumn("sec", seconds(F.col("ts"))), ["src"], order, "sec", "len", 30_000, 20), """WITH l AS (SELECT src, list({'t': sec, 'n': coalesce(len, 0), 'level': 30000::BIGINT, 'since': NULL::BIGINT, 'passed': 0::BIGINT, 'refused': 0::BIGINT} ORDER BY ts, pkt_id) AS rows FROM {pk} GROUP BY src),
 f AS (SELECT src, list_reduce(list_prepend({'t': 0::BIGINT, 'n': 0::BIGINT, 'level': 30000::BIGINT, 'since': NULL::BIGINT, 'passed': 0::BIGINT, 'refused': 0::BIGINT}, rows), lambda a, x: {'t': x.t, 'n': x.n,
  'level': least(30000, a.level + coalesce((x.t - a.since) // 20, 0)) - CASE WHEN x.n <= least(30000, a.level + coalesce((x.t - a.since) // 20, 0)) THEN x.n ELSE 0 END, 'since': coalesce(a.since + (x.t - a.since) // 20 * 20, x.t),
  'passed': a.passed + (x.n <= least(30000, a.level + coalesce((x.t - a.since) // 20, 0)))::INT, 'refused': a.refused + (x.n > least(30000, a.level + coalesce((x.t - a.since) // 20, 0)))::INT}) AS s FROM l)
SELECT src, s.passed AS passed, s.refused AS refused FROM f""")
    signed = "CASE WHEN kind IN ('view', 'error') THEN -len ELSE len END"
    sums = lambda by: f"SELECT {by} sum(coalesce({signed}, 0)) OVER (PARTITION BY {by} 1 ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS c, ts, pkt_id FROM {{pk}}"
    best = lambda by: f"WITH c AS ({sums(by)}), m AS (SELECT *, min(c) OVER (PARTITION BY {by} 1 ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS low FROM c) SELECT {by} max(c - least(low, 0))::BIGINT AS best FROM m GROUP BY {by} ()"
    weighted = lambda p: p.withColumn("weight", F.expr(signed))
    add("x03_best_stretch", lambda p: folds.best_stretch(weighted(p), ["src"], order, "weight"), best("src,"))
    add("x03_best_stretch_of_all", lambda p: folds.best_stretch(weighted(p), [], order, "weight"), best("").replace("GROUP BY  ()", ""))
