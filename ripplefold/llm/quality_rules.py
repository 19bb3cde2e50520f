"""Operator 2, quality rules by distribution divergence; DataFrame functions only.

Each document gets two histograms: of its non-space characters over six classes, and of its words over
the common words of each language and the rest. The references of a language are the summed histograms
of all its documents that pass the base rule. A document is kept when it passes the base rule and lies
close enough, in Jensen-Shannon distance, to the nearest language; the word histogram is only held
against it from `least_words_for_words` words on.

Contract: a null text counts as empty (n_words 0, so base_failed and not kept). A null or unlisted lang
adds to no reference but is judged like the others. Without any reference (no listed language, or an
empty table) the divergences are 0. Repeated rows give repeated results. Input columns named like the
measures are shadowed in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import written

# Common words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with"],
    "de": ["der", "die", "und", "das", "von", "mit", "den", "ist", "im", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que"],
    "es": ["de", "la", "que", "el", "en", "los", "del", "las", "un", "se"],
}
LISTED = sorted({w for words in COMMON_WORDS.values() for w in words})
# Character classes; what is in none of them is the sixth class.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "point": ".,;:?'\"()\\-", "symbol": "#*$%&|<>"}
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words from the array of words: windows are hashed, sorted with their places, and compared with neighbours.

    A first sort, by the upper bits of the hash with the place in the lower 31, finds the windows that may have an equal;
    those alone are sorted and compared by their whole hashes.
    """
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_t", F.when(F.col("n_words") >= 3, F.expr("transform(slice(_h, 1, n_words - 2), (h, i) -> xxhash64(h, get(_h, i + 1), get(_h, i + 2)))")).otherwise(F.expr("cast(array() as array<bigint>)")))
    df = df.withColumn("_some", F.size(F.array_distinct("_t")) < F.size("_t"))
    nothing = F.expr("cast(array() as array<bigint>)")
    df = df.withColumn("_p", F.when(F.col("_some"), F.expr("sort_array(transform(_t, (t, i) -> shiftleft(shiftright(t, 31), 31) | cast(i as bigint)))")).otherwise(nothing))
    df = df.withColumn("_e", F.when(F.col("_some"), F.expr(
        "sort_array(transform(filter(_p, (p, i) -> coalesce(shiftright(p, 31) = shiftright(get(_p, i - 1), 31), false) or coalesce(shiftright(p, 31) = shiftright(get(_p, i + 1), 31), false)), p -> struct(get(_t, cast(p & 2147483647L as int)) as t, p & 2147483647L as i)))"
    )).otherwise(F.expr("cast(array() as array<struct<t: bigint, i: bigint>>)")))
    df = df.withColumn("_q", F.expr("sort_array(transform(filter(_e, (e, i) -> coalesce(e.t = get(_e, i - 1).t, false) or coalesce(e.t = get(_e, i + 1).t, false)), e -> e.i))"))
    return df.withColumn("n_repeat_words", F.expr("aggregate(transform(_q, (q, i) -> least(3L, coalesce(get(_q, i + 1), q + 3) - q)), 0L, (a, x) -> a + x)"))


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with the base measures and the two histograms `char_counts` and `word_counts`."""
    own = docs.columns if keep is None else keep
    keep = [c for c in own if c not in (*MEASURES, "char_counts", "word_counts", "_w", "_h", "_t", "_some", "_p", "_e", "_q", "_all", "_lines", "_common")]
    df = docs.select(*keep, *(["text"] if "text" not in keep else [])).withColumn("_w", F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE, -1), ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = _repeats(df.withColumn("n_words", F.col("n_words").cast("int")))
    df = df.withColumn("_all", F.array_join("_w", ""))
    df = df.withColumn("_lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    left = lambda signs: F.length("_all") - F.length(F.regexp_replace("_all", f"[{signs}]+", ""))
    df = df.withColumn("_common", F.concat(F.lit(" "), F.array_join(F.filter("_w", lambda w: w.isin(LISTED)), "  "), F.lit(" ")))
    df = df.withColumn("char_counts", F.array(*(left(signs).cast("long") for signs in CLASSES.values())))
    counts = [((F.length("_common") - F.length(F.replace(F.col("_common"), F.lit(f" {w} ")))) / (len(w) + 2)).cast("long") for w in LISTED]
    n_symbols, word_chars = F.get("char_counts", list(CLASSES).index("symbol")), F.length("_all").cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(
        *keep, F.col("n_words").cast("long").alias("n_words"), word_chars.alias("word_chars"), n_symbols.alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"),
        "char_counts", F.array(*counts).alias("word_counts"),
    )


def _divergence(shares: list[Column], reference: list[float]) -> Column:
    """Jensen-Shannon distance (0 to 1) between a document's shares and a reference's."""
    total = F.lit(0.0)
    for p, q in zip(shares, reference):
        m = (p + F.lit(q)) / 2
        total = total + F.when(p > 0, p * F.ln(p / m)).otherwise(0.0)
        if q > 0:
            total = total + F.lit(q) * F.ln(F.lit(q) / m)
    return F.sqrt(F.greatest(total / 2 / F.ln(F.lit(2.0)), F.lit(0.0)))


def _shares(values: list, total) -> list:
    return [v / total for v in values] + [1 - sum(v / total for v in values[1:]) - values[0] / total]


def judged(docs: DataFrame, most_char_divergence: float = 0.33, most_word_divergence: float = 0.24, least_words_for_words: int = 120, keep: list[str] | None = None) -> DataFrame:
    """docs with the base measures, char_divergence, word_divergence and kept."""
    table = written(measured(docs, keep))
    own = {lang: [LISTED.index(w) for w in words] for lang, words in COMMON_WORDS.items()}
    sums = {}
    if "lang" in table.columns:
        parts = [F.sum(F.get("char_counts", i)).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("word_counts", i)).alias(f"w{i}") for i in range(len(LISTED))]
        rows = table.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(F.sum("word_chars").alias("chars"), F.sum("n_words").alias("words"), *parts).collect()  # one row for each listed language at most
        sums = {r["lang"]: r for r in rows}
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)).cast("double"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    by_char, by_word = [], []
    for lang, r in sorted(sums.items()):
        mine = _shares([F.get("char_counts", i) for i in range(len(CLASSES))], chars)
        by_char.append(_divergence(mine, _shares([r[f"c{i}"] for i in range(len(CLASSES))], r["chars"])))
        mine = _shares([F.get("word_counts", i) for i in own[lang]], words)
        by_word.append(_divergence(mine, _shares([r[f"w{i}"] for i in own[lang]], r["words"])))
    least = lambda x: F.least(*x) if len(x) > 1 else (x[0] if x else F.lit(0.0))
    table = table.withColumn("char_divergence", least(by_char)).withColumn("word_divergence", F.when(F.col("n_words") >= least_words_for_words, least(by_word)).otherwise(F.lit(0.0)))
    verdict = ~F.col("base_failed") & (F.col("char_divergence") <= most_char_divergence) & (F.col("word_divergence") <= most_word_divergence)
    return table.drop("char_counts", "word_counts").withColumn("kept", verdict)
