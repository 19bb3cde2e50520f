"""Scoring candidate queries against labelled traces: grids, thresholds, accuracy and ROC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplefold.functions.expressions import slice_positions
from ripplefold.operators.joins import value_positions
from ripplefold.sources.stored import stored


def grid(traces: DataFrame, programs: DataFrame, keys: list[str], buckets: int = 64) -> DataFrame:
    """Per trace and program, how many packets lie in the program's value range. Values are counted per trace first, and meet
    only the programs of their value bucket; the result has a row for every trace and program, which is what is asked for."""
    span = programs.agg(F.min("low").alias("a"), F.max("high").alias("b")).first()
    width = max(1, ((span["b"] or 0) - (span["a"] or 0)) // buckets + 1)
    bucket = lambda c: F.floor(F.col(c) / width)
    ranges = programs.withColumn("_b", F.explode(F.sequence(bucket("low"), bucket("high"))))
    values = traces.groupBy(*keys, "x").agg(F.count("*").alias("c")).withColumn("_b", bucket("x"))
    hit = values.join(ranges, "_b").where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
    counts = hit.groupBy("program_id", *keys).agg(F.sum("c").alias("upper"))
    every = traces.select(*keys).distinct().join(programs.select("program_id"))
    return every.join(counts, ["program_id", *keys], "left").select("program_id", *keys, F.coalesce("upper", F.lit(0)).cast("long").alias("upper"))


def classified(scores: DataFrame, threshold, tie_is_neg) -> DataFrame:
    return scores.withColumn("positive", F.when(F.col("upper") == threshold, ~tie_is_neg).otherwise(F.col("upper") > threshold))


def accuracy(scored: DataFrame) -> DataFrame:
    """True positive and true negative rates per program; `positive` is the verdict, `label` the truth."""
    return scored.groupBy("program_id").agg(
        F.round(F.avg(F.when(F.col("label") == 1, F.col("positive").cast("int"))), 6).alias("tpr"),
        F.round(F.avg(F.when(F.col("label") == 0, 1 - F.col("positive").cast("int"))), 6).alias("tnr"),
    )


def paired(scores: DataFrame, positive: str = "upper", negative: str = "upper") -> DataFrame:
    """The i-th smallest positive with the i-th largest negative, the shorter side stretched over the longer, as runs of equal pairs:
    program_id, first_i, last_i, pos, neg. A null counts as -1, a result without a match.

    Only distinct scores are ranked: a score's share of its class, stretched over the pairs, is the run of i that it stands for.
    """
    value = F.when(F.col("label") == 1, F.col(positive)).otherwise(F.col(negative))
    counts = scores.where("label in (0, 1)").select("program_id", "label", F.coalesce(value, F.lit(-1)).alias("v")).groupBy("program_id", "label", "v").agg(F.count("*").alias("c"))
    of_class, of_program = Window.partitionBy("program_id", "label"), Window.partitionBy("program_id")
    so_far = F.sum("c").over(of_class.orderBy(F.when(F.col("label") == 1, F.col("v")).otherwise(-F.col("v"))))
    sized = counts.withColumn("so_far", so_far).withColumn("size", F.sum("c").over(of_class))
    sized = sized.withColumn("m", F.max("size").over(of_program)).withColumn("classes", F.max("label").over(of_program) - F.min("label").over(of_program)).where("classes = 1")
    ends = sized.select("program_id", F.expr("so_far * m div size").alias("last_i"), F.when(F.col("label") == 1, F.col("v")).alias("pos"), F.when(F.col("label") == 0, F.col("v")).alias("neg"))
    ends = ends.groupBy("program_id", "last_i").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    down = of_program.orderBy(F.desc("last_i")).rowsBetween(Window.unboundedPreceding, 0)
    here = lambda c: F.last(c, ignorenulls=True).over(down).alias(c)
    before = F.coalesce(F.lag("last_i").over(of_program.orderBy("last_i")), F.lit(0))
    return ends.select("program_id", (before + 1).alias("first_i"), "last_i", here("pos"), here("neg"))


def rank_pairs(scores: DataFrame, positive: str = "upper", negative: str = "upper") -> DataFrame:
    """The pairs of paired(), one row each."""
    return paired(scores, positive, negative).select("program_id", F.explode(F.sequence("first_i", "last_i")).alias("i"), "pos", "neg")


def wrong():
    """A pair in the wrong order, or one of whose results has no match."""
    return (F.col("pos") <= F.col("neg")) | (F.col("pos") < 0) | (F.col("neg") < 0)


def acceptable(scores: DataFrame, accuracy: float) -> DataFrame:
    """Whether a partial program may still be right, by the bounds of its results: pairs of the positives' upper bounds, smallest
    first, and the negatives' lower bounds, largest first, of which at most a share of 1 - accuracy may be in the wrong order or undefined."""
    n = F.col("last_i") - F.col("first_i") + 1
    out = paired(scores, "upper", "lower").groupBy("program_id").agg(F.sum(F.when(wrong(), n).otherwise(0)).alias("invalid"), F.sum(n).alias("pairs"))
    return out.withColumn("accepted", F.col("invalid") <= (1 - accuracy) * F.col("pairs"))


def weighted_round(verdicts: DataFrame, weights: DataFrame, required: float, reached: float) -> DataFrame:
    """One round of weighted acceptance: label, trace_id, weight, accepted. The program is accepted if the mean weight of the examples
    whose verdict is right, the others counting 0, comes up to `required`; then their weights become (reached + w) / 2. verdicts: label, trace_id, right."""
    both = verdicts.join(weights.select("label", "trace_id", "weight"), ["label", "trace_id"])
    accepted = F.broadcast(both.agg((F.coalesce(F.avg(F.when(F.col("right"), F.col("weight")).otherwise(0.0)), F.lit(0.0)) >= required).alias("accepted")))  # one row
    eased = F.when(F.col("accepted") & F.col("right"), (F.lit(reached) + F.col("weight")) / 2).otherwise(F.col("weight"))
    return both.join(accepted).select("label", "trace_id", eased.alias("weight"), "accepted")


def weighted_rounds(verdicts: DataFrame, programs: list[int], required: float, reached: float) -> DataFrame:
    """round, accepted, label, trace_id, weight: the weights after each round, one program a round, which start with 1 and are written
    once a round. verdicts: program_id, label, trace_id, right."""
    weights = verdicts.select("label", "trace_id").distinct().withColumn("weight", F.lit(1.0))
    found = None
    for i, program in enumerate(programs):
        weights = stored(weighted_round(verdicts.where(F.col("program_id") == program), weights, required, reached))
        own = weights.select(F.lit(i + 1).alias("round"), "accepted", "label", "trace_id", "weight")
        found = own if found is None else found.unionByName(own)
    return found


def result_vectors(scores: DataFrame) -> DataFrame:
    """Per trace, the results of all programs in their order."""
    return scores.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("program_id", "upper"))), lambda x: x["upper"]).alias("results"))


#: What the parts of a candidate count.
UNIT, OPEN, REWARD, NESTED = 100.0, 5.0, 0.2, 10.0


def complexity(programs: DataFrame) -> DataFrame:
    """A candidate's complexity from the counts of its parts: one for each term and each join of parts, more for wildcards and for parts
    still open, a little less for each predicate part (`favoured`), and twice that and a penalty more where an aggregation is nested (`nested`)."""
    plain = UNIT * (F.col("terms") + F.col("joins") + OPEN * (F.col("wildcards") + F.col("open_parts")) - REWARD * F.col("favoured"))
    return programs.withColumn("complexity", F.round(F.when(F.col("nested"), 2 * plain + UNIT * NESTED).otherwise(plain)).cast("long"))


def atoms(df: DataFrame, fields: list[str], depth: int) -> DataFrame:
    """Candidate programs of one predicate: field and dyadic slice up to a depth, with the slice's value bounds, where it exists."""
    found = None
    slices = [format(x, "b") for d in range(1, depth + 1) for x in range(1 << d, 2 << d)]
    positions = stored(value_positions(df, fields))
    for bits in slices:  # a fixed number of templates
        first, last = slice_positions(F.col("n"), bits)
        one = positions.where((F.col("pos") >= first) & (F.col("pos") <= last)).groupBy("idx").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        one = one.select(F.concat("idx", F.lit(f":{bits}")).alias("program_id"), "idx", "low", "high", F.lit(len(bits) + 2).alias("terms"), F.lit(len(bits) + 1).alias("joins"), F.lit(0).alias("wildcards"), F.lit(0).alias("open_parts"), F.lit(3).alias("favoured"), F.lit(False).alias("nested"))
        found = one if found is None else found.unionByName(one)
    return complexity(found)


def sweep(traces: DataFrame, fields: list[str], depth: int) -> DataFrame:
    """All one-predicate candidates over labelled traces (label, trace_id and the fields), with learned thresholds, both accuracies
    and their rank: the most accurate first, then the simplest."""
    programs = stored(atoms(traces, fields, depth))
    keys = ["label", "trace_id"]
    long = traces.select(*keys, F.posexplode(F.array(*fields)).alias("idx", "x"))
    ranges = F.broadcast(programs.select("program_id", F.col("idx").alias("_idx"), "low", "high"))  # a fixed number of templates
    hit = long.groupBy(*keys, "idx", "x").agg(F.count("*").alias("c")).join(ranges, (F.col("idx") == F.col("_idx")) & F.col("x").between(F.col("low"), F.col("high")))
    counts = hit.groupBy("program_id", *keys).agg(F.sum("c").alias("upper"))
    every = traces.select(*keys).distinct().join(F.broadcast(programs.select("program_id")))
    scores = stored(every.join(counts, ["program_id", *keys], "left").withColumn("upper", F.coalesce("upper", F.lit(0))))
    limits = thresholds(scores).select("program_id", F.col("threshold").alias("limit"))
    rated = accuracy(scores.join(limits, "program_id").withColumn("positive", F.coalesce(F.col("upper") > F.col("limit"), F.lit(False))))
    table = rated.join(limits, "program_id").join(programs.select("program_id", "complexity"), "program_id")
    order = Window.orderBy(F.desc(F.col("tpr") + F.col("tnr")), "complexity", "program_id")  # one row a candidate
    return table.withColumn("place", F.row_number().over(order)).select("place", "program_id", F.col("limit").alias("threshold"), "tpr", "tnr", "complexity")


def thresholds(scores: DataFrame) -> DataFrame:
    """Per program: how many leading pairs are in the wrong order, and the floored midpoint of the first right one."""
    n = F.col("last_i") - F.col("first_i") + 1
    right = F.when(~wrong(), F.struct("first_i", F.floor((F.col("pos") + F.col("neg")) / 2).cast("long").alias("threshold")))
    return paired(scores).groupBy("program_id").agg(F.sum(F.when(wrong(), n).otherwise(0)).alias("invalid"), F.min(right).alias("first")).select("program_id", "invalid", F.col("first.threshold").alias("threshold"))


def roc(scores: DataFrame) -> DataFrame:
    """One point per distinct score, from the highest down: cumulative rates of both classes."""
    per = scores.groupBy("program_id", "upper").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    down = Window.partitionBy("program_id").orderBy(F.desc("upper"))
    whole = Window.partitionBy("program_id")
    return per.select("program_id", "upper", F.round(F.sum("p").over(down) / F.sum("p").over(whole), 6).alias("tpr"), F.round(F.sum("n").over(down) / F.sum("n").over(whole), 6).alias("fpr"))


def area(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids, in exact counts."""
    per = scores.groupBy("program_id", "upper").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    down = Window.partitionBy("program_id").orderBy(F.desc("upper")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("above", F.coalesce(F.sum("p").over(down), F.lit(0)))
    out = per.groupBy("program_id").agg(F.sum(F.col("n") * (2 * F.col("above") + F.col("p"))).alias("twice"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select("program_id", F.round(F.col("twice") / (2.0 * F.col("p") * F.col("n")), 6).alias("auc"))


def best_under(scores: DataFrame, most_fpr: float) -> DataFrame:
    """The highest true positive rate whose false positive rate stays within the budget, and its threshold."""
    return roc(scores).where(F.col("fpr") <= most_fpr).groupBy("program_id").agg(F.max("tpr").alias("tpr"), F.min("upper").alias("least_score"))
