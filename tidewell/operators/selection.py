"""Model selection: information criteria, Pareto fronts, elbows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_binomial(n: Column, k: Column) -> Column:
    """log C(n, k) as a sum of logarithms; 0 for k = 0 or k = n."""
    terms = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.log((n - k + i).cast("double") / i))
    return F.when((k <= 0) | (k >= n), 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def information_criteria(df: DataFrame, p: int, rss: str = "rss", n: str = "n", k: str = "support_size", gamma: float = 1.0, eps: float = 1e-12) -> DataFrame:
    """Adds bic = n log(rss / n) + k log n and ebic = bic + 2 gamma log C(p, k)."""
    rows = F.greatest(F.col(n).cast("double"), F.lit(2.0))
    df = df.withColumn("bic", rows * F.log(F.greatest(F.col(rss), F.lit(eps)) / rows) + F.col(k) * F.log(rows))
    return df.withColumn("ebic", F.col("bic") + 2 * gamma * log_binomial(F.lit(p), F.col(k).cast("int")))


def candidate_path(path: DataFrame, keys: list[str], tol: float = 1e-10) -> DataFrame:
    """Candidates of a threshold path in long form (keys, equation, threshold_index, threshold, term, coef, rss, n): one row for
    each threshold, but a support that came before only if its rss improves on all rows of that support before it."""
    g = [*keys, "equation", "threshold_index", "threshold", "rss", "n"]
    path = path.where("rss IS NOT NULL")  # failed fits are rows of the path, and no candidates
    on = F.abs("coef") > tol
    c = path.groupBy(*g).agg(F.sum(on.cast("int")).alias("support_size"), F.array_join(F.array_sort(F.collect_list(F.when(on, F.col("term")))), ";").alias("active_terms"))
    before = Window.partitionBy(*keys, "equation", "active_terms").orderBy("threshold_index").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__best", F.min("rss").over(before))
    return c.where("__best IS NULL OR rss < __best - 1e-12").drop("__best")


def pareto_front(df: DataFrame, keys: list[str], size: str = "support_size", criterion: str = "ebic", tie: str = "candidate_id") -> DataFrame:
    """The best candidate for each support size, the first one on ties; adds the distance from the group's best."""
    w = Window.partitionBy(*keys, size).orderBy(criterion, tie)
    front = df.where(F.col(size) > 0).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return front.withColumn("delta_from_best", F.col(criterion) - F.min(criterion).over(Window.partitionBy(*keys)))


def _by_chord(front: DataFrame, keys: list[str], size: str, criterion: str) -> DataFrame:
    """Adds __chord, the order of a front's points by the chord, and __rule, what puts the first of them there."""
    w = Window.partitionBy(*keys)
    f = front.withColumn("__y", F.max(criterion).over(w) - F.col(criterion)).withColumn("__n", F.count("*").over(w))
    f = f.withColumn("__x0", F.min(size).over(w)).withColumn("__x1", F.max(size).over(w)).withColumn("__span", F.greatest(F.max("__y").over(w) - F.min("__y").over(w), F.lit(1e-12)))
    f = f.withColumn("__y0", F.min_by("__y", size).over(w)).withColumn("__y1", F.max_by("__y", size).over(w))
    u = (F.col(size) - F.col("__x0")) / F.greatest(F.col("__x1") - F.col("__x0"), F.lit(1)).cast("double")
    off = F.abs((F.col("__y") - F.col("__y0") - (F.col("__y1") - F.col("__y0")) * u) / F.col("__span"))
    f = f.withColumn("__d", F.round(off, 9))
    level = F.max(F.abs(F.col("__y") - F.col("__y0"))).over(w) <= 1e-8 + 1e-5 * F.abs("__y0")
    f = f.withColumn("__flat", (F.col("__n") <= 2) | level | (F.max("__d").over(w) <= 0))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("__flat"), F.col(criterion)).otherwise(-F.col("__d")), size))
    return f.withColumn("__chord", rank).withColumn("__rule", F.when(F.col("__n") == 1, "single").when(F.col("__flat"), "fallback_min_ebic").otherwise("elbow_ebic"))


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def chord_elbow(front: DataFrame, keys: list[str], size: str = "support_size", criterion: str = "ebic") -> DataFrame:
    """The front's point farthest from the chord between its ends (the smaller size on ties), with the rule that chose it:
    single, elbow_ebic, or fallback_min_ebic, the least criterion, where there are fewer than three points, the gain is
    flat, or no point lies off the chord."""
    return _plain(_by_chord(front, keys, size, criterion).where("__chord = 1").withColumn("selection_rule", F.col("__rule")))


def knees(front: DataFrame, keys: list[str], size: str = "support_size", criterion: str = "ebic", sensitivity: float = 1.0) -> DataFrame:
    """Adds __knee, whether a point is its front's knee by the published algorithm (Kneedle): of the normalised gain less the
    normalised size the first local maximum after which, and before the next one, the difference falls below the maximum less
    sensitivity times the mean step in size. Windows over the front; fronts of one or two points, or of one gain, have none."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(size)
    gain = F.max(criterion).over(w) - F.col(criterion)
    f = front.withColumn("__g", gain).withColumn("__n", F.count("*").over(w)).withColumn("__lo", F.min(size).over(w)).withColumn("__wide", F.max(size).over(w) - F.col("__lo"))
    f = f.withColumn("__high", F.max("__g").over(w) - F.min("__g").over(w)).withColumn("__least", F.min("__g").over(w))
    usable = (F.col("__n") >= 3) & (F.col("__wide") > 0) & (F.col("__high") > 0)
    f = f.withColumn("__dc", F.when(usable, (F.col("__g") - F.col("__least")) / F.col("__high") - (F.col(size) - F.col("__lo")) / F.col("__wide")))
    peak = (F.col("__dc") >= F.lag("__dc").over(order)) & (F.col("__dc") >= F.lead("__dc").over(order))
    f = f.withColumn("__peak", F.coalesce(peak, F.lit(False))).withColumn("__after", F.sum(F.col("__peak").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy(*keys, "__after")
    lowest = F.min(F.when(~F.col("__peak"), F.col("__dc"))).over(stretch)
    falls = F.col("__peak") & F.coalesce(lowest < F.col("__dc") - sensitivity / (F.col("__n") - 1), F.lit(False))
    first = F.min(F.when(F.col("__falls"), F.col(size))).over(w)
    return f.withColumn("__falls", falls).withColumn("__knee", F.coalesce(F.col(size) == first, F.lit(False))).drop("__g", "__n", "__lo", "__wide", "__high", "__least", "__dc", "__peak", "__after", "__falls")


def select_models(candidates: DataFrame, keys: list[str], size: str = "support_size", criterion: str = "ebic", tie: str = "candidate_id", sensitivity: float = 1.0) -> DataFrame:
    """One model for each group: the knee of its Pareto front, or by the chord, or the least criterion, with the rule that chose
    it. The choice sees size and criterion only, no truth columns."""
    f = _by_chord(knees(pareto_front(candidates, keys, size, criterion, tie), keys, size, criterion, sensitivity), keys, size, criterion)
    has = F.max("__knee").over(Window.partitionBy(*keys))
    f = f.withColumn("__has", has).where(F.when(F.col("__has"), F.col("__knee")).otherwise(F.col("__chord") == 1))
    return _plain(f.withColumn("selection_rule", F.when(F.col("__knee"), "elbow_ebic").otherwise(F.col("__rule"))))
