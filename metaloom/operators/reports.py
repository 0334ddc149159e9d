"""Reports: counts and shares of sources, projects, values and tiers. Each is one aggregation, or a short chain of them, over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import text as X


def joined(values: str | Column, separator: str = "; ") -> Column:
    """Aggregate: the distinct known values, sorted and joined; null without any."""
    v = F.col(values) if isinstance(values, str) else values
    return F.nullif(F.array_join(F.array_sort(F.collect_set(X.known(v))), separator), F.lit(""))


def frequent_labels(mentions: DataFrame, label: str, annotator: str, mentions_least: int = 3, annotators_least: int = 2) -> DataFrame:
    """(label, mentions, annotators) of the labels mentioned often enough, by annotators enough."""
    g = mentions.groupBy(label).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct(annotator).alias("annotators"))
    return g.filter((F.col("mentions") >= mentions_least) & (F.col("annotators") >= annotators_least))


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., n, mean, low, high) of a value."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def source_choice(rows: DataFrame, by: Sequence[str], choice: str, choices: Sequence[str], least: int = 50) -> DataFrame:
    """(by..., populated, n_<choice>...) of how often each source was chosen, for groups with ``least`` populated rows at least."""
    counts = [F.count_if(F.col(choice) == c).alias(f"n_{c}") for c in choices]
    return rows.groupBy(*by).agg(F.count(choice).alias("populated"), *counts).filter(F.col("populated") >= least)


def populated(long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., populated, distinct_values) of known values of a long table."""
    known = X.known(value)
    return long.groupBy(*by).agg(F.count(known).alias("populated"), F.countDistinct(known).alias("distinct_values"))


def normalisation_report(rows: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """(field, raw, norm, status, n, similarity, place) of normalised values (field, raw, norm, status, similarity, seq).

    similarity is the last seen by seq; place orders the report: by field, by the given order of statuses, by falling n.
    """
    g = rows.groupBy("field", "raw", "norm", "status").agg(F.count(F.lit(1)).alias("n"), F.max_by("similarity", "seq").alias("similarity"))
    rank = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
    w = W.partitionBy("field").orderBy(F.when(rank == 0, len(statuses) + 1).otherwise(rank), F.col("n").desc(), "raw", "norm")
    return g.withColumn("place", F.row_number().over(w))


def table_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, n_values, shown) of a table's columns: rows with a known value, distinct values, and those sorted and joined."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count(X.known("v")).alias("n"), F.countDistinct(X.known("v")).alias("n_values"), joined("v").alias("shown"))


def joined_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., value): the distinct known values of each key, sorted and joined."""
    return df.groupBy(*by).agg(joined(value).alias(value))


def setups(rows: DataFrame, project: str, setup: str) -> DataFrame:
    """(project, n_setups, kind): ``single`` or ``multi``."""
    g = rows.groupBy(project).agg(F.countDistinct(setup).alias("n_setups"))
    return g.withColumn("kind", F.when(F.col("n_setups") == 1, "single").otherwise("multi"))


def single_setup_runs(runs: DataFrame, rows: DataFrame, project: str, setup: str, columns: Sequence[str]) -> DataFrame:
    """Runs of projects with one setup alone, with that setup's columns. Spark broadcasts the setups where they are few."""
    one = rows.groupBy(project).agg(F.countDistinct(setup).alias("__n"), *[F.min(c).alias(c) for c in columns]).filter("__n = 1").drop("__n")
    return runs.join(one, project)


def agreement(df: DataFrame, by: Sequence[str], tier: str, lin: str) -> DataFrame:
    """(by..., n, exact_rate, mean_lin, near_or_exact)."""
    t = F.col(tier)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((t == "exact").cast("double")).alias("exact_rate"), F.avg(lin).alias("mean_lin"), F.avg(t.isin("exact", "near").cast("double")).alias("near_or_exact"))


def top_mass(df: DataFrame, by: str, vector: str, k: int = 5) -> DataFrame:
    """(by, place, mean): the mean of each place of a vector over a group's rows, counting a row's ``k`` largest components alone and 0 for the others."""
    order = F.slice(F.array_sort(F.transform(vector, lambda x, i: F.struct((-x.cast("double")).alias("m"), i.alias("place")))), 1, k)
    n = df.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__n"))
    long = df.select(by, F.explode(order).alias("x")).groupBy(by, "x.place").agg(F.sum(-F.col("x.m")).alias("s"))
    return long.join(n, F.col(by).eqNullSafe(F.col("__by"))).select(by, "place", (F.col("s") / F.col("__n")).alias("mean"))


def argmax(df: DataFrame, vector: str, least: float) -> DataFrame:
    """``df`` with the place and value of its vector's largest component, of equal ones the first; rows below ``least`` go."""
    best = F.element_at(F.array_sort(F.transform(vector, lambda x, i: F.struct((-x.cast("double")).alias("m"), i.alias("place")))), 1)
    return df.withColumn("__b", best).filter(-F.col("__b.m") >= least).select(*df.columns, F.col("__b.place").alias("place"), (-F.col("__b.m")).alias("top"))


def heterogeneity(df: DataFrame, project: str, predicted: str) -> DataFrame:
    """(project, runs, n_predicted, heterogeneous)."""
    g = df.groupBy(project).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct(predicted).alias("n_predicted"))
    return g.withColumn("heterogeneous", F.col("n_predicted") > 1)


def rates_by_column(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(column, n, raw_rate, norm_rate, equal_rate) of pairs of a raw and a normalised column: how many are known, and how many of both are one."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs])).alias("x")).select("x.*")
    a, b = X.known("a"), X.known("b")
    rate = lambda c: F.avg(c.cast("double"))
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), rate(a.isNotNull()).alias("raw_rate"), rate(b.isNotNull()).alias("norm_rate"), rate(F.when(a.isNotNull() & b.isNotNull(), X.key(a) == X.key(b))).alias("equal_rate"))


def by_cardinality(df: DataFrame, value: str, score: str) -> DataFrame:
    """(cardinality, n, mean): a score by whether a ';'-separated annotation holds one value or several."""
    n = F.size(X.split_set(value))
    return df.withColumn("cardinality", F.when(n == 0, "none").when(n == 1, "single").otherwise("multi")).groupBy("cardinality").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))


def last_casing(values: DataFrame, by: Sequence[str], value: str, seq: str) -> DataFrame:
    """(by..., value): values that differ in case alone are one, written as the last was."""
    return values.groupBy(*by, X.key(value).alias("__k")).agg(F.max_by(value, seq).alias(value)).drop("__k")


def set_coverage(predicted: DataFrame, annotated: DataFrame, project: str, value: str, least: int = 2) -> DataFrame:
    """(project, n_predicted, n_annotated, coverage): the share of predicted classes that are annotated, for projects of ``least`` annotations."""
    p = predicted.groupBy(project).agg(F.collect_set(value).alias("p"))
    a = annotated.groupBy(project).agg(F.collect_set(value).alias("a")).filter(F.size("a") >= least)
    share = M.ratio_or(F.size(F.array_intersect("p", "a")), F.size("p"), None)
    return p.join(a, project).select(project, F.size("p").alias("n_predicted"), F.size("a").alias("n_annotated"), share.alias("coverage"))


def depth_by_tier(df: DataFrame, tier: str, depth: str) -> DataFrame:
    """(tier, n, mean, median) of the depth of shared ancestors; rows without one count in n alone."""
    return df.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.avg(depth).alias("mean"), F.median(depth).alias("median"))


def metric_differences(df: DataFrame, key: Sequence[str], metrics: Sequence[str], top: int = 5) -> DataFrame:
    """(first, second, key..., difference, rank): for each two metrics the ``top`` rows in which they differ most. Rows are explored once; only ``top`` a task are kept before the last sort."""
    each = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.abs(F.col(a) - F.col(b)).alias("difference")) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    long = df.select(*key, F.explode(F.array(*each)).alias("x")).select("x.*", *key).filter("difference is not null")
    w = W.partitionBy("first", "second").orderBy(F.col("difference").desc(), *key)
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def separability(df: DataFrame, kind: str, near: str, conflict: str, metrics: Sequence[str]) -> DataFrame:
    """(metric, near_mean, conflict_mean, gap, ratio, rank): how far a metric sets near pairs apart from conflicting ones; rank 1 has the widest gap."""
    k = F.col(kind)
    long = df.select(kind, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(kind, "x.*")
    g = long.groupBy("metric").agg(F.avg(F.when(k == near, F.col("v"))).alias("near_mean"), F.avg(F.when(k == conflict, F.col("v"))).alias("conflict_mean"))
    g = g.withColumn("gap", F.col("near_mean") - F.col("conflict_mean")).withColumn("ratio", F.try_divide("near_mean", "conflict_mean"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.col("gap").desc_nulls_last(), "metric")))  # a row for each metric


def histogram(df: DataFrame, value: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n, share, cum_share) of a value in even bins from ``low`` to ``high``, the last closed; values outside count in the end bins."""
    at = F.floor((F.col(value) - low) / (high - low) * bins)
    g = df.filter(F.col(value).isNotNull()).groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())  # a row for each bin
    return g.select("bin", "n", (F.col("n") / total).alias("share"), (F.sum("n").over(W.orderBy("bin")) / total).alias("cum_share"))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, place, n): how many rows are left after each filter in turn, in one pass."""
    kept, counts = F.lit(True), []
    for k, (name, condition) in enumerate(steps):
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append((name, k, F.count_if(kept)))
    row = df.agg(*[c.alias(f"c{k}") for _, k, c in counts])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.lit(k).alias("place"), F.col(f"c{k}").alias("n")) for n, k, _ in counts])).alias("x")).select("x.*")


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """(a, one column for each given value of b) of row counts."""
    return df.groupBy(a).agg(*[F.count_if(F.col(b).eqNullSafe(F.lit(v))).alias(str(v)) for v in values])


def value_categories(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., category): the sorted distinct keys of a slot's values, joined, so that equal sets are equal categories."""
    return values.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(X.key(value))), "; ").alias("category"))


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` first rows by a unique column: a limit that the caller asks for, kept by each task before the last sort."""
    return df.orderBy(order).limit(n)


def with_all_sources(df: DataFrame, key: str, source: str, sources: Sequence[str]) -> DataFrame:
    """The keys that stand in every one of the given sources."""
    g = df.filter(F.col(source).isin(*sources)).groupBy(key).agg(F.countDistinct(source).alias("n"))
    return g.filter(F.col("n") == len(sources)).select(key)


def flagged_projects(df: DataFrame, project: str, flag: Column) -> DataFrame:
    """The rows of projects of which any row is flagged."""
    return df.join(df.filter(flag).select(project).distinct(), project, "left_semi")


def resolved_acquisition(runs: DataFrame, acquisition: DataFrame, key: Sequence[str], expected: str) -> DataFrame:
    """Runs with their acquisition: of several rows of a run those of the expected kind, if there is one; else all.

    acquisition: (key..., acquisition). Rows alike are one.
    """
    j = runs.join(acquisition.distinct(), list(key), "left")
    fits = (F.col("acquisition") == F.col(expected)).cast("int")
    w = W.partitionBy(*key)
    j = j.withColumn("__any", F.max(F.coalesce(fits, F.lit(0))).over(w))
    return j.filter((F.col("__any") == 0) | (F.coalesce(fits, F.lit(0)) == 1)).drop("__any").distinct()


def merged_metrics(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Metric tables merged on their common key; rows that one of them lacks go."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(key))
    return out


def list_lengths(raw: DataFrame, norm: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., n_raw, n_norm, status) of the numbers of known values before and after normalisation: ``same``, ``fewer``, ``more``, ``missing`` or ``extra``."""
    n = lambda d, c: d.groupBy(*key).agg(F.count(X.known("value")).alias(c))
    j = n(raw, "n_raw").join(n(norm, "n_norm"), list(key), "full")
    a, b = F.coalesce("n_raw", F.lit(0)), F.coalesce("n_norm", F.lit(0))
    status = F.when((a > 0) & (b == 0), "missing").when((a == 0) & (b > 0), "extra").when(a == b, "same").when(b < a, "fewer").otherwise("more")
    return j.select(*key, a.alias("n_raw"), b.alias("n_norm"), status.alias("status"))


def anonymous(df: DataFrame, rater: str, prefix: str = "R") -> DataFrame:
    """``df`` with raters named by their place in order, so that names don't show. A rater has one row in the table of names."""
    names = df.select(rater).distinct()
    names = names.select(F.col(rater).alias("__r"), F.concat(F.lit(prefix), F.row_number().over(W.orderBy(rater)).cast("string")).alias("anonymous"))
    return df.join(names, F.col(rater) == F.col("__r")).drop("__r")


def pair_kind(a: Column, b: Column) -> Column:
    """The kind of two raters by their roles, in either order."""
    return F.concat_ws("-", F.array_sort(F.array(F.coalesce(a, F.lit("unknown")), F.coalesce(b, F.lit("unknown")))))


def first_known(options: Sequence[tuple[Column, Column]]) -> Column:
    """(value, node) of the first option whose value is known."""
    all_ = F.array(*[F.struct(X.known(v).alias("value"), n.alias("node")) for v, n in options])
    return F.get(F.filter(all_, lambda x: x["value"].isNotNull()), F.lit(0))


def value_score(predicted: Column, golden: Column, cosine: Column, least: float = 0.75) -> Column:
    """1 for equal keys or a cosine of ``least``, else 0."""
    return F.when(X.key(predicted) == X.key(golden), 1.0).when(F.coalesce(cosine, F.lit(0.0)) >= least, 1.0).otherwise(0.0)


def subsets(df: DataFrame, conditions: Sequence[tuple[str, Column]], outcomes: Sequence[tuple[str, Column]]) -> DataFrame:
    """(subset, n, <outcome>...) of overlapping subsets of rows, each outcome its share, in one pass."""
    long = df.select(*[c.alias(f"__o{k}") for k, (_, c) in enumerate(outcomes)], F.explode(F.filter(F.array(*[F.when(c, n) for n, c in conditions]), lambda x: x.isNotNull())).alias("subset"))
    return long.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"__o{k}").cast("double")).alias(n) for k, (n, _) in enumerate(outcomes)])
