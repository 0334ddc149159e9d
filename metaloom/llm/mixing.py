"""Mixing of sources to token targets by entropy balancing: Newton steps over the table, then rounding; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.llm.common import discard, fresh, stored
from metaloom.llm.sharding import ranked

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources in the order of their code points, null last, take the weights in turn and share ``share`` times all sizes by
    weight; none gets over ``cap`` times its size, and the excess is shared again until none is above. That fixed point is
    the level L with sum(min(cap * size, weight * L)) = total: sorted by cap * size / weight, sources up to some place are
    full and the rest share what is left. The windows go over the aggregated sources, one row each.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("__w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    everything = W.partitionBy()
    s = s.withColumn("__total", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("__cap").over(everything)))
    by_level = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source").cast("binary"))
    upto = by_level.rowsBetween(W.unboundedPreceding, -1)
    full, light = F.coalesce(F.sum("__cap").over(upto), F.lit(0.0)), F.coalesce(F.sum("__w").over(upto), F.lit(0.0))
    s = s.withColumn("__level", (F.col("__total") - full) / (F.sum("__w").over(everything) - light))
    # The level is that of the first source that it doesn't fill; those of later ones are lower. Where all are filled, none is needed.
    s = s.withColumn("__level", F.max(F.when(F.col("__cap") >= F.col("__w") * F.col("__level"), F.col("__level"))).over(everything))
    return s.select("source", "source_size", F.least("__cap", F.coalesce(F.col("__w") * F.col("__level"), F.col("__cap"))).alias("target"))


LIMIT = 40.0  # multipliers of a source stay within: a rate is then 0 or the cap to within 1e-17


def rate_of(multiplier: Column, tilt: Column, x: Column, cap: float) -> Column:
    """The balanced rate, between 0 and ``cap``, nearest in entropy to equal rates: cap / (1 + exp(-(multiplier + tilt * x)))."""
    return F.lit(float(cap)) / (1 + F.exp(-(multiplier + tilt * x)))


def balance(classes: DataFrame, sums: DataFrame, cap: float, ridge: float, tolerance: float = 1e-7, most_steps: int = 120) -> tuple[DataFrame, float]:
    """The multipliers of the dual, (sid, m) by source, and the common tilt.

    ``classes``: (sid, mass, x), the words of the documents of a source that are alike in the covariate x; ``sums``: (sid,
    mass, target), a row per source. The constraints: each source's sum of mass * rate is its target, and the sum of mass *
    rate * x over all sources is 0, the latter with a penalty of ``ridge`` * tilt ** 2 / 2 so that a solution always
    exists. The dual is the sum of cap * mass * softplus(m + tilt * x) - m * target, which is convex. A Newton step
    aggregates its gradient and its Hessian over the classes: by source a gradient, a curvature and a cross term with the
    tilt, which a Schur complement of one number joins. Steps move the tilt by 1 at
    most and are halved until the dual falls. Should ``most_steps`` not do, an error is raised: other rates would not be
    balanced. Multipliers are a table, a
    row per source; only the sums over sources and the tilt are numbers on the driver.
    """
    share = F.least(F.greatest(F.col("target") / (F.col("mass") * F.lit(float(cap))), F.lit(1e-16)), F.lit(1 - 1e-16))
    start = F.when(F.col("mass") > 0, F.ln(share / (1 - share))).otherwise(0.0)
    now = sums.select("sid", "target", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), start)).alias("m"), F.lit(0.0).alias("dm"))
    now = stored(now, "multipliers")
    tilt, step_tilt, length, before = 0.0, 0.0, 1.0, None
    for _ in range(most_steps):
        # The dual, its gradient and Hessian at the multipliers moved by ``length`` times the last step.
        m = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("m") + F.lit(length) * F.col("dm")))
        at = tilt + length * step_tilt
        z = m + F.lit(at) * F.col("x")
        r, mass = rate_of(m, F.lit(at), F.col("x"), cap), F.col("mass")
        curve = mass * r * (1 - r / F.lit(float(cap)))
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        by = classes.join(now.select("sid", "m", "dm"), "sid").groupBy("sid").agg(
            F.sum(mass * r).alias("got"), F.sum(curve).alias("h"), F.sum(curve * F.col("x")).alias("b"), F.sum(curve * F.col("x") ** 2).alias("d"),
            F.sum(mass * r * F.col("x")).alias("moment"), F.sum(mass * soft * F.lit(float(cap))).alias("dual"),
        )
        by = stored(now.select("sid", "target", m.alias("m")).join(by, "sid", "left").na.fill(0.0).withColumn("h", F.col("h") + F.lit(1e-9) * F.col("target") + F.lit(1e-9)), "gradients")
        g = F.col("got") - F.col("target")
        total = by.agg(
            F.sum("moment").alias("moment"), F.sum("d").alias("d"), F.sum(F.col("b") * g / F.col("h")).alias("bg"), F.sum(F.col("b") ** 2 / F.col("h")).alias("bb"),
            F.sum(F.col("dual") - F.col("m") * F.col("target")).alias("dual"), F.sum(F.abs(g)).alias("miss"), F.sum("target").alias("target"),
        ).first()
        dual = (total["dual"] or 0.0) + ridge * at * at / 2
        if before is not None and dual > before + 1e-9 * abs(before) and length > 1e-6:
            discard(by.sparkSession, by)
            length /= 2
            continue
        before = dual
        slope = (total["moment"] or 0.0) + ridge * at
        # A source that is full or empty can't be moved: its curvature vanishes, and with it its step.
        step_tilt = -(slope - (total["bg"] or 0.0)) / max((total["d"] or 0.0) + ridge - (total["bb"] or 0.0), 1e-9)
        held, now = now, stored(by.select("sid", "target", "m", (-(g + F.col("b") * F.lit(step_tilt)) / F.col("h")).alias("dm")), "multipliers")
        discard(by.sparkSession, by)
        discard(now.sparkSession, held)
        tilt, length = at, min(1.0, 1 / max(abs(step_tilt), 1e-9))
        goal = tolerance * max(total["target"] or 0.0, 1.0)
        if (total["miss"] or 0.0) <= goal and abs(slope) <= goal:
            return now.select("sid", "m"), tilt
    raise RuntimeError(f"the balance was not met in {most_steps} steps: a miss of {total['miss']:g} of {total['target']:g} words, a slope of {slope:g}")


def _spread(c: DataFrame, cap: int) -> DataFrame:
    """Moves what a source still misses over its classes of at most a quarter of that size, as evenly as their room allows."""
    source, w = W.partitionBy("sid"), W.partitionBy("sid").orderBy(F.col("size").desc())
    owed = F.col("target") - F.sum(F.col("take") * F.col("size")).over(source)
    c = c.withColumn("__owed", owed)
    room = F.when(F.col("__owed") > 0, F.col("n") * cap - F.col("take")).otherwise(F.col("take"))
    c = c.withColumn("__room", F.when((F.col("size") > 0) & (F.col("size") * 4 <= F.abs("__owed")), room).otherwise(0))
    part = F.least(F.lit(1.0), F.try_divide(F.abs("__owed"), F.sum(F.col("__room") * F.col("size")).over(source)))
    c = c.withColumn("__part", F.col("__room") * F.coalesce(part, F.lit(0.0)))
    c = c.withColumn("__upto", F.floor(F.sum("__part").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + 0.5))
    move = F.least(F.col("__upto") - F.coalesce(F.lag("__upto").over(w), F.lit(0)), F.col("__room"))
    return c.withColumn("take", F.col("take") + F.signum("__owed").cast("long") * move).drop("__owed", "__room", "__part", "__upto")


def dealt(classes: DataFrame, cap: int) -> DataFrame:
    """Whole copies by class: adds ``take`` to (sid, size, n, rate, target).

    Within a source, largest sizes first, a class takes as many copies as bring the running sum of copies to the rounded
    running sum of n * rate; the words then miss the target by one text of the largest size at most. That miss is spread
    over smaller classes, three times over, and what remains is handed down the octaves of size: in each, the class with
    most copies to give or take, and at last that of the smallest size, moves by what comes nearest. A source has at most 64 octaves, so its fold is short; classes are never gathered.
    """
    w = W.partitionBy("sid").orderBy(F.col("size").desc())
    upto = F.sum(F.col("n") * F.col("rate")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    c = classes.withColumn("__upto", F.floor(upto + 0.5)).withColumn("take", F.col("__upto") - F.coalesce(F.lag("__upto").over(w), F.lit(0)))
    c = c.withColumn("take", F.greatest(F.lit(0), F.least(F.col("take"), F.col("n") * cap)).cast("long")).drop("__upto")
    for _ in range(3):
        c = _spread(c, cap)
    up = F.col("n") * cap - F.col("take")
    octave = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    rep = F.struct(F.least(up, F.col("take")).alias("slack"), (up + F.col("take")).alias("room"), (-F.col("size")).alias("z"), up.alias("up"), F.col("take").alias("down"))
    last = F.struct((-F.col("size")).alias("z"), up.alias("up"), F.col("take").alias("down"))
    sized = c.filter("size > 0")
    some = sized.groupBy("sid", octave.alias("octave")).agg(F.max(rep).alias("r")).select("sid", F.col("octave").alias("rank"), F.struct(F.col("r.z"), F.col("r.up"), F.col("r.down")).alias("r"))
    least = sized.groupBy("sid").agg(F.max(last).alias("r")).select("sid", F.lit(-1).alias("rank"), "r")
    owed = sized.groupBy("sid").agg((F.first("target") - F.sum(F.col("take") * F.col("size"))).alias("owed"))
    folds = some.unionAll(least).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("rank", "r")), asc=False).alias("reps")).join(owed, "sid")
    moves = F.array().cast("array<struct<size:bigint,move:bigint>>")

    def step(s: Column, x: Column) -> Column:
        size = -x["r"]["z"]
        seen = F.coalesce(F.aggregate(F.filter(s["out"], lambda o: o["size"] == size), F.lit(0).cast("long"), lambda a, o: a + o["move"]), F.lit(0).cast("long"))
        move = F.least(F.greatest(F.round(s["owed"] / size).cast("long"), -x["r"]["down"] - seen), x["r"]["up"] - seen)
        return F.struct((s["owed"] - move * size).alias("owed"), F.concat(s["out"], F.array(F.struct(size.alias("size"), move.alias("move")))).alias("out"))

    folded = F.aggregate("reps", F.struct(F.col("owed").cast("double").alias("owed"), moves.alias("out")), step)["out"]
    moved = folds.select("sid", F.explode(folded).alias("o")).groupBy(F.col("sid").alias("__sid"), F.col("o.size").alias("__size")).agg(F.sum("o.move").alias("move"))
    out = c.join(moved, (F.col("sid") == F.col("__sid")) & (F.col("size") == F.col("__size")), "left")
    return out.withColumn("take", F.col("take") + F.coalesce("move", F.lit(0))).drop("__sid", "__size", "move")


def _mixed(rows: DataFrame, slim: DataFrame, weights: Sequence[float], share: float, cap: int, ridge: float) -> DataFrame:
    """Adds source_size, target, rate and copies to ``rows`` (id, tie, source, size, ...); ``slim`` holds their source and size."""
    classes = stored(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    sums = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    t = targets(sums, weights, share, cap).withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")).cast("long"))
    t = stored(t, "targets")
    c = classes.join(t.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # The covariate: the log of a text's size, centred on its mean over all words and scaled.
    x = F.ln(F.greatest(F.col("size"), F.lit(1)).cast("double"))
    v = c.agg(F.sum(F.col("n") * F.col("size")).alias("w"), F.sum(F.col("n") * F.col("size") * x).alias("wx"), F.sum(F.col("n") * F.col("size") * x * x).alias("wxx")).first()
    words_ = float(v["w"] or 0)
    mean = v["wx"] / words_ if words_ else 0.0
    spread = math.sqrt(max(v["wxx"] / words_ - mean**2, 0.0)) if words_ else 0.0
    c = stored(c.withColumn("x", (x - F.lit(mean)) / F.lit(spread or 1.0)), "classes")
    steps = c.filter("size > 0").select("sid", (F.col("n") * F.col("size")).cast("double").alias("mass"), "x")
    m, tilt = balance(steps, t.select("sid", F.col("source_size").cast("double").alias("mass"), "target"), cap, ridge * max(words_, 1.0))
    rated = c.join(m, "sid").withColumn("rate", rate_of(F.col("m"), F.lit(tilt), F.col("x"), cap))
    d = stored(dealt(rated.select("sid", "source", "size", "n", "rate", "source_size", "target"), cap).select("source", "size", "n", "take", "rate", "source_size", "target"), "dealt")
    out = ranked(rows, ["source", "size"], ["id", "tie"], "__r", 256, d)
    copies = (F.expr("take div n") + (F.col("__r") < F.expr("take % n")).cast("long")).cast("int")
    return out.withColumn("copies", copies)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ridge: float = 0.25) -> DataFrame:
    """How often the mix takes each document.

    Columns: id_col, size (words), source_size, target (of its source), taken (copies * size), source_col, rate (the
    balanced rate), copies (0 to ``cap``).

    Rates are balanced by entropy (``balance``): each source's words come to its target, and the log of the texts' size
    keeps, over the words of the mix, the mean that it has over those of the corpus, as far as ``ridge`` (times all words)
    lets the tilt go. So where a source of short texts is taken more often, long texts of all sources gain, and rates differ
    within a source by size. Documents are counted by source and size, and Newton's steps aggregate those classes. The
    rates are rounded to whole copies by class (``dealt``), which go to the documents of a class in the order of a hash, ranked
    without gathering a class in one task. Reruns agree. Texts are scanned once.

    A source that is mostly one document can miss its target by up to half of that document, as copies are whole.

    Null texts and texts without words have size 0 and are taken a whole number of times near their rate, 0 words either
    way; null sources are one source; repeated rows count each; other columns are dropped, whatever their names; an empty
    table gives no rows.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), F.col(f"`{source_col}`").cast("string").alias("source"), words(text).alias("size")), "sizes")
    out = _mixed(rows, rows, weights, share, cap, ridge)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("source").alias(source_col), "rate", "copies")


def repeated(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ridge: float = 0.25) -> DataFrame:
    """The rows of ``docs``, with the columns they have, each as often as ``mix`` takes it.

    Whole rows are ranked and given their copies, without a join back by id, so rows that share an id, or have none, are
    taken as often as each was dealt. Names of columns clash with nothing: a row travels as one struct.
    """
    whole, *_ = fresh([], "whole")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), F.col(f"`{source_col}`").cast("string").alias("source"), words(text).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole)
    )
    slim = stored(rows.select("source", "size"), "sizes")
    out = _mixed(rows, slim, weights, share, cap, ridge).filter("copies > 0")
    return out.select(whole, F.explode(F.sequence(F.lit(1), "copies"))).select(f"{whole}.*")
