"""Merging of sources: priorities with evidence trails, setups, fractions, sets and keep-first rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions.text import fraction_of
from metaloom.session import kept


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in an explicit order."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def union_first(sources: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """The union of sources, one row of each key: the earlier source's, within a source by ``order``."""
    parts = [s.withColumn("__s", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, key, [F.col("__s"), *[F.col(c) for c in order]]).drop("__s")


def fill(target: DataFrame, source: DataFrame, key: list[str], columns: list[str], name: str) -> DataFrame:
    """Fills empty columns of ``target`` from ``source`` and notes in '<column>_evidence' who agrees or differs.

    Values are ';' lists; two agree if they share one. The source's name is added where it fills or agrees, its name with
    a minus where it differs. Sources are applied in the order of their priority, one after another. Keep-first the
    source by ``key`` before. Extra columns of the source are left out.
    """
    s = source.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    j = target.join(s, key, "left")
    out = {}
    parts = lambda c: F.filter(F.transform(F.split(F.lower(c), ";"), lambda x: F.trim(x)), lambda x: x != "")
    for c in columns:
        cur, new = F.nullif(F.trim(F.col(c)), F.lit("")), F.nullif(F.trim(F.col(f"__{c}")), F.lit(""))
        note = M.evidence_note(cur, new, name, F.coalesce(M.overlaps(parts(cur), parts(new)), F.lit(False)))
        out[c] = F.coalesce(cur, new)
        out[f"{c}_evidence"] = F.nullif(F.concat_ws("; ", F.col(f"{c}_evidence"), note), F.lit(""))
    return j.withColumns(out).drop(*[f"__{c}" for c in columns])


def labelled(df: DataFrame, columns: list[tuple[str, str]], out: str, ambiguous: str | None = None) -> DataFrame:
    """``out``: the first non-null of (column, source) in their order, and ``<out>_source`` where it came from. With ``ambiguous``, a value that holds several parts by ';' is labelled that, and its source stays."""
    value = F.coalesce(*[F.col(c) for c, _ in columns])
    if ambiguous is not None:
        several = F.size(F.array_distinct(F.filter(F.transform(F.split(F.lower(value), ";"), lambda x: F.trim(x)), lambda x: x != ""))) > 1
        value = F.when(several, ambiguous).otherwise(value)
    source = F.lit(None).cast("string")
    for c, s in reversed(columns):
        source = F.when(F.col(c).isNotNull(), s).otherwise(source)
    return df.withColumns({out: value, f"{out}_source": source})


def best_setups(targets: DataFrame, setups: DataFrame, project: str, target: str, fields: list[str], value: str) -> DataFrame:
    """(project, target, score, setups, value): of a project's setups the one that shares most fields with the target; of several best ones, or where none shares any, all distinct values joined, sorted.

    Setups alike in their fields are one with a count, as are targets, so the join grows with a project's different
    setups and targets, not with its rows.
    """
    low = lambda c: F.lower(F.col(c).cast("string"))
    t = targets.select(F.col(project).alias("p"), F.col(target).alias("target"), *[low(f).alias(f"t{k}") for k, f in enumerate(fields)])
    s = setups.groupBy(F.col(project).alias("p"), *[low(f).alias(f"s{k}") for k, f in enumerate(fields)]).agg(F.count(F.lit(1)).alias("c"), F.collect_set(value).alias("vs"))
    kinds = t.select("p", *[f"t{k}" for k in range(len(fields))]).distinct()
    score = sum((F.coalesce((F.col(f"t{k}") == F.col(f"s{k}")).cast("int"), F.lit(0)) for k in range(len(fields))), F.lit(0))
    key = [f"t{k}" for k in range(len(fields))]
    best = kinds.join(s, "p").groupBy("p", *key, score.alias("score")).agg(F.sum("c").alias("setups"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))), "; ").alias("value"))
    best = best.groupBy("p", *key).agg(F.max_by(F.struct("score", "setups", "value"), "score").alias("b"))
    b = best.select(F.col("p").alias("__p"), *[F.col(c).alias(f"__{c}") for c in key], "b")
    on = [F.col("p") == F.col("__p")] + [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return t.join(b, on).select(F.col("p").alias(project), F.col("target").alias(target), "b.score", "b.setups", "b.value")


def fraction_groups(runs: DataFrame, project: str, run: str, least: int = 2) -> DataFrame:
    """(project, run, sample_base, fraction_id, group_size): runs whose names end in a fraction mark, of groups of ``least`` or more."""
    f = runs.select(project, run, fraction_of(run).alias("f")).filter("f is not null").select(project, run, "f.sample_base", "f.fraction_id")
    size = F.count(F.lit(1)).over(W.partitionBy(project, "sample_base"))
    return f.withColumn("group_size", size).filter(F.col("group_size") >= least)


def sample_keys(runs: DataFrame, fractions: DataFrame, project: str, run: str) -> DataFrame:
    """``runs`` with ``sample``: the base of a run's fraction group, or the run itself."""
    f = fractions.select(project, run, "sample_base")
    return runs.join(f, [project, run], "left").withColumn("sample", F.coalesce("sample_base", F.col(run))).drop("sample_base")


def mapped_runs(names: DataFrame, mapping: DataFrame, direct: DataFrame, project: str) -> DataFrame:
    """(project, run, via): runs named by a mapping's ';' list of raw files that exist, and runs that need no mapping."""
    files = mapping.select(project, F.explode(F.split("raw_files", ";")).alias("file")).select(project, F.trim("file").alias("run")).distinct()
    via = names.select(project, "run").join(files, [project, "run"], "left_semi").withColumn("via", F.lit("mapping"))
    rest = direct.select(project, "run").join(files.select(project).distinct(), project, "left_anti").withColumn("via", F.lit("direct"))
    return via.unionByName(rest)


def run_key(rows: DataFrame, table_id: str, candidates: list[str], order: str) -> DataFrame:
    """``rows`` with ``run_key``: the first of ``candidates`` that is filled and unique over a table's rows, else the row's number by ``order``."""
    stats = rows.groupBy(F.col(table_id).alias("__t")).agg(*[((F.count(c) == F.count(F.lit(1))) & (F.countDistinct(c) == F.count(F.lit(1)))).alias(f"__{c}") for c in candidates])
    j = rows.join(stats, F.col(table_id) == F.col("__t"))
    number = F.row_number().over(W.partitionBy(table_id).orderBy(order)).cast("string")
    key = F.coalesce(*[F.when(F.col(f"__{c}"), F.col(c).cast("string")) for c in candidates], number)
    return j.withColumn("run_key", key).drop("__t", *[f"__{c}" for c in candidates])


def accession_drift(cells: DataFrame, group: list[str], accession: str, least: int = 3) -> DataFrame:
    """(group, n, low, high): groups whose accessions share a prefix and are ``least`` or more consecutive numbers, as filling down makes them."""
    a = cells.select(*group, F.regexp_extract(accession, r"^(.*?)(\d+)$", 1).alias("prefix"), F.regexp_extract(accession, r"^(.*?)(\d+)$", 2).try_cast("long").alias("number")).filter("number is not null")
    g = a.groupBy(*group).agg(F.countDistinct("prefix").alias("p"), F.countDistinct("number").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"))
    return g.filter((F.col("p") == 1) & (F.col("n") >= least) & (F.col("high") - F.col("low") + 1 == F.col("n"))).drop("p")


def without_drift(cells: DataFrame, group: list[str], accession: str) -> DataFrame:
    """``cells`` with accessions that ran on by ones set back to the least of their group."""
    drift = accession_drift(cells, group, accession).select(*[F.col(g).alias(f"__{g}") for g in group], "low")
    j = cells.join(drift, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], "left").drop(*[f"__{g}" for g in group])
    back = F.concat(F.regexp_extract(accession, r"^(.*?)(\d+)$", 1), F.col("low").cast("string"))
    return j.withColumn(accession, F.when(F.col("low").isNotNull(), back).otherwise(F.col(accession))).drop("low")


def first_agent(values: DataFrame, key: list[str], agents: list[str]) -> DataFrame:
    """One value of each key, that of the earliest agent in ``agents``, with all that gave one in ``given_by``."""
    rank = F.array_position(F.array(*[F.lit(a) for a in agents]), F.col("agent"))
    ranked = values.filter(rank > 0).withColumn("__r", rank)
    return ranked.groupBy(*key).agg(F.min_by("value", F.struct("__r", "value")).alias("value"), F.min_by("agent", "__r").alias("agent"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("__r", "agent"))), lambda s: s["agent"]), "; ").alias("given_by"))


def resolve_conflict(df: DataFrame, curated: str, extracted: str, score: str | None = None, similar: Column | None = None) -> DataFrame:
    """Adds ``resolved``, ``status`` and ``confidence`` of a repository's value against an extracted one.

    AGREE if either contains the other, or ``similar`` holds, else DISAGREE; LLM_ONLY, RUNASSESSOR_ONLY or UNKNOWN where
    one or both say nothing. The repository's value always wins, with its score as confidence, else .5; else 0.
    """
    a, b = (F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in (curated, extracted))
    same = F.contains(a, b) | F.contains(b, a)
    if similar is not None:
        same = same | F.coalesce(similar, F.lit(False))
    status = F.when(a.isNull() & b.isNull(), "UNKNOWN").when(a.isNull(), "LLM_ONLY").when(b.isNull(), "RUNASSESSOR_ONLY").when(same, "AGREE").otherwise("DISAGREE")
    conf = F.when(a.isNotNull(), F.coalesce(F.col(score) if score else F.lit(None), F.lit(0.5))).when(b.isNotNull(), 0.5).otherwise(0.0)
    return df.withColumns({"resolved": F.when(a.isNotNull(), F.col(curated)).otherwise(F.col(extracted)), "status": status, "confidence": conf.cast("double")})


def align_columns(cells: DataFrame, file: str, row: str, column: str, header: str) -> DataFrame:
    """``cells`` with ``occ``: which of a file's columns of one header a cell is in, from 0. Tables whose headers repeat are unioned by (header, occ)."""
    heads = cells.select(file, column, header).distinct()
    occ = F.row_number().over(W.partitionBy(file, header).orderBy(column)) - 1
    return cells.join(heads.select(file, column, header, occ.alias("occ")), [file, column, header])


def split_groups(df: DataFrame, group: str, shares: dict[str, float], seed: str = "1") -> DataFrame:
    """``df`` with ``split``: whole groups dealt by a hash, in about the given shares; the same in each run. A null group is one group."""
    digest = F.md5(F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(f"|{seed}")))
    u = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") / float(1 << 32)
    out, at = F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())):
        out = F.when(u < at, name).otherwise(out)
        at -= share
    return df.withColumn("split", out)


def shards(files: DataFrame, order: str, n: int) -> DataFrame:
    """``files`` with ``shard``: dealt round robin in sorted order.

    Spark sorts by ranges; a row's place is its place in its range and the sizes of the ranges before, which are a row for
    each task. The ranges are checkpointed once, so that both are of the same cut. No task sorts all files.
    """
    sorted_ = kept(files.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()))
    counts = sorted_.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col("__part").alias("__k"), (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1
    return sorted_.join(before, F.col("__part") == F.col("__k")).withColumn("shard", F.pmod(place, F.lit(n)).cast("int")).drop("__part", "__k", "__before")


def repair_manifest(expected: DataFrame, raw: DataFrame, normalised: DataFrame, key: list[str]) -> DataFrame:
    """Expected keys that lack a raw or a normalised record."""
    return expected.select(*key).distinct().join(raw.select(*key).intersect(normalised.select(*key)), key, "left_anti")


def uncached(requests: DataFrame, cache: DataFrame, parts: list[str]) -> DataFrame:
    """Requests with their ``key`` (SHA-256 of the parts) that the cache (key, response) lacks: what is left to call."""
    k = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(p).cast("string"), F.lit("␀")) for p in parts]), 256)
    return requests.withColumn("key", k).join(cache.select("key"), "key", "left_anti")
