"""Writers. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def json_by(df: DataFrame, path: str, by: list[str], mode: str = "error") -> None:
    """A JSON line for each row, in folders by ``by``."""
    df.write.mode(mode).partitionBy(*by).json(path)


def merged_records(fields: DataFrame, agents: list[str]) -> DataFrame:
    """(doc_id, record): one JSON for each document from fields (doc_id, agent, field, value, evidence); the first agent wins a field, ``_provenance`` says which."""
    rank = F.array_position(F.array(*[F.lit(a) for a in agents]), F.col("agent"))
    best = fields.filter(rank > 0).groupBy("doc_id", "field").agg(F.min_by(F.struct("agent", "value", "evidence"), F.struct(rank, F.col("value"))).alias("b"))
    entry = F.struct("field", F.struct(F.col("b.value").alias("value"), F.col("b.evidence").alias("evidence")).alias("v"))
    g = best.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.col("b.agent").alias("agent"))))).alias("_provenance"))
    return g.select("doc_id", F.to_json(F.struct("fields", "_provenance")).alias("record"))


def csv_quoted(df: DataFrame, path: str, columns: list[str], mode: str = "append") -> None:
    """CSV with every cell in quotes, the given columns alone; appends, so batches add up."""
    df.select(*[F.col(c).cast("string") for c in columns]).write.mode(mode).csv(path, header=True, quoteAll=True)


def sample_lines(cells: DataFrame) -> DataFrame:
    """(pxd, line_no, line) of sample tables from their cells, the header first."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.col("cell").alias("v")))), lambda s: s["v"]), "\t").alias("line")
    head = cells.select("pxd", "col_idx", F.col("header").alias("cell")).distinct().groupBy("pxd").agg(row).select("pxd", F.lit(0).cast("long").alias("line_no"), "line")
    body = cells.groupBy("pxd", "row_idx").agg(row).select("pxd", (F.col("row_idx") + 1).cast("long").alias("line_no"), "line")
    return head.unionAll(body)


def sample_tables(cells: DataFrame, path: str, mode: str = "error") -> None:
    """Tab-separated lines in a folder for each table, in order."""
    lines = sample_lines(cells).repartition("pxd").sortWithinPartitions("pxd", "line_no")
    lines.select("pxd", "line").write.mode(mode).partitionBy("pxd").text(path)


def report(findings: DataFrame, path: str, kind: str, mode: str = "error") -> None:
    """Findings as CSV and JSON lines, and their counts by kind."""
    held = findings.persist()
    held.write.mode(mode).csv(f"{path}/findings_csv", header=True, quoteAll=True)
    held.write.mode(mode).json(f"{path}/findings_json")
    held.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).write.mode(mode).json(f"{path}/summary")
    held.unpersist()


def flat_groups(groups: DataFrame, fields: list[str], needed: list[str]) -> DataFrame:
    """(pxd, name, fields...) of nested sample groups, values joined by '; '; groups without any of ``needed`` are left out."""
    g = groups.select("pxd", F.explode("sample_groups").alias("g"))
    cols = [F.nullif(F.array_join(F.transform(F.col(f"g.{f}"), lambda x: x["value"]), "; "), F.lit("")).alias(f) for f in fields]
    return g.select("pxd", F.col("g.name").alias("name"), *cols).filter(F.coalesce(*[F.col(f) for f in needed]).isNotNull())


def term_vectors(df: DataFrame, path: str, mode: str = "error") -> None:
    """(onto, node_id, text, vec) by ontology, so that one is read alone."""
    df.write.mode(mode).partitionBy("onto").parquet(path)


def shard_manifest(files: DataFrame, shard: str) -> DataFrame:
    return files.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))


def clipped(text, most: int = 30_000):
    """Text for a spreadsheet cell: at most ``most`` characters, with a mark where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
