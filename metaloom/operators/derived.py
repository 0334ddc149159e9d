"""Maps that ontologies' own tables give: origins of cell lines, and tissues of diseases, cell types and tissue terms of other ontologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DERIVES_FROM = "RO:0001000"  # fixed value


def cell_line_origins(classes: DataFrame, prefix: str = "CLO:") -> DataFrame:
    """(id, label, species_ncbi, tissue_bto, tissue_uberon) of the classes (id, name, links) of cell lines.

    What a line derives from is told by its restrictions on DERIVES_FROM: a taxon, written NCBITaxon_9606, and a term of BTO or UBERON; of
    several of one kind the last. Classes without a label and without any of these are left out.
    """
    def last(space: str) -> Column:
        own = F.filter("links", lambda x: (x["relation"] == DERIVES_FROM) & x["target"].startswith(space))
        return F.try_element_at(F.transform(own, lambda x: x["target"]), F.lit(-1))

    c = classes.filter(F.col("id").startswith(prefix))
    c = c.select("id", F.trim(F.coalesce("name", F.lit(""))).alias("label"), F.replace(last("NCBITaxon:"), F.lit(":"), F.lit("_")).alias("species_ncbi"), last("BTO:").alias("tissue_bto"), last("UBERON:").alias("tissue_uberon"))
    return c.filter((F.col("label") != "") | F.coalesce("species_ncbi", "tissue_bto", "tissue_uberon").isNotNull())


def targets(tables: dict[str, DataFrame], relation: str, prefix: str = "UBERON:") -> DataFrame:
    """(id, tissues): the sorted terms of one namespace that terms stand in a relation to, of tables as of readers.obo_tables."""
    r = tables["relation"].filter((F.col("relation") == relation) & F.col("parent").startswith(prefix))
    return r.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias("tissues"))


def cross_references(tables: dict[str, DataFrame], prefix: str = "UBERON:") -> DataFrame:
    """(id, tissues): the sorted terms of one namespace that terms refer to."""
    return tables["xref"].filter(F.col("xref").startswith(prefix)).groupBy("id").agg(F.array_sort(F.collect_set("xref")).alias("tissues"))


def disease_tissues(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, tissues) of diseases: where they are located, or, of those of which that isn't told, what they refer to."""
    placed = targets(tables, "located_in")
    return placed.unionAll(cross_references(tables).join(placed, "id", "left_anti"))


def cell_type_tissues(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, tissues) of cell types: what they are part of."""
    return targets(tables, "part_of")
