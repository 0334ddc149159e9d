"""Sample tables as cells: what verdicts and recovered values make of them, columns inserted where none is there."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions import text as X
from metaloom.operators import judge as J

NONE = "not available"
MODIFICATION = "modification"


def corrected(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """``cells`` (pxd, row_idx, col_idx, field, cell and more) after changes (pxd, row_idx, col_idx, turn, new), with ``action``: removed, removed_duplicate, corrected, or null.

    A null ``new`` empties a cell. Changes of a row happen in the order of ``turn``: a corrected modification that another
    modification column of the row holds at that time, whatever its style, is a duplicate and empties the cell instead. A row's
    changes are folded in one array, as long as the row has modification columns.
    """
    key = ["pxd", "row_idx", "col_idx"]
    j = cells.join(changes.select(*key, "turn", "new", F.lit(True).alias("__change")), key, "left")
    mods = j.filter(F.col("field") == MODIFICATION)
    rows = mods.groupBy("pxd", "row_idx").agg(
        F.collect_list(F.struct(F.col("col_idx").alias("c"), F.col("cell").alias("v"), F.lit(None).cast("string").alias("a"))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("__change"), F.struct("turn", F.col("col_idx").alias("c"), F.col("new").alias("n"))))).alias("e"),
    )

    def step(s, e):
        held = F.exists(s, lambda x: (x["c"] != e["c"]) & (J.modification_key(x["v"]) == J.modification_key(e["n"])))
        value = F.when(e["n"].isNull() | F.coalesce(held, F.lit(False)), F.lit(NONE)).otherwise(e["n"])
        action = F.when(e["n"].isNull(), "removed").when(F.coalesce(held, F.lit(False)), "removed_duplicate").otherwise("corrected")
        return F.transform(s, lambda x: F.when(x["c"] == e["c"], F.struct(x["c"].alias("c"), value.alias("v"), action.alias("a"))).otherwise(x))

    done = rows.select("pxd", "row_idx", F.explode(F.aggregate("e", F.col("s"), step)).alias("x")).select("pxd", "row_idx", F.col("x.c").alias("col_idx"), F.col("x.v").alias("__v"), F.col("x.a").alias("__a"))
    out = j.join(done, key, "left")
    mod, change = F.coalesce(F.col("field") == MODIFICATION, F.lit(False)), F.coalesce("__change", F.lit(False))
    cell = F.when(mod, F.col("__v")).when(change, F.coalesce("new", F.lit(NONE))).otherwise(F.col("cell"))
    action = F.when(mod, F.col("__a")).when(change, F.when(F.col("new").isNull(), "removed").otherwise("corrected"))
    return out.withColumn("cell", cell).withColumn("action", action).drop("turn", "new", "__change", "__v", "__a")


def filled(cells: DataFrame, recovered: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """(pxd, row_idx, col_idx, header, field, cell): tables (of these columns) with recovered values (pxd, seq, field, value), one value for all rows of a table.

    A value of a field fills the field's first column if no row holds a value there, and is left out if one does; a field
    without a column, but with a standard header, gets one before the first factor value, or at the end. Each modification fills
    the next modification column that is empty in all rows, or gets a column after the last of them, by the first one's header.
    Columns are numbered anew. Of several values of another field the first by seq counts.
    """
    known = ~X.is_nullish("cell", "sample")
    columns = cells.groupBy("pxd", "col_idx").agg(F.min("header").alias("header"), F.min("field").alias("field"), F.max(known.cast("int")).alias("known"))
    factor = F.lower(F.regexp_replace("header", r"\s", "")).startswith("factorvalue")
    is_mod = F.col("field") == MODIFICATION
    shape = columns.groupBy("pxd").agg(
        F.min(F.when(factor, F.col("col_idx"))).alias("factor"), F.max("col_idx").alias("last"), F.max(F.when(is_mod, F.col("col_idx"))).alias("last_mod"),
        F.min(F.when(is_mod, F.struct("col_idx", "header"))).alias("first_mod"), F.array_sort(F.collect_list(F.when(is_mod & (F.col("known") == 0), F.col("col_idx")))).alias("empty"),
    )
    first = columns.groupBy("pxd", "field").agg(F.min(F.struct("col_idx", "known")).alias("own"))
    r = recovered.filter(~X.is_nullish("value"))
    turn = F.row_number().over(W.partitionBy("pxd", "field").orderBy("seq"))
    r = r.withColumn("nth", turn).filter((F.col("field") == MODIFICATION) | (F.col("nth") == 1)).join(shape, "pxd").join(first, ["pxd", "field"], "left")
    standard = F.try_element_at(F.create_map(*[F.lit(x) for kv in headers.items() for x in kv]), F.col("field"))
    mod = F.col("field") == MODIFICATION
    place = F.when(mod, F.get("empty", F.col("nth") - 1)).when(F.col("own.known") == 0, F.col("own.col_idx"))
    new = F.when(mod, place.isNull()).otherwise(F.col("own").isNull() & standard.isNotNull())
    end = F.coalesce(F.col("factor") - 0.5, F.col("last") + 0.5)
    at = F.when(mod & F.col("last_mod").isNotNull(), F.struct((F.col("last_mod") + 0.5).alias("p"), F.lit(0).alias("k"), "seq")).otherwise(F.struct(end.alias("p"), F.lit(1).alias("k"), "seq"))
    r = r.select("pxd", "field", "value", place.alias("place"), new.alias("new"), at.alias("at"), F.when(mod, F.coalesce("first_mod.header", standard)).otherwise(standard).alias("header"))
    fills = r.filter("place is not null").select("pxd", F.col("place").alias("col_idx"), F.col("value").alias("__fill"))
    own = cells.join(fills, ["pxd", "col_idx"], "left").withColumn("cell", F.coalesce("__fill", "cell"))
    own = own.select("pxd", "row_idx", F.struct(F.col("col_idx").cast("double").alias("p"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("seq")).alias("at"), "header", "field", "cell")
    rows = cells.select("pxd", "row_idx").distinct()
    more = r.filter(F.col("place").isNull() & F.col("new")).join(rows, "pxd").select("pxd", "row_idx", F.struct(F.col("at.p").cast("double").alias("p"), F.col("at.k").alias("k"), F.col("at.seq").cast("long").alias("seq")).alias("at"), "header", "field", F.col("value").alias("cell"))
    every = own.unionByName(more)
    number = every.select("pxd", "at").distinct().withColumn("col_idx", F.row_number().over(W.partitionBy("pxd").orderBy("at")) - 1)
    return every.join(number, ["pxd", "at"]).select("pxd", "row_idx", "col_idx", "header", "field", "cell")
