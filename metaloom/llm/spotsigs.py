"""SpotSigs fingerprints: chains of content words that follow common words; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.llm.common import stored

#: Fixed value: common words of English, German, French and Spanish.
COMMON = (
    "a an and are as at be by for from has have he in is it not of on or that the this to was were which will with "
    "als auf auch aus bei das dem den der des die ein eine einen einer es für im ist mit nicht oder sich sie sind und von wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils la le les ne ou par pas pour que qui se sont sur un une "
    "al como con del el ella en es esta la las lo los no o para pero por que se sin su sus un una y"
).split()


def _joined(words: Sequence[str]) -> str:
    return "|".join(sorted(set(words), key=lambda w: (-len(w), w)))


def with_signatures(df: DataFrame, text: str, out: str, common: Sequence[str] = COMMON, chain: int = 2) -> DataFrame:
    """Adds ``out``: the sorted distinct 32-bit signatures of the text, as an array of ints.

    Words are runs of letters and digits, lower case. Each common word (anchor) gives the chain of itself and the next
    ``chain`` content words, that is words not in ``common``; at the text's end the chain is shorter, but has one content
    word at least. A text with no such anchor, but with words, has the chains of ``chain`` + 1 words from each word
    instead. A text without words has none.

    The steps are columns of their own: a lambda that held an earlier step's expression would make it again for each word.
    """
    tied, tokens, content, tails = (f"__{out}_{x}" for x in ("tied", "tokens", "content", "tails"))
    letters = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    # Common words are tied to the content word after them, so that one token is: anchors, then the content word.
    longest = max(map(len, common))
    df = df.withColumn(tied, F.regexp_replace(letters, rf"(?<![^ ])(?=[^ ]{{1,{longest}}} )({_joined(common)}) ", "$1~"))
    df = df.withColumn(tokens, F.split(tied, " "))
    df = df.withColumn(content, F.transform(tokens, lambda t: F.substring_index(t, "~", -1)))
    after = F.col(content)
    for k in range(2, chain + 1):
        after = F.zip_with(after, F.slice(content, k, 1 << 30), lambda x, y: F.when(x.isNotNull(), F.concat_ws(" ", x, y)))
    df = df.withColumn(tails, after)

    def spot(t: Column, tail: Column) -> Column:
        parts = F.split(t, "~")
        return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda a: F.hash(F.concat_ws(" ", a, tail)))

    empty = F.array().cast("array<int>")
    spots = F.flatten(F.zip_with(tokens, tails, lambda t, tail: F.when(F.contains(t, F.lit("~")), spot(t, tail)).otherwise(empty)))
    plain = F.zip_with(tails, F.slice(content, chain + 1, 1 << 30), lambda t, x: F.hash(F.concat_ws(" ", t, x)))
    sigs = F.when(F.col(tied) == "", empty).when(F.contains(F.col(tied), F.lit("~")), spots).otherwise(plain)
    return df.withColumn(out, F.array_sort(F.array_distinct(sigs))).drop(tied, tokens, content, tails)


def fingerprint(sigs: Column) -> Column:
    """The signatures as one string, 8 hexadecimal digits each."""
    return F.concat_ws("", F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")))


def band(n: Column, least: float) -> Column:
    """The partition of a set of ``n`` signatures: sets whose likeness is ``least`` or more are in one band or in neighbours. Empty sets are in -1."""
    return F.when(n > 0, F.floor(F.ln(n.cast("double")) / F.lit(-math.log(least)))).otherwise(-1)


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets of signatures; two empty sets are alike.

    With ``least``, that of pairs below it is 0: sets in partitions that don't touch, and those whose lengths alone keep the
    likeness below ``least``, are not looked at. Without, it is exact.
    """
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    if not least:
        return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(common / (n + m - common))
    apart = (F.abs(band(n, least) - band(m, least)) > 1) | (F.least(n, m) < F.lit(float(least)) * F.greatest(n, m))
    exact = common / (n + m - common)
    return F.when((n == 0) & (m == 0), 1.0).when(apart, 0.0).otherwise(F.when(exact >= F.lit(float(least)), exact).otherwise(0.0))


def buckets_of(docs: DataFrame, key: str, rows_a_bucket: int = 2000, most: int = 1024) -> Column:
    """The range of the numeric ``key`` that a row is in, numbered upwards; -1 for null.

    At most ``most`` quantiles cut the keys; each of those ranges is cut evenly into as many as bring about
    ``rows_a_bucket`` rows into one, so ranges grow in number with the table, not in size.
    """
    v = docs.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    parts = max(1, v["n"] // rows_a_bucket)
    n = min(most, parts)
    cuts = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.lit(cuts), lambda b: b < F.col(key))) if cuts else F.lit(0)
    if (fine := -(-parts // n)) > 1 and v["lo"] is not None:
        lo, hi = (F.element_at(F.lit([float(x) for x in xs]), bucket + 1) for xs in ([v["lo"], *cuts], [*cuts, v["hi"]]))
        part = F.floor((F.col(key).cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * F.lit(fine))
        bucket = bucket.cast("long") * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), part))
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(bucket).cast("long")


def near_pairs(docs: DataFrame, least: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text", chain: int = 2) -> DataFrame:
    """Pairs (a, b, likeness) of classes of documents with equal signatures, each named by its smallest id, of likeness ``least`` or more.

    Sets are partitioned by length: lengths fall in bands of ratio ``least``, and only sets in one band or in neighbours
    can be alike. Within a band, sets meet on the rarest signatures of their sorted order, as many as a match must share
    one of (prefix filter), and pairs are then compared with the length bound first. A signature kept by many sets makes
    many candidates; it comes last in the order, so few sets index it.
    """
    base = with_signatures(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "sigs", chain=chain).filter("id is not null").filter(F.size("sigs") > 0)
    sets = base.groupBy("sigs").agg(F.min("id").alias("id")).withColumn("n", F.size("sigs"))
    freq = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = sets.select("id", "n", F.explode("sigs").alias("sig")).join(freq, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("o"))
    prefix = (F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).cast("int")
    index = ranked.select("id", "n", band(F.col("n"), least).alias("band"), F.explode(F.slice(F.transform("o", lambda x: x["sig"]), 1, prefix)).alias("sig"))
    left = index.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = index.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", "band")
    met = left.join(right, ["sig", "band"]).filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))).filter(F.col("na") >= F.col("nb") * F.lit(least)).select("a", "b").distinct()
    x = sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb"))
    scored = met.join(x, "a").join(y, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb"), least).alias("likeness")).filter(F.col("likeness") >= least)
    return scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", common: Sequence[str] = COMMON, chain: int = 2, least: float = 0.8) -> DataFrame:
    """Each whole text's fingerprint beside that of its edited text and its likeness to that and to the next document.

    The next document is the one with the next smaller id, after the last the first (a sole document is its own next). The
    edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next text.
    Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, band, edited_band: the
    partitions by length of the two sets, for pairs of likeness ``least``. Likeness is exact, however small.

    Null texts are empty; an empty text has no signatures, an empty fingerprint, and likeness 1 to another such and 0 to
    any other; repeated ids follow one another in the order of a hash; null ids come last; other columns are dropped,
    whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    base = base.withColumn("bucket", buckets_of(base.select("id"), "id"))
    # Rows are dealt by ranges of ids. The row after a range's last is the first of the range below, found by one
    # aggregate of a row for each range, so no task orders the whole table.
    order = F.struct("id", F.xxhash64("text"))
    firsts = base.groupBy(F.col("bucket").alias("b")).agg(F.max_by("text", order).alias("text"))
    firsts = stored(with_signatures(firsts, "text", "sigs", common, chain).select("b", F.struct("text", "sigs").alias("row")), "firsts")
    # The ring of ranges is made of their numbers alone.
    ring = W.orderBy(F.col("b").desc())
    below = F.coalesce(F.lead("b").over(ring), F.first("b").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = firsts.select("b", below.alias("__below")).join(firsts.select(F.col("b").alias("__b"), F.col("row").alias("below")), F.col("__below") == F.col("__b")).select("b", "below")
    # Signatures go along with the texts in the one shuffle, so they are made once for each document.
    own = with_signatures(base, "text", "sigs", common, chain)
    w = W.partitionBy("bucket").orderBy(F.col("id").desc(), F.xxhash64("text").desc())
    following = F.coalesce(F.lead(F.struct("text", "sigs")).over(w), F.col("below"))
    rows = own.join(heads, F.col("bucket") == F.col("b")).select("id", "text", "sigs", following.alias("next"))
    n = F.length("text")
    third = F.floor(n / F.lit(3)).cast("int")
    edited = F.concat(F.left(F.col("text"), n - third), F.left(F.col("next.text"), third))
    rows = rows.select("id", "sigs", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("next.sigs").alias("next_sigs"))
    rows = with_signatures(rows, "edited", "edited_sigs", common, chain)
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        band(F.size("sigs"), least).cast("int").alias("band"),
        band(F.size("edited_sigs"), least).cast("int").alias("edited_band"),
    )
