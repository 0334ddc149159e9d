"""Text, quality and table-repair queries over documents, pages, events and derived cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import text as X
from metaloom.operators import guards as Q
from metaloom.operators import matching as V
from metaloom.session import table


def evidence_status(spark, sf_dir):
    """Where each benchmark passage stands in documents."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return V.evidence_status(b, table(spark, sf_dir, "documents").select("doc_id", "text"))


def support_origin(spark, sf_dir):
    """Whether a document's first sentence stands in its first half, its second, both or neither (it may straddle them)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.select("doc_id", F.left("text", half).alias("a"), F.substr("text", half + 1).alias("b"), F.substring_index("text", ".", 1).alias("q"))
    return Q.support_origin(d, "a", "b", "q").select("doc_id", "origin")


def dedup_repeated_lines(spark, sf_dir):
    """Documents by the long lines that they repeat."""
    out = Q.without_repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 20)
    return out.select("doc_id", F.length("text").alias("n_left"), "dropped")


def url_field_extract(spark, sf_dir):
    """Host, section and number of page addresses."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, r"/([a-z]{2})/", 1).alias("section"), F.regexp_extract(u, r"/(\d+)", 1).try_cast("long").alias("number"))


def kv_parse_props(spark, sf_dir):
    """The number in an event's JSON properties, summed by type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


def _cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nt = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).when(F.col("p_partkey") % 5 == 1, F.lit("not available")).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("AC=B:"), (F.col("p_size") % 3).cast("string"), F.lit(";NT="), "p_type")).otherwise(F.concat(F.lit("NT="), F.upper("p_type"), F.lit(";AC=A:"), (F.col("p_size") % 4).cast("string")))
    return p.select(F.col("p_brand").alias("pxd"), F.lit("type").alias("field"), F.col("p_partkey").alias("row_idx"), (F.col("p_size") % 2).alias("col_idx"), nt.alias("cell"))


CELLS = """cells AS (SELECT p_brand pxd, 'type' field, p_partkey row_idx, p_size % 2 col_idx, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN 'not available' WHEN 2 THEN 'AC=B:' || (p_size % 3) || ';NT=' || p_type ELSE 'NT=' || upper(p_type) || ';AC=A:' || (p_size % 4) END cell FROM part)"""
UNIT = "lower(CASE WHEN contains(cell, '=') THEN 'NT=' || regexp_extract(cell, 'NT=([^;]*)', 1) ELSE trim(cell) END)"


def sdrf_units(spark, sf_dir):
    u = Q.units(_cells(spark, sf_dir))
    return u.select("pxd", "field", "unit", "n", F.size("rows").alias("rows"), F.size("cols").alias("cols"), F.array_join("variants", "|").alias("variants"))


def apply_verdicts(spark, sf_dir):
    """Cells after verdicts: one type is removed, another renamed."""
    c = _cells(spark, sf_dir)
    units = c.select("pxd", "field", X.cell_identity("cell").alias("unit")).distinct()
    v = F.when(F.col("unit").rlike("steel"), "remove").when(F.col("unit").rlike("brass|copper"), "replace").otherwise("keep")
    verdicts = units.select("pxd", "field", "unit", v.alias("verdict"), F.when(v == "replace", F.lit("Bronze")).alias("corrected"))
    return Q.apply_verdicts(c, verdicts).select("row_idx", "fixed")


def cell_coverage(spark, sf_dir):
    return Q.column_coverage(_cells(spark, sf_dir))


def cell_parse(spark, sf_dir):
    """Name and accession of cells."""
    return _cells(spark, sf_dir).select("row_idx", X.cell_value("cell").alias("nt"), X.cell_value("cell", "AC").alias("ac"))


def quantity_parse(spark, sf_dir):
    """Sizes written with unit prefixes, in base units."""
    p = table(spark, sf_dir, "part")
    s = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, F.lit(" mg")).when(F.col("p_partkey") % 4 == 1, F.lit("kDa")).when(F.col("p_partkey") % 4 == 2, F.lit(".5 uM")).otherwise(F.lit(" parts")))
    q = X.quantity(s)
    return p.select("p_partkey", F.round(q["value"], 9).alias("value"), q["unit"].alias("unit"))


def numeric_equivalence(spark, sf_dir):
    """Which written numbers equal the size: figures, words, or with a unit."""
    p = table(spark, sf_dir, "part")
    words = F.array(*[F.lit(w) for w in X.NUMBER_WORDS])
    s = F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_size") <= 20), F.concat(F.get(words, F.col("p_size")), F.lit(" replicates"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("n"), F.col("p_size").cast("string")))
    return p.select("p_partkey", F.coalesce(X.same_number(X.number_of(s), F.col("p_size").cast("double")), F.lit(False)).alias("same"))


def field_critiques(spark, sf_dir):
    """What is amiss with conversation turns' first words as values, given their text as evidence and the turn as source."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring_index("text", " ", 2).alias("value"), F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.substring_index("text", " ", 6)).otherwise(F.lit("made up words")).alias("evidence"), F.col("text").alias("source"))
    return c.select("conv_id", "turn", F.array_join(Q.critiques(F.col("value"), F.col("evidence"), F.col("source")), ";").alias("critiques"))


def mapping_compaction(spark, sf_dir):
    """Brands by type with the first three parts of each, a display by definition."""
    p = table(spark, sf_dir, "part").withColumn("key", F.format_string("%08d", "p_partkey"))
    return Q.compact_mapping(p, ["p_type"], "p_brand", "key")


def null_words(spark, sf_dir):
    """How many values each dialect takes for none."""
    p = table(spark, sf_dir, "part")
    s = F.when(F.col("p_partkey") % 9 == 0, " N/A ").when(F.col("p_partkey") % 9 == 1, "na").when(F.col("p_partkey") % 9 == 2, "Null").when(F.col("p_partkey") % 9 == 3, "not specified").when(F.col("p_partkey") % 9 == 4, "").otherwise(F.col("p_name"))
    return p.groupBy("p_brand").agg(*[F.count_if(X.is_nullish(s, d)).alias(d) for d in X.NULL_WORDS])


def retry_winner(spark, sf_dir):
    """Of events as attempts of a user and type, the one of highest value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("attempt"), F.lit(0.1).alias("temperature"), F.col("props").alias("value"), F.floor("value").cast("double").alias("confidence"))
    return Q.retry_winner(e, ["user_id", "event_type"]).select("user_id", "event_type", "attempt", "confidence")


def shard_completeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("shard", F.pmod("doc_id", F.lit(8)))
    labelled = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return Q.complete(d, labelled, labelled.filter("shard <> 3"), "shard")


def numeric_mismatches(spark, sf_dir):
    """Documents whose number of characters isn't among the numbers of an altered quote."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("string").alias("v"), F.concat(F.lit("counted "), (F.col("n_chars") + F.col("doc_id") % 2).cast("string"), F.lit(" in 3 ways")).alias("e"))
    return d.select("doc_id", Q.numeric_mismatch(F.col("v"), F.col("e")).alias("mismatch"))


QUERIES = {f.__name__: f for f in (evidence_status, support_origin, dedup_repeated_lines, url_field_extract, kv_parse_props, sdrf_units, apply_verdicts, cell_coverage, cell_parse, quantity_parse, numeric_equivalence, field_critiques, mapping_compaction, null_words, retry_winner, shard_completeness, numeric_mismatches)}

KEY = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
ORACLES = {
    "evidence_status": f"""WITH m AS (SELECT b.item_id, d.doc_id, CASE WHEN contains(d.text, b.text) THEN 'verbatim' ELSE 'normalized' END status FROM benchmark b JOIN documents d ON contains({KEY.format('d.text')}, {KEY.format('b.text')}))
      SELECT * FROM m UNION ALL SELECT item_id, NULL, 'absent' FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM m)""",
    "support_origin": f"""WITH d AS (SELECT doc_id, {KEY.format('left(text, n_chars // 2)')} a, {KEY.format('substr(text, n_chars // 2 + 1)')} b, {KEY.format("string_split(text, '.')[1]")} q FROM documents)
      SELECT doc_id, CASE WHEN contains(a, q) AND contains(b, q) THEN 'mixed' WHEN contains(a, q) THEN 'earlier_context' WHEN contains(b, q) THEN 'added_section' ELSE 'unverified' END origin FROM d""",
    "dedup_repeated_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents),
      r AS (SELECT *, CASE WHEN length(line) >= 20 THEN row_number() OVER (PARTITION BY doc_id, length(line) >= 20, {KEY.format('line')} ORDER BY i) ELSE 1 END k FROM l)
      SELECT doc_id, length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k = 1), '')) n_left, count(*) FILTER (k > 1) dropped FROM r GROUP BY doc_id""",
    "url_field_extract": "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) host, regexp_extract(url, '/([a-z]{2})/', 1) section, try_cast(regexp_extract(url, '/(\\d+)', 1) AS BIGINT) number FROM pages",
    "kv_parse_props": "SELECT event_type, count(k) n, sum(k)::BIGINT total, max(k) top FROM (SELECT event_type, (props->>'$.k')::BIGINT k FROM events) t GROUP BY 1",
    "sdrf_units": f"WITH {CELLS} SELECT pxd, field, {UNIT} unit, count(*) n, count(DISTINCT row_idx) AS rows, count(DISTINCT col_idx) cols, string_agg(DISTINCT cell, '|' ORDER BY cell) variants FROM cells WHERE cell <> 'not available' GROUP BY 1, 2, 3",
    "apply_verdicts": f"""WITH {CELLS} SELECT row_idx, CASE WHEN contains({UNIT}, 'steel') THEN 'not available' WHEN contains({UNIT}, 'brass') OR contains({UNIT}, 'copper') THEN CASE WHEN contains(cell, 'NT=') THEN 'NT=Bronze' ELSE 'Bronze' END ELSE cell END fixed FROM cells""",
    "cell_coverage": f"""WITH {CELLS}, g AS (SELECT pxd, field, count(*) AS rows, count(*) FILTER (cell <> 'not available') filled, count(DISTINCT CASE WHEN cell <> 'not available' THEN cell END) distinct_values FROM cells GROUP BY 1, 2)
      SELECT *, CASE WHEN filled = 0 THEN 'empty' WHEN filled < rows THEN 'partial' WHEN distinct_values = 1 THEN 'constant' ELSE 'varying' END status FROM g""",
    "cell_parse": f"WITH {CELLS} SELECT row_idx, CASE WHEN contains(cell, 'NT=') THEN regexp_extract(cell, 'NT=([^;]*)', 1) ELSE cell END nt, nullif(regexp_extract(cell, 'AC=([^;]*)', 1), '') ac FROM cells",
    "quantity_parse": """SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 0.001::DOUBLE WHEN 1 THEN p_size * 1000.0::DOUBLE WHEN 2 THEN (p_size + 0.5)::DOUBLE * 0.000001::DOUBLE END, 9) AS value, CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'Da' WHEN 2 THEN 'M' END unit FROM part""",
    "numeric_equivalence": "SELECT p_partkey, (p_partkey % 3 = 0 AND p_size <= 20) OR p_partkey % 3 = 1 same FROM part",
    "field_critiques": f"""WITH c AS (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:2], ' ') v, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN array_to_string(string_split(text, ' ')[1:6], ' ') ELSE 'made up words' END e, text s FROM conversations)
      SELECT conv_id, turn, concat_ws(';', CASE WHEN trim(v) <> '' AND e = '' THEN 'no_evidence' END, CASE WHEN trim(v) <> '' AND e <> '' AND NOT contains({KEY.format('s')}, {KEY.format('e')}) THEN 'not_in_text' END,
        CASE WHEN trim(v) <> '' AND NOT contains({KEY.format('s')}, {KEY.format('v')}) AND NOT contains({KEY.format('e')}, {KEY.format('v')}) THEN 'fabricated' END) critiques FROM c""",
    "mapping_compaction": "SELECT p_type, p_brand, count(*) n, array_to_string(list_sort(list(DISTINCT printf('%08d', p_partkey)))[1:3], '; ') first_keys FROM part GROUP BY 1, 2",
    "null_words": "SELECT p_brand, count(*) FILTER (p_partkey % 9 <= 4) matcher, count(*) FILTER (p_partkey % 9 IN (0, 4)) checker, count(*) FILTER (p_partkey % 9 IN (0, 1, 4)) AS sample, count(*) FILTER (p_partkey % 9 IN (0, 1, 2, 4)) compare FROM part GROUP BY 1",
    "retry_winner": "SELECT user_id, event_type, first(event_id ORDER BY floor(value) DESC, event_id) attempt, max(floor(value))::DOUBLE confidence FROM events GROUP BY 1, 2",
    "shard_completeness": """WITH d AS (SELECT doc_id % 8 shard, doc_id IN (SELECT doc_id FROM labels) l FROM documents), g AS (SELECT shard, count(*) expected, count(*) FILTER (l) raw, count(*) FILTER (l AND shard <> 3) normalised FROM d GROUP BY 1)
      SELECT *, expected = raw AND raw = normalised ok FROM g""",
    "numeric_mismatches": "SELECT doc_id, doc_id % 2 = 1 AND n_chars NOT IN (3) AS mismatch FROM documents",
}
