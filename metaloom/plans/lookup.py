"""Queries of scoped negation, fuzzy joins, quotes in texts and the stored vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import text as S
from metaloom.operators import evaluation as E
from metaloom.operators import fuzzy as Z
from metaloom.operators import matching as V
from metaloom.operators import negation as N
from metaloom.operators import terms as T
from metaloom.operators import vector_index as X
from metaloom.session import shared_folder, table
from metaloom.streaming import incremental as I
from metaloom.streaming import retries as R

#: Sentences in which {v} is a value, the trigger that negates it or none.
SENTENCES = (
    ("No {v} was used in this study.", "no"),
    ("The samples were not only treated with {v} but also washed.", None),
    ("No copper was found, but {v} was.", None),
    ("{v} was not used.", "was not used"),
    ("All lots with {v} were excluded.", "were excluded"),
    ("The finish wasn’t done with {v}.", "n’t"),
    ("We excluded copper. {v} was kept.", None),
    ("Neither copper nor {v} was found", "neither"),
    ("Copper was taken instead of {v}; it was cheap.", "instead of"),
    ("Copper was not detected because {v} was used.", None),
    ("Steel, however, was without any trace of {v}, which was sought.", "without"),
    ("There was no doubt that {v} was used.", None),
    ("{v} was used, whereas steel was absent.", None),
    ("Washing failed to remove {v}!", "failed to"),
    ("We used {v}.\nNothing was free of dust.", None),
    ("inferred: no {v}", None),
)


def negation_flags(spark, sf_dir):
    """Parts whose evidence negates their type, with the trigger."""
    p, kinds = table(spark, sf_dir, "part"), len(SENTENCES)
    patterns = F.array(*[F.lit(s) for s, _ in SENTENCES])
    k = (F.col("p_partkey") % kinds).cast("int")
    value = F.when(F.col("p_partkey") % 7 == 0, F.lit("label-free")).otherwise(F.lower("p_type"))
    field = F.when(F.col("p_partkey") % 5 == 0, F.lit("_note")).otherwise(F.lit("type"))
    fields = p.select("p_partkey", field.alias("field"), value.alias("value"), F.replace(F.get(patterns, k), F.lit("{v}"), F.col("p_type")).alias("evidence"))
    return N.flags(fields).select("p_partkey", "value", "trigger", "type")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def index_exact(spark, sf_dir):
    """The five nearest of every twentieth vector by the stored index, all cells probed: 8-bit codes, then exact cosines."""
    v = _vectors(spark, sf_dir)
    index = X.opened(v, shared_folder(spark) + "/vector-index", "embeddings")
    found = X.search(index, v.filter("id % 20 = 0"), 5, probes=len(index.centroids))
    return found.select("q", "rank", "id", F.round("cosine", 6).alias("cosine"))


def index_search(spark, sf_dir):
    """As index_exact, but in as many cells as the index measured to hold nearly all."""
    v = _vectors(spark, sf_dir)
    index = X.opened(v, shared_folder(spark) + "/vector-index", "embeddings")
    return X.search(index, v.filter("id % 20 = 0"), 5).select("q", "rank", "id", F.round("cosine", 6).alias("cosine"))


def fuzzy_vocabulary(spark, sf_dir):
    """Words of benchmark passages and their likenesses among the words of conversations."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("word"))
    return Z.matches(words("benchmark"), words("conversations"), "word", 0.9).select("a", "b", F.round("ratio", 6).alias("ratio"))


def embedded_terms(spark, sf_dir):
    """Parts' names in five spellings, resolved by alias, exact name, synonym, or the nearest name by hashed n-grams."""
    p = table(spark, sf_dir, "part")
    node = F.concat(F.lit("P:"), F.min("p_partkey").cast("string"))
    names = p.groupBy("p_name").agg(node.alias("node")).select("node", F.col("p_name").alias("name"))
    synonyms = names.select("node", F.concat(F.lit("an item, "), "name").alias("synonym"), F.lit("EXACT").alias("scope"))
    names = names.unionAll(spark.createDataFrame([("UNIMOD:21", "Phospho"), ("UNIMOD:1", "Acetyl")], "node string, name string"))
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    term = F.when(k == 0, F.concat(F.lit(" "), F.upper(name))).when(k == 1, F.concat(name, F.lit("s"))).when(k == 2, F.lit("Phosphorylation")).when(k == 3, F.concat(F.lit("zzqq "), "p_brand"))
    term = term.when(k == 4, F.concat(F.lit("An  item, "), name)).otherwise(F.concat(F.lit("short "), F.col("p_partkey").cast("string")))
    items = p.select("p_partkey", term.alias("term"))
    expansions = p.filter(k == 5).select(F.concat(F.lit("short "), F.col("p_partkey").cast("string")).alias("term"), F.concat(name, F.lit("x")).alias("expanded"))
    return T.normalised(items, names, synonyms, expansions).select("p_partkey", "node", "method")


def field_scoring(spark, sf_dir):
    """Names of parts as values predicted for sizes and brands against those of the next size, by equal names or near n-grams."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_partkey").alias("seq"), F.col("p_name").alias("value"))
    golden = p.withColumn("p_size", F.col("p_size") - 1).withColumn("value", F.when(F.col("seq") % 3 == 0, F.concat("value", F.lit("s"))).otherwise(F.upper("value")))
    vectors = V.hashed_ngrams(p.select(F.col("value").alias("term")).unionAll(golden.select("value")))
    scores, _ = E.field_scores(p, golden, vectors, ["p_brand", "p_size"])
    return scores.withColumns({c: F.round(c, 6) for c in ("p", "r", "f1")})


ANSWERS = (  # a model's answers about {t}: the value that their JSON has, and what is saved of a broken one
    ('First {"type": "x"}. FINAL JSON: ```json\n{"type": "{t}", "n": {"a": "}"}}\n``` Done.', True, True),
    ('```json\n{"type": "{t}"}\n```', True, True),
    ('Sure: {"type": "{t}"} and then {no more', True, True),
    ('Here: {"type": "{t}", "list": [1', False, True),
    ("No answer.", False, False),
    ('{"type": "{t}"} or else {"other": "b"}', True, True),
    ('{"type": ["{t}", "evidence"], }', False, True),
)


def parsed_answers(spark, sf_dir):
    """A field of models' answers about parts: of their JSON, and of what a broken one still has."""
    p = table(spark, sf_dir, "part")
    patterns = F.array(*[F.lit(a) for a, _, _ in ANSWERS])
    raw = F.replace(F.get(patterns, (F.col("p_partkey") % len(ANSWERS)).cast("int")), F.lit("{t}"), F.col("p_type"))
    a = p.select("p_partkey", raw.alias("raw"))
    return a.select("p_partkey", F.get_json_object(S.answer_json("raw"), "$.type").alias("parsed"), F.try_element_at(S.salvage("raw"), F.lit("type")).alias("saved"))


def retried_answers(spark, sf_dir):
    """Turns of conversations as a stream of requests to a stand-in for a model, whose answers degenerate up to three times."""
    t = table(spark, sf_dir, "conversations")
    stream = I.follow(spark, f"{sf_dir}/conversations.parque[t]", t.schema, 1000)
    name = F.concat_ws(":", "conv_id", "turn")
    requests = stream.select(name.alias("key"), F.concat(F.lit("case "), ((F.col("conv_id") + F.col("turn")) % 5).cast("string")).alias("request"))
    found = R.drained(R.answered(requests, lambda request, attempt, heat: "- a- a" if attempt <= int(request.split()[1]) else f"{request}: sound", lambda answer: answer.endswith("sound")))
    return found.select("key", "attempt", F.round("temperature", 6).alias("temperature"), "answer", "sound", "asked")


def _quoted(s):
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


QUERIES = {f.__name__: f for f in (negation_flags, index_exact, index_search, fuzzy_vocabulary, embedded_terms, field_scoring, parsed_answers, retried_answers)}
ORACLES = {
    "embedded_terms": """
WITH n AS (SELECT p_name, 'P:' || min(p_partkey) node FROM part GROUP BY 1)
SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 'UNIMOD:21' WHEN 3 THEN NULL ELSE node END node,
  CASE p_partkey % 6 WHEN 0 THEN 'exact' WHEN 2 THEN 'unimod' WHEN 3 THEN 'unmapped' WHEN 4 THEN 'exact_synonym' ELSE 'semantic' END AS method FROM part JOIN n USING (p_name)""",
    "parsed_answers": f"""
WITH a AS (SELECT p_partkey, p_type, [{", ".join(str(x).lower() for _, x, _ in ANSWERS)}][p_partkey % {len(ANSWERS)} + 1] p, [{", ".join(str(x).lower() for _, _, x in ANSWERS)}][p_partkey % {len(ANSWERS)} + 1] s FROM part)
SELECT p_partkey, CASE WHEN p THEN p_type END parsed, CASE WHEN s THEN p_type END saved FROM a""",
    "retried_answers": """
WITH c AS (SELECT conv_id || ':' || turn AS key, (conv_id + turn) % 5 m FROM conversations)
SELECT key, least(m + 1, 3)::INT AS attempt, round(0.1 * (least(m + 1, 3) - 1), 6)::DOUBLE temperature, CASE WHEN m < 3 THEN 'case ' || m || ': sound' ELSE '- a- a' END answer, m < 3 sound, least(m + 1, 3)::BIGINT asked FROM c""",
    "index_exact": """
WITH v AS (SELECT vec_id id, embedding::DOUBLE[] x FROM embeddings), n AS (SELECT id, x, sqrt(list_inner_product(x, x)) l FROM v WHERE list_inner_product(x, x) > 0),
p AS (SELECT a.id q, b.id, list_inner_product(a.x, b.x) / (a.l * b.l) c FROM n a JOIN n b ON a.id % 20 = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) rank FROM p) SELECT q, rank::INT AS rank, id, round(c, 6) AS cosine FROM r WHERE rank <= 5""",
    "negation_flags": f"""
WITH t AS (SELECT p_partkey, lower(p_type) AS value, [{", ".join(_quoted(t) for _, t in SENTENCES)}][p_partkey % {len(SENTENCES)} + 1] AS trigger FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0)
SELECT p_partkey, value, trigger, 'negated_evidence' AS type FROM t WHERE trigger IS NOT NULL""",
}
