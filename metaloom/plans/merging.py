"""Priority merges, conflicts, setups, fractions and set comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import text as X
from metaloom.operators import merge as G
from metaloom.session import table


def priority_fill_evidence(spark, sf_dir):
    """Orders with a status filled from the customer's segment and then the priority, with an evidence trail."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    target = o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("label"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("sdrf")).alias("label_evidence"))
    one = o.join(c, o["o_custkey"] == c["c_custkey"]).filter("o_orderkey % 2 = 0").select("o_orderkey", F.concat_ws("; ", "c_mktsegment", "o_orderpriority").alias("label"))
    two = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.lower("o_orderpriority")).alias("label"))
    out = G.fill(target, one, ["o_orderkey"], ["label"], "name")
    return G.fill(out, two, ["o_orderkey"], ["label"], "agent").select("o_orderkey", "label", "label_evidence")


def label_provenance(spark, sf_dir):
    """The first given of three columns of a part, and which it was."""
    p = table(spark, sf_dir, "part")
    d = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("a"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("b"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("c"))
    return G.labelled(d, [("a", "sdrf"), ("b", "name"), ("c", "agent")], "label").select("p_partkey", "label", "label_source")


def setup_best_match(spark, sf_dir):
    """Per order line the part setups of its supplier's nation that share most of size class, type and brand."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 199).alias("project"), F.col("p_partkey"), (F.col("p_size") % 5).cast("string").alias("f1"), F.lower("p_type").alias("f2"), F.col("p_brand").alias("f3"))
    return G.best_setups(p.filter("p_partkey % 4 = 0"), p.filter("p_partkey % 4 <> 0"), "project", "p_partkey", ["f1", "f2", "f3"], "f3")


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("_F"), (F.col("event_id") % 17).cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("_fraction_"), (F.col("event_id") % 17).cast("string"))).otherwise("_x"))
    return e.select(F.concat(F.lit("P"), (F.col("user_id") % 10).cast("string")).alias("project"), name.alias("run")).distinct()


def fraction_groups(spark, sf_dir):
    return G.fraction_groups(_runs(spark, sf_dir), "project", "run").withColumn("group_size", F.col("group_size").cast("long"))


def sample_counts(spark, sf_dir):
    """How many runs each sample has, fractions under their base."""
    r = _runs(spark, sf_dir)
    return G.sample_keys(r, G.fraction_groups(r, "project", "run"), "project", "run").groupBy("project", "sample").agg(F.count(F.lit(1)).alias("runs"))


def accession_drift(spark, sf_dir):
    """Customers' order keys as accessions, where they run on by ones."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4000).alias("grp"), F.concat(F.lit("MOD:"), (F.floor(F.col("o_orderkey") / 4000) + F.when(F.col("o_orderkey") % 4000 % 3 == 0, F.col("o_orderkey") % 2).otherwise(0)).cast("string")).alias("acc"))
    return G.accession_drift(o, ["grp"], "acc")


def agree_disagree_status(spark, sf_dir):
    """Customer names against their order's clerkless label: who wins and whether they agree."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("curated"), F.when(F.col("c_custkey") % 5 != 0, F.when(F.col("c_custkey") % 3 == 0, F.left(F.lower("c_mktsegment"), F.lit(4))).otherwise(F.lit("HOUSEHOLD"))).alias("extracted"), (F.round(F.col("c_acctbal") / 10000, 2) + 0.0).alias("score"))
    return G.resolve_conflict(c, "curated", "extracted", "score").select("c_custkey", "resolved", "status", "confidence")


def provenance_first_wins(spark, sf_dir):
    """Per conversation turn parity the value of the earliest role, with all that gave one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).alias("field"), F.col("role").alias("agent"), F.col("text").alias("value"))
    return G.first_agent(c, ["conv_id", "field"], ["system", "assistant", "user"])


def set_change_status(spark, sf_dir):
    """How the event types of users changed from one half of the month to the other."""
    e = table(spark, sf_dir, "events")
    half = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "a").otherwise("b")
    g = e.withColumn("half", half).groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("half") == "a", F.col("event_type")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("half") == "b", F.col("event_type")))).alias("b"))
    return g.select("user_id", M.set_status(F.col("a"), F.col("b")).alias("status"), F.round(M.set_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), M.match_kind(F.col("a"), F.col("b")).alias("kind"))


def pair_value_overlap(spark, sf_dir):
    """For each two neighbouring users, whether their event types of a day overlap."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("types"))
    y = e.select((F.col("user_id") - 1).alias("user_id"), "day", F.col("types").alias("other"))
    j = e.join(y, ["user_id", "day"])
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.count_if(M.overlaps(F.col("types"), F.col("other"))).alias("overlapping"))


def key_normalised_exact_dups(spark, sf_dir):
    """Documents whose key equals an earlier document's: the first of each stays, with how many there are."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(X.key("text")).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "n")


def union_keep_first(spark, sf_dir):
    """Nations of customers and suppliers, customers first, one row each."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind"))
    return G.union_first([c.filter("nation % 2 = 0"), s], ["nation"], ["key"])


def group_split(spark, sf_dir):
    """Documents dealt by whole sources in about 90, 5 and 5 parts of a hundred."""
    return G.split_groups(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", {"train": 0.9, "val": 0.05, "test": 0.05})


def round_robin_shards(spark, sf_dir):
    return G.shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


def repair_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    l = table(spark, sf_dir, "labels").select("doc_id")  # noqa: E741
    return G.repair_manifest(d, l, l.filter("doc_id % 2 = 0"), ["doc_id"])


def uncached_requests(spark, sf_dir):
    """Turns whose text no earlier conversation has asked."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    cache = c.filter("conv_id % 2 = 0").select(F.sha2(F.concat_ws("\u001f", "text"), 256).alias("key")).distinct()
    return G.uncached(c, cache, ["text"]).select("conv_id", "turn", "key")


def run_keys(spark, sf_dir):
    """Keys for line items as runs of an order: the line number if unique, else the row's number."""
    li = table(spark, sf_dir, "lineitem").withColumn("ord", F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    out = G.run_key(li.select("l_orderkey", "l_linenumber", "l_partkey", "ord"), "l_orderkey", ["l_linenumber", "l_partkey"], "ord")
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_key").alias("keys"))


def drift_reset(spark, sf_dir):
    """The same accessions as in accession_drift, those that run on set back to the least."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4000).alias("grp"), F.concat(F.lit("MOD:"), (F.floor(F.col("o_orderkey") / 4000) + F.when(F.col("o_orderkey") % 4000 % 3 == 0, F.col("o_orderkey") % 2).otherwise(0)).cast("string")).alias("acc"))
    return G.without_drift(o, ["grp"], "acc").select("o_orderkey", "acc")


def label_ambiguous(spark, sf_dir):
    """Labels of several parts are ambiguous, unless the parts differ in case alone."""
    p = table(spark, sf_dir, "part")
    a = F.when(F.col("p_size") % 4 == 0, F.concat_ws("; ", "p_brand", "p_type")).when(F.col("p_size") % 4 == 1, F.concat_ws("; ", "p_brand", F.lower("p_brand"))).otherwise(F.col("p_brand"))
    d = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, a).alias("a"), F.col("p_type").alias("b"))
    return G.labelled(d, [("a", "sdrf"), ("b", "name")], "label", "AMBIGUOUS").select("p_partkey", "label", "label_source")


def mapped_runs(spark, sf_dir):
    """Runs of seven projects: three have a mapping of half their runs, the others none."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("project"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("run"), "p_partkey")
    mapping = p.filter("project < 3 and p_partkey % 2 = 0").groupBy("project", (F.col("p_partkey") % 11).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("run")), " ; ").alias("raw_files"))
    return G.mapped_runs(p, mapping, p.filter("p_partkey % 3 = 0"), "project")


QUERIES = {f.__name__: f for f in (drift_reset, label_ambiguous, mapped_runs, priority_fill_evidence, label_provenance, setup_best_match, fraction_groups, sample_counts, accession_drift, agree_disagree_status, provenance_first_wins, set_change_status, pair_value_overlap, key_normalised_exact_dups, union_keep_first, group_split, round_robin_shards, repair_manifest, uncached_requests, run_keys)}

LISTS = "list_filter(list_transform(string_split(lower({}), ';'), lambda x: trim(x)), lambda x: x <> '')"
RUNS = """runs AS (SELECT DISTINCT 'P' || (user_id % 10) project, 'user' || user_id || CASE event_id % 3 WHEN 0 THEN '_F' || (event_id % 17) WHEN 1 THEN '_fraction_' || (event_id % 17) ELSE '_x' END run FROM events),
  fr AS (SELECT project, run, regexp_extract(run, '(?i)^(.*?)_(F|fraction)_?(\\d{1,3})$', 1) sample_base, regexp_extract(run, '(?i)^(.*?)_(F|fraction)_?(\\d{1,3})$', 3) f FROM runs),
  grp AS (SELECT project, run, sample_base, f::INT fraction_id, count(*) OVER (PARTITION BY project, sample_base) group_size FROM fr WHERE sample_base <> '')"""
ORACLES = {
    "priority_fill_evidence": f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END l0, CASE WHEN o_orderkey % 3 = 0 THEN 'sdrf' END e0, CASE WHEN o_orderkey % 2 = 0 AND c_custkey IS NOT NULL THEN c_mktsegment || '; ' || o_orderpriority END n,
        CASE WHEN o_orderkey % 5 <> 0 THEN lower(o_orderpriority) END a FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
      u AS (SELECT *, coalesce(l0, n) l1, nullif(concat_ws('; ', e0, CASE WHEN n IS NULL THEN NULL WHEN l0 IS NULL OR list_has_any({LISTS.format('l0')}, {LISTS.format('n')}) THEN 'name' ELSE '-name' END), '') e1 FROM t)
      SELECT o_orderkey, coalesce(l1, a) AS label, nullif(concat_ws('; ', e1, CASE WHEN a IS NULL THEN NULL WHEN l1 IS NULL OR list_has_any({LISTS.format('l1')}, {LISTS.format('a')}) THEN 'agent' ELSE '-agent' END), '') label_evidence FROM u""",
    "label_provenance": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 5 = 0 THEN p_name END AS label,
      CASE WHEN p_partkey % 2 = 0 THEN 'sdrf' WHEN p_partkey % 3 = 0 THEN 'name' WHEN p_partkey % 5 = 0 THEN 'agent' END label_source FROM part""",
    "setup_best_match": """WITH p AS (SELECT p_partkey % 199 project, p_partkey, (p_size % 5)::VARCHAR f1, lower(p_type) f2, p_brand f3 FROM part),
      j AS (SELECT t.project, t.p_partkey, (t.f1 = s.f1)::INT + (t.f2 = s.f2)::INT + (lower(t.f3) = lower(s.f3))::INT score, s.f3 v FROM p t JOIN p s ON t.project = s.project AND t.p_partkey % 4 = 0 AND s.p_partkey % 4 <> 0),
      m AS (SELECT *, max(score) OVER (PARTITION BY project, p_partkey) top FROM j)
      SELECT project, p_partkey, score, count(*) setups, string_agg(DISTINCT v, '; ' ORDER BY v) AS value FROM m WHERE score = top GROUP BY 1, 2, 3""",
    "fraction_groups": f"WITH {RUNS} SELECT * FROM grp WHERE group_size >= 2",
    "sample_counts": f"WITH {RUNS} SELECT r.project, coalesce(g.sample_base, r.run) AS sample, count(*) runs FROM runs r LEFT JOIN (SELECT * FROM grp WHERE group_size >= 2) g ON g.project = r.project AND g.run = r.run GROUP BY 1, 2",
    "accession_drift": """WITH o AS (SELECT o_orderkey % 4000 grp, o_orderkey // 4000 + CASE WHEN o_orderkey % 4000 % 3 = 0 THEN o_orderkey % 2 ELSE 0 END num FROM orders)
      SELECT grp, count(DISTINCT num) n, min(num) low, max(num) high FROM o GROUP BY grp HAVING count(DISTINCT num) >= 3 AND max(num) - min(num) + 1 = count(DISTINCT num)""",
    "agree_disagree_status": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END a, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN left(lower(c_mktsegment), 4) ELSE 'HOUSEHOLD' END END b, round(c_acctbal / 10000, 2) + 0.0 s FROM customer)
      SELECT c_custkey, coalesce(a, b) resolved, CASE WHEN a IS NULL AND b IS NULL THEN 'UNKNOWN' WHEN a IS NULL THEN 'LLM_ONLY' WHEN b IS NULL THEN 'RUNASSESSOR_ONLY' WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) THEN 'AGREE' ELSE 'DISAGREE' END status,
        CASE WHEN a IS NOT NULL THEN coalesce(s, 0.5) WHEN b IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE confidence FROM c""",
    "provenance_first_wins": """WITH c AS (SELECT conv_id, turn % 2 field, role, text v, CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END r FROM conversations)
      SELECT conv_id, field, first(v ORDER BY r, v) AS value, first(role ORDER BY r) agent, (SELECT string_agg(x.role, '; ' ORDER BY x.r) FROM (SELECT DISTINCT d.role, d.r FROM c d WHERE d.conv_id = c.conv_id AND d.field = c.field) x) given_by FROM c GROUP BY conv_id, field""",
    "set_change_status": """WITH g AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (ts < '2024-01-16'), []) a, coalesce(list(DISTINCT event_type) FILTER (ts >= '2024-01-16'), []) b FROM events GROUP BY user_id),
      k AS (SELECT *, len(list_intersect(a, b)) i, len(a) na, len(b) nb FROM g)
      SELECT user_id, CASE WHEN na = 0 AND nb = 0 THEN 'both_empty' WHEN na = 0 THEN 'newly' WHEN nb = 0 THEN 'lost' WHEN i = na AND i = nb THEN 'same' WHEN i = na THEN 'additional' WHEN i = nb THEN 'fewer' ELSE 'changed' END status,
        round(i / nullif(na + nb - i, 0)::DOUBLE, 6) jaccard, CASE WHEN i = na AND i = nb THEN 'MATCH' WHEN i > 0 THEN 'PARTIAL' ELSE 'MISMATCH' END kind FROM k""",
    "pair_value_overlap": """WITH e AS (SELECT user_id, ts::DATE AS day, list(DISTINCT event_type) t FROM events GROUP BY 1, 2)
      SELECT x.user_id, count(*) AS days, count(*) FILTER (list_has_any(x.t, y.t)) overlapping FROM e x JOIN e y ON y.user_id = x.user_id + 1 AND y.day = x.day GROUP BY 1""",
    "key_normalised_exact_dups": "SELECT min(doc_id) doc_id, count(*) n FROM documents GROUP BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) HAVING count(*) > 1",
    "union_keep_first": """WITH u AS (SELECT c_nationkey nation, c_custkey AS key, 'customer' kind, 0 s FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT s_nationkey, s_suppkey, 'supplier', 1 FROM supplier)
      SELECT nation, first(key ORDER BY s, key) AS key, first(kind ORDER BY s, key) kind FROM u GROUP BY nation""",
    "group_split": """SELECT doc_id, source, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'val' ELSE 'test' END split FROM (SELECT doc_id, source, ('0x' || left(md5(coalesce(source, '') || '|1'), 8))::BIGINT / 4294967296.0::DOUBLE u FROM documents) t""",
    "drift_reset": """WITH o AS (SELECT o_orderkey, o_orderkey % 4000 grp, o_orderkey // 4000 + CASE WHEN o_orderkey % 4000 % 3 = 0 THEN o_orderkey % 2 ELSE 0 END num FROM orders), g AS (SELECT grp, min(num) low FROM o GROUP BY grp HAVING count(DISTINCT num) >= 3 AND max(num) - min(num) + 1 = count(DISTINCT num))
      SELECT o_orderkey, 'MOD:' || coalesce(low, num) acc FROM o LEFT JOIN g ON g.grp = o.grp""",
    "label_ambiguous": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size % 4 = 0 THEN 'AMBIGUOUS' WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 4 = 1 THEN p_brand || '; ' || lower(p_brand) ELSE p_brand END ELSE p_type END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'sdrf' ELSE 'name' END label_source FROM part""",
    "mapped_runs": """WITH d AS (SELECT p_partkey % 7 project, 'r' || p_partkey run, p_partkey FROM part), f AS (SELECT DISTINCT project, run FROM d WHERE project < 3 AND p_partkey % 2 = 0)
      SELECT d.project, d.run, 'mapping' via FROM d JOIN f ON f.project = d.project AND f.run = d.run UNION ALL SELECT project, run, 'direct' FROM d WHERE p_partkey % 3 = 0 AND project NOT IN (SELECT project FROM f)""",
    "round_robin_shards": "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::INT shard FROM documents",
    "repair_manifest": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)",
    "uncached_requests": "SELECT conv_id, turn, sha256(text) AS key FROM conversations WHERE role = 'user' AND text NOT IN (SELECT text FROM conversations WHERE role = 'user' AND conv_id % 2 = 0)",
    "run_keys": "SELECT l_orderkey, count(*) n, count(*) AS keys FROM lineitem GROUP BY 1",
}
