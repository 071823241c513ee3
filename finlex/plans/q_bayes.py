"""Queries for the network aggregator (A1-A21) and their DuckDB oracles.

Input: the ``preds`` fixture (three classifier outputs per order).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bayesnet as BN
from ..sources import fixtures as FX
from ..sources import tables as S
from .registry import q, register

R = 6


def _r(df):
    return df.select(*[F.round(F.col(f.name), R).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def _preds(spark, sf):
    return FX.preds_base(spark, sf).select("doc_id", "model", "predicted_class", "confidence")


def _failed(spark, sf):
    """Injected classifier failures: the impact model errors on every 13th order."""
    return _preds(spark, sf).filter((F.col("model") == "impact_modeler") & (F.col("doc_id") % 13 == 0)) \
        .select("doc_id", "model", F.lit("PREDICTION_ERROR").alias("error_code"))


def _evidence(spark, sf, with_failures=False, adaptive=True):
    m = BN.mapped_outputs(_preds(spark, sf))
    return BN.evidence(m, _failed(spark, sf) if with_failures else None, adaptive)


def _states_sql(node_states):
    return ", ".join(f"({i}, {q(s)})" for i, s in enumerate(node_states))


_C = "CASE predicted_class WHEN 'positivo' THEN 'positive' WHEN 'negativo' THEN 'negative' ELSE predicted_class END"
_IN = lambda states: "(" + ", ".join(q(s) for s in states) + ")"
MAPPED_SQL = FX.ctes("preds_long") + f""",
preds AS (SELECT DISTINCT doc_id, model, predicted_class, confidence FROM preds_long),
mapped AS (SELECT doc_id, model,
  CASE model WHEN 'type_classifier' THEN 'document_type' WHEN 'sentiment_analyzer' THEN 'sentiment' ELSE 'impact' END
    AS node,
  CASE WHEN model = 'type_classifier' THEN
         CASE WHEN {_C} IN {_IN(BN.ROOTS['document_type'])} THEN {_C} ELSE 'announcement' END
       WHEN model = 'sentiment_analyzer' THEN
         CASE WHEN {_C} IN ('positive', 'negative') AND coalesce(confidence, 0.5) > 0.8 THEN 'very_' || {_C}
              WHEN {_C} IN {_IN(BN.ROOTS['sentiment'])} THEN {_C} ELSE 'neutral' END
       ELSE CASE WHEN {_C} IN ('high', 'low') AND coalesce(confidence, 0.5) > 0.8 THEN 'very_' || {_C}
              WHEN {_C} IN {_IN(BN.ROOTS['impact'])} THEN {_C} ELSE 'medium' END END AS state,
  coalesce(confidence, 0.5) AS confidence FROM preds),
failed AS (SELECT doc_id, model FROM preds WHERE model = 'impact_modeler' AND doc_id % 13 = 0),
ev AS (SELECT doc_id, max(CASE WHEN node = 'document_type' THEN state END) AS document_type,
  max(CASE WHEN node = 'sentiment' THEN state END) AS sentiment,
  max(CASE WHEN node = 'impact' THEN state END) AS impact FROM mapped GROUP BY doc_id),
evp AS (SELECT doc_id, max(CASE WHEN node = 'document_type' THEN state END) AS document_type,
  max(CASE WHEN node = 'sentiment' THEN state END) AS sentiment,
  max(CASE WHEN node = 'impact' THEN state END) AS impact
  FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM failed f WHERE f.doc_id = m.doc_id AND f.model = m.model)
  GROUP BY doc_id),
sst AS (SELECT * FROM (VALUES {_states_sql(BN.ROOTS['sentiment'])}) t(si, s)),
ist AS (SELECT * FROM (VALUES {_states_sql(BN.ROOTS['impact'])}) t(ii, i)),
ipri AS (SELECT * FROM (VALUES {", ".join(f"({q(s)}, {p}e0)" for s, p in zip(BN.ROOTS['impact'], BN.PRIORS['impact']))})
  t(i, prior)),
mds AS (SELECT * FROM (VALUES {_states_sql(BN.CHILDREN['market_direction'][0])}) t(k, state)),
md_cpt AS (SELECT s, i, state, k, CASE WHEN k = least(greatest(trunc(2 - ((2 - si) + 0.5e0 * (2 - ii)) + 0.5e0), 0), 4)
  THEN 0.81e0 ELSE 0.05e0 END / 1.01e0 AS p FROM sst, ist, mds)
"""


# ---------------------------------------------------------------- A1-A4

@register("A1_map_states", MAPPED_SQL + "SELECT doc_id, model, node, state FROM mapped")
def a1_map(spark, sf):
    return BN.mapped_outputs(_preds(spark, sf)).select("doc_id", "model", "node", "state")


@register("A2_remap_probabilities", MAPPED_SQL + f"""
, pl AS (SELECT doc_id, model, CASE class WHEN 'positivo' THEN 'positive' WHEN 'negativo' THEN 'negative'
  ELSE class END AS c, prob FROM preds_long),
parts AS (SELECT doc_id, model, 'very_' || c AS state, prob * 0.7 AS prob FROM pl
    WHERE c IN ('positive', 'negative', 'high', 'low') AND prob > 0.8
  UNION ALL SELECT doc_id, model, c, CASE WHEN c IN ('positive', 'negative', 'high', 'low') AND prob > 0.8
    THEN prob * 0.3 ELSE prob END FROM pl)
SELECT doc_id, CASE model WHEN 'type_classifier' THEN 'document_type' WHEN 'sentiment_analyzer' THEN 'sentiment'
  ELSE 'impact' END AS node, state, round(sum(prob), {R}) AS prob FROM parts GROUP BY ALL""")
def a2_remap(spark, sf):
    pl = FX.preds_long(spark, sf).select("doc_id", "model", "class", "prob")
    return _r(BN.remap_probabilities(pl))


@register("A3_evidence", MAPPED_SQL + "SELECT doc_id, document_type, sentiment, impact FROM ev")
def a3_evidence(spark, sf):
    return _evidence(spark, sf)


@register("A4_classifier_failures", MAPPED_SQL + """
SELECT 'adaptive' AS mode, CAST(count(*) AS BIGINT) AS docs, CAST(count(impact) AS BIGINT) AS with_impact FROM evp
UNION ALL SELECT 'strict', CAST(count(*) AS BIGINT), CAST(count(impact) AS BIGINT) FROM evp
  WHERE doc_id NOT IN (SELECT doc_id FROM failed)""")
def a4_failures(spark, sf):
    ad = _evidence(spark, sf, True, True)
    st = _evidence(spark, sf, True, False)
    return (ad.agg(F.lit("adaptive").alias("mode"), F.count(F.lit(1)).alias("docs"),
                   F.count("impact").alias("with_impact"))
            .unionByName(st.agg(F.lit("strict").alias("mode"), F.count(F.lit(1)).alias("docs"),
                                F.count("impact").alias("with_impact"))))


# ---------------------------------------------------------------- A5-A7 network tables over data

def _empirical_type_cpt(spark, sf):
    """P(document_type | sentiment) estimated from the evidence table, A6-normalised.

    The full (sentiment x type) grid is kept so empty configurations fall back
    to uniform."""
    ev = _evidence(spark, sf)
    counts = ev.groupBy("sentiment", "document_type").agg(F.count(F.lit(1)).cast("double").alias("p"))
    grid = ev.select("sentiment").distinct().select(
        "sentiment", F.explode(F.array(*[F.lit(s) for s in BN.ROOTS["document_type"]])).alias("document_type"))
    full = grid.join(counts, ["sentiment", "document_type"], "left").fillna(0.0, ["p"]) \
        .withColumn("node", F.lit("document_type_given_sentiment"))
    return BN.normalize_cpt(full, ["sentiment"])


EMP_SQL = """
, cnt AS (SELECT sentiment, document_type, count(*) AS c FROM ev GROUP BY ALL),
grid AS (SELECT s.sentiment, t.document_type FROM (SELECT DISTINCT sentiment FROM ev) s,
  (VALUES ('report'), ('announcement'), ('guidance'), ('analysis'), ('news'), ('interview')) t(document_type)),
emp AS (SELECT g.sentiment, g.document_type, CASE WHEN sum(coalesce(c, 0)) OVER (PARTITION BY g.sentiment) > 0
  THEN coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY g.sentiment) ELSE 1.0 / 6 END AS p
  FROM grid g LEFT JOIN cnt USING (sentiment, document_type))
"""


@register("A5_network_checks", MAPPED_SQL + EMP_SQL + """
SELECT 'cpt_valid' AS "check", 'document_type_given_sentiment' AS subject,
  bool_and(ok) AS ok FROM (SELECT abs(sum(p) - 1) <= 1e-6 AND min(p) >= 0 AND max(p) <= 1 AS ok FROM emp GROUP BY sentiment)
UNION ALL SELECT 'cpt_valid', 'market_direction', true
UNION ALL SELECT 'cpt_valid', 'investment_horizon', true
UNION ALL SELECT 'cpt_valid', 'risk_level', true
UNION ALL SELECT 'cpt_valid', 'confidence_level', true
UNION ALL SELECT 'has_states', n, true FROM (VALUES ('document_type'), ('sentiment'), ('impact'),
  ('market_direction'), ('investment_horizon'), ('risk_level'), ('confidence_level')) t(n)""")
def a5_checks(spark, sf):
    emp = _empirical_type_cpt(spark, sf).select("node", "sentiment", "p",
                                                F.lit(None).cast("string").alias("document_type"),
                                                F.lit(None).cast("string").alias("impact"))
    cpt = BN.cpt_table(spark).select("node", "document_type", "sentiment", "impact", "p").unionByName(emp)
    return BN.check_network(BN.nodes_table(spark), BN.edges_table(spark), cpt)


@register("A6_cpt_normalize", MAPPED_SQL + EMP_SQL + f"""
SELECT sentiment, document_type, round(p, {R}) AS p FROM emp""")
def a6_normalize(spark, sf):
    return _r(_empirical_type_cpt(spark, sf).select("sentiment", "document_type", "p"))


@register("A7_default_network", MAPPED_SQL + f"""
SELECT c.s AS sentiment, c.i AS impact, c.state, round(c.p, {R}) AS p,
  CAST(coalesce(n.docs, 0) AS BIGINT) AS docs
FROM md_cpt c LEFT JOIN (SELECT sentiment, impact, count(*) AS docs FROM ev GROUP BY ALL) n
  ON n.sentiment = c.s AND n.impact = c.i""")
def a7_network(spark, sf):
    cpt = BN.cpt_table(spark).filter(F.col("node") == "market_direction") \
        .select("sentiment", "impact", "state", "p")
    n = _evidence(spark, sf).groupBy("sentiment", "impact").agg(F.count(F.lit(1)).alias("docs"))
    return _r(F.broadcast(cpt).join(n, ["sentiment", "impact"], "left")
              .select("sentiment", "impact", "state", "p", F.coalesce("docs", F.lit(0)).alias("docs")))


# ---------------------------------------------------------------- A8-A9 graph operators over key edges

def _key_edges(spark, sf):
    """``edges(src=child, dst=parent)``: network edges plus order -> customer -> nation -> region."""
    o = S.table(spark, sf, "orders", "o_orderkey", "o_custkey")
    c = S.table(spark, sf, "customer", "c_custkey", "c_nationkey")
    n = S.table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    e1 = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"),
                  F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    e2 = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"),
                  F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    e3 = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"),
                  F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    bn = BN.edges_table(spark).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return e1.unionByName(e2).unionByName(e3).unionByName(bn)


EDGES_SQL = """
WITH edges AS (
  SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS src, 'c' || CAST(o_custkey AS VARCHAR) AS dst FROM orders
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT * FROM (VALUES ('market_direction', 'sentiment'), ('market_direction', 'impact'),
    ('investment_horizon', 'document_type'), ('investment_horizon', 'impact'), ('risk_level', 'sentiment'),
    ('risk_level', 'impact'), ('risk_level', 'document_type'), ('confidence_level', 'document_type'),
    ('confidence_level', 'sentiment')) t(src, dst))
"""


SALTS = 16


def ancestor_closure(edges):
    """(node, ancestor, depth), each pair at its least depth, by doubling paths.

    With all pairs up to depth n known, a pair at depth n < d <= 2n is one at depth exactly n
    continued by one of at most n, so rounds are the logarithm of the greatest depth and a
    round joins each frontier row once.  A node with many descendants is no hot key: the join
    key carries a salt of the descendant, and the far fewer ancestors of the middle node are
    repeated for every salt.  A node that turns up as its own ancestor is a cycle and raises.
    """
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    known = edges.select(F.col("src").alias("node"), F.col("dst").alias("ancestor")).distinct().withColumn("depth", F.lit(1)).checkpoint()
    frontier, n = known, 1
    while True:
        loop = known.filter((F.col("node") == F.col("ancestor")) & (F.col("depth") > n // 2)).first()
        if loop is not None:
            raise ValueError(f"the edge table has a cycle through {loop['node']}")
        if frontier.isEmpty():
            return known
        onward = known.select(F.col("node").alias("middle"), F.col("ancestor").alias("next"), F.col("depth").alias("further"),
                              F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        longer = (frontier.select("node", F.col("ancestor").alias("middle"), salt.alias("salt")).join(onward, ["middle", "salt"])
                  .groupBy("node", F.col("next").alias("ancestor")).agg((F.min("further") + n).alias("depth"))
                  .join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        known = known.unionByName(longer).checkpoint()
        n *= 2
        frontier = known.filter(F.col("depth") == n)


@register("A8_ancestors", EDGES_SQL + """

SELECT depth, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT ancestor) AS BIGINT) AS ancestors,
  false AS has_cycle
FROM (SELECT src AS node, dst AS ancestor, 1 AS depth FROM edges
  UNION ALL SELECT e1.src, e2.dst, 2 FROM edges e1 JOIN edges e2 ON e1.dst = e2.src
  UNION ALL SELECT e1.src, e3.dst, 3 FROM edges e1 JOIN edges e2 ON e1.dst = e2.src JOIN edges e3 ON e2.dst = e3.src)
GROUP BY depth""")
def a8_ancestors(spark, sf):
    clo = ancestor_closure(_key_edges(spark, sf))
    return clo.groupBy("depth").agg(F.count(F.lit(1)).alias("pairs"),
                                    F.countDistinct("ancestor").alias("ancestors")) \
        .withColumn("has_cycle", F.lit(False))


def markov_blanket(edges):
    """Parents ∪ children ∪ co-parents − self, for every node.

    Co-parents pair the parents of one child: bounded by the in-degree squared,
    which a network keeps small (a CPT grows exponentially in it).
    """
    par = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    chi = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))
    cop = edges.alias("a").join(edges.alias("b"), F.col("a.src") == F.col("b.src")) \
        .select(F.col("a.dst").alias("node"), F.col("b.dst").alias("other"))
    return par.unionByName(chi).unionByName(cop).filter(F.col("node") != F.col("other")).distinct()


@register("A9_markov_blanket", EDGES_SQL + """
, mb AS (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges
  UNION SELECT a.dst, b.dst FROM edges a JOIN edges b ON a.src = b.src)
SELECT node, CAST(count(*) AS BIGINT) AS blanket_size FROM mb WHERE node <> other GROUP BY node""")
def a9_blanket(spark, sf):
    return markov_blanket(_key_edges(spark, sf)).groupBy("node").agg(F.count(F.lit(1)).alias("blanket_size"))


# ---------------------------------------------------------------- A10-A15 inference

_UNIFORM = ", ".join(f"({q(n)}, {q(st)}, {1 / len(sts)!r}e0)" for n, (sts, _) in BN.CHILDREN.items()
                     if n != "market_direction" for st in sts)


@register("A10_posterior_full_evidence", MAPPED_SQL + f"""
SELECT e.doc_id, 'market_direction' AS node, c.state, round(c.p, {R}) AS p
  FROM ev e JOIN md_cpt c ON c.s = e.sentiment AND c.i = e.impact
UNION ALL SELECT e.doc_id, u.node, u.state, round(u.p, {R}) FROM ev e CROSS JOIN (VALUES {_UNIFORM}) u(node, state, p)""")
def a10_full(spark, sf):
    docs, post = BN.infer(_evidence(spark, sf), spark)
    children = post.filter(F.col("node").isin(*BN.CHILDREN))
    return _r(docs.select("doc_id", "key").join(F.broadcast(children), "key").select("doc_id", "node", "state", "p"))


@register("A11_heuristic_posterior", MAPPED_SQL + f"""
, hp AS (SELECT doc_id, CASE WHEN sentiment IN ('positive', 'very_positive') OR impact IN ('high', 'very_high')
  THEN 1.2e0 / 5.2e0 ELSE 0.2e0 END AS p_high FROM ev)
SELECT round(p_high, {R}) AS p_high, CAST(count(*) AS BIGINT) AS docs FROM hp GROUP BY 1""")
def a11_heuristic(spark, sf):
    hp = BN.heuristic_posterior(_evidence(spark, sf), spark)
    x = hp.filter((F.col("node") == "risk_level") & (F.col("state") == "high"))
    return _r(x.groupBy(F.round("p", R).alias("p_high")).agg(F.count(F.lit(1)).alias("docs")))


@register("A12_factor_product_marginal", MAPPED_SQL + f"""
, ps AS (SELECT sentiment AS s, count(*) / sum(count(*)) OVER () AS w FROM ev GROUP BY 1),
pi AS (SELECT impact AS i, count(*) / sum(count(*)) OVER () AS w FROM ev GROUP BY 1)
SELECT state, round(sum(ps.w * pi.w * c.p), {R}) AS p FROM md_cpt c JOIN ps USING (s) JOIN pi USING (i) GROUP BY state""")
def a12_factors(spark, sf):
    """Factor product (join on shared variables), marginalise (sum out), normalise."""
    ev = _evidence(spark, sf)
    w = Window.partitionBy()
    fs = ev.groupBy("sentiment").agg(F.count(F.lit(1)).alias("c")).select(
        "sentiment", (F.col("c") / F.sum("c").over(w)).alias("ws"))
    fi = ev.groupBy("impact").agg(F.count(F.lit(1)).alias("c")).select(
        "impact", (F.col("c") / F.sum("c").over(w)).alias("wi"))
    cpt = BN.cpt_table(spark).filter(F.col("node") == "market_direction")
    prod = cpt.join(F.broadcast(fs), "sentiment").join(F.broadcast(fi), "impact") \
        .withColumn("v", F.col("p") * F.col("ws") * F.col("wi"))
    marg = prod.groupBy("state").agg(F.sum("v").alias("v"))
    return _r(marg.select("state", (F.col("v") / F.sum("v").over(w)).alias("p")))


@register("A13_A15_posterior_partial", MAPPED_SQL + f"""
, post AS (SELECT e.doc_id, c.state, c.k, sum(c.p * CASE WHEN e.impact IS NULL THEN ip.prior
    WHEN e.impact = c.i THEN 1.0 ELSE 0.0 END) AS p
  FROM evp e JOIN md_cpt c ON c.s = e.sentiment JOIN ipri ip ON ip.i = c.i GROUP BY ALL),
imp AS (SELECT e.doc_id, ip.i AS state, CASE WHEN e.impact IS NULL THEN ip.prior WHEN e.impact = ip.i THEN 1.0e0
    ELSE 0.0e0 END AS p FROM evp e CROSS JOIN ipri ip)
SELECT doc_id, 'market_direction' AS node, state, round(p, {R}) AS p FROM post
UNION ALL SELECT doc_id, 'impact', state, round(p, {R}) FROM imp""")
def a13_partial(spark, sf):
    """Posterior of the direction, and of the impact where its classifier failed, on partial evidence."""
    docs, post = BN.infer(_evidence(spark, sf, with_failures=True), spark)
    p = post.filter(F.col("node").isin("market_direction", "impact"))
    return _r(docs.select("doc_id", "key").join(F.broadcast(p), "key").select("doc_id", "node", "state", "p"))


@register("A14_inference_reuse", MAPPED_SQL + """
SELECT CAST(count(*) AS BIGINT) AS docs,
  CAST(count(DISTINCT coalesce(document_type, '?') || '|' || coalesce(sentiment, '?') || '|' || coalesce(impact, '?'))
  AS BIGINT) AS combinations FROM evp""")
def a14_reuse(spark, sf):
    ev = _evidence(spark, sf, with_failures=True)
    return ev.agg(F.count(F.lit(1)).alias("docs"), F.countDistinct(BN.evidence_key(ev)).alias("combinations"))


# ---------------------------------------------------------------- A16-A21 decisions and explanations

DEC_SQL = MAPPED_SQL + """
, dec AS (SELECT e.doc_id, c.state AS market_direction, c.p AS market_direction_confidence,
  'immediate' AS investment_horizon, 'very_high' AS risk_level
  FROM ev e JOIN md_cpt c ON c.s = e.sentiment AND c.i = e.impact
  WHERE c.k = least(greatest(trunc(2 - ((2 - (SELECT si FROM sst WHERE s = e.sentiment))
     + 0.5e0 * (2 - (SELECT ii FROM ist WHERE i = e.impact))) + 0.5e0), 0), 4))
"""


@register("A16_decisions", DEC_SQL + f"""
SELECT doc_id, market_direction, round(market_direction_confidence, {R}) AS market_direction_confidence,
  investment_horizon, risk_level FROM dec""")
def a16_decisions(spark, sf):
    d = BN.decision_table(_evidence(spark, sf), spark)
    return _r(d.select("doc_id", "market_direction", "market_direction_confidence", "investment_horizon",
                       "risk_level"))


_REC = ("CASE market_direction WHEN 'buy' THEN 'Comprar ativos de risco' WHEN 'sell' THEN 'Proteger capital' "
        "ELSE 'Manter posições atuais' END")
_EXT = ("CASE market_direction " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in BN.EXTENDED_RECOMMENDATION.items())
        + " ELSE 'Manter posições atuais' END")


@register("A17_recommendation", DEC_SQL + f"""
SELECT doc_id, {_REC} AS recommendation, {_EXT} AS extended_recommendation FROM dec""")
def a17_recommendation(spark, sf):
    d = BN.decision_table(_evidence(spark, sf), spark)
    return d.select("doc_id", "recommendation",
                    BN.recommendation(F.col("market_direction"), extended=True).alias("extended_recommendation"))


@register("A18_certainty", MAPPED_SQL + f"""
, md AS (SELECT e.doc_id, c.p FROM ev e JOIN md_cpt c ON c.s = e.sentiment AND c.i = e.impact),
cert AS (SELECT doc_id, 1 - sum(-p * ln(p)) / ln(5) AS certainty FROM md GROUP BY doc_id)
SELECT 'market_direction' AS node, round(certainty, {R}) AS certainty, certainty > 0.6 AS is_factor,
  CAST(count(*) AS BIGINT) AS docs FROM cert GROUP BY ALL
UNION ALL SELECT n, 0.0, false, CAST((SELECT count(*) FROM ev) AS BIGINT)
  FROM (VALUES ('investment_horizon'), ('risk_level'), ('confidence_level')) t(n)
UNION ALL SELECT n, 1.0, true, CAST((SELECT count(*) FROM ev) AS BIGINT)
  FROM (VALUES ('document_type'), ('sentiment'), ('impact')) t(n)""")
def a18_certainty(spark, sf):
    docs, post = BN.infer(_evidence(spark, sf), spark)
    cert = BN.certainty(post)
    per_doc = docs.select("doc_id", "key").join(F.broadcast(cert), "key")
    return _r(per_doc.groupBy("node", F.round("certainty", R).alias("certainty"))
              .agg(F.count(F.lit(1)).alias("docs"))
              .select("node", "certainty", (F.col("certainty") > 0.6).alias("is_factor"), "docs"))


@register("A19_decision_path", MAPPED_SQL + """
, md AS (SELECT e.doc_id, c.state, c.p, c.k FROM ev e JOIN md_cpt c ON c.s = e.sentiment AND c.i = e.impact),
top3 AS (SELECT doc_id, string_agg(state || ':' || printf('%.4f', p), ',' ORDER BY p DESC, k) AS dist FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, k) AS rn FROM md) WHERE rn <= 3 GROUP BY doc_id)
SELECT e.doc_id, 'document_type=' || e.document_type || ';sentiment=' || e.sentiment || ';impact=' || e.impact
  || ';market_direction[' || t.dist || ']""" + "".join(
    f";{n}[" + ",".join(f"{st}:{1 / len(BN.CHILDREN[n][0]):.4f}" for st in BN.CHILDREN[n][0][:3]) + "]"
    for n in ("investment_horizon", "risk_level")) + """' AS path FROM ev e JOIN top3 t USING (doc_id)""")
def a19_path(spark, sf):
    """Evidence, then each decision's three most probable states (ties in state order)."""
    ev = _evidence(spark, sf)
    nodes = ("market_direction", "investment_horizon", "risk_level")

    def top(node):
        ranked = F.array_sort(F.array(*[F.struct((-F.col(node)[k]).alias("p"), F.lit(k).alias("k"), F.lit(st).alias("state"))
                                        for k, st in enumerate(BN.node_states()[node])]))
        return F.concat(F.lit(f";{node}["), F.array_join(F.transform(
            F.slice(ranked, 1, 3), lambda x: F.concat(x["state"], F.lit(":"), F.format_string("%.4f", -x["p"]))), ","), F.lit("]"))

    paths = BN.posterior_table(spark).select("key", F.concat(*[top(n) for n in nodes]).alias("tail"))
    j = ev.withColumn("key", BN.evidence_key(ev)).join(F.broadcast(paths), "key")
    return j.select("doc_id", F.concat(F.lit("document_type="), "document_type", F.lit(";sentiment="), "sentiment",
                                       F.lit(";impact="), "impact", "tail").alias("path"))


_ACT = "CASE market_direction " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in BN.ACTION.items()) + \
    f" ELSE {q(BN.ACTION_DEFAULT)} END"


@register("A20_decision_summary", DEC_SQL + f"""
SELECT doc_id, market_direction, {_REC} AS recommendation,
  'A análise recomenda ' || {_ACT} || ' com confiança ' ||
  CASE WHEN market_direction_confidence > 0.8 THEN 'alta' WHEN market_direction_confidence > 0.6 THEN 'moderada'
       ELSE 'baixa' END || ' (' || printf('%.1f', round(market_direction_confidence * 100, 1)) || '%). ' ||
  'O horizonte de investimento sugerido é de imediato com nível de risco muito alto.' AS summary
FROM dec""")
def a20_summary(spark, sf):
    """Flagship: classifier outputs -> evidence -> network posterior -> decision and explanation."""
    d = BN.decision_table(_evidence(spark, sf), spark)
    return d.select("doc_id", "market_direction", "recommendation", "summary")


@register("A21_strong_classifiers", MAPPED_SQL + """
SELECT doc_id, model, model || ' indicou ' || predicted_class || ' com alta confiança ('
  || printf('%.1f', round(confidence * 100, 1)) || '%)' AS description FROM preds WHERE confidence > 0.7""")
def a21_strong(spark, sf):
    p = _preds(spark, sf).filter(F.col("confidence") > 0.7)
    return p.select("doc_id", "model", F.concat(
        F.col("model"), F.lit(" indicou "), F.col("predicted_class"), F.lit(" com alta confiança ("),
        F.regexp_replace(F.format_number(F.round(F.col("confidence") * 100, 1), 1), ",", ""), F.lit("%)"))
        .alias("description"))
