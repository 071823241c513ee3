"""Discrete Bayesian network aggregation (A1-A21) as joins over small tables.

The network (7 nodes) and its CPTs are bounded tables (at most 750 rows).  The
data-sized side is the per-document evidence; inference runs once per distinct
evidence combination (at most 7 x 6 x 6 = 252 including "unobserved", A14) and
the posterior table, bounded by that count, is broadcast back to documents.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# FIXED VALUES: nodes and ordered states of the default network.
ROOTS = {
    "document_type": ["report", "announcement", "guidance", "analysis", "news", "interview"],
    "sentiment": ["very_positive", "positive", "neutral", "negative", "very_negative"],
    "impact": ["very_high", "high", "medium", "low", "very_low"],
}
CHILDREN = {
    "market_direction": (["strong_buy", "buy", "hold", "sell", "strong_sell"], ["sentiment", "impact"]),
    "investment_horizon": (["immediate", "short_term", "medium_term", "long_term", "strategic"],
                           ["document_type", "impact"]),
    "risk_level": (["very_high", "high", "medium", "low", "very_low"], ["sentiment", "impact", "document_type"]),
    "confidence_level": (["very_high", "high", "medium", "low", "very_low"], ["document_type", "sentiment"]),
}
# FIXED VALUES: root priors, in state order.
PRIORS = {
    "document_type": [0.25, 0.25, 0.15, 0.15, 0.10, 0.10],
    "sentiment": [0.10, 0.20, 0.40, 0.20, 0.10],
    "impact": [0.10, 0.20, 0.40, 0.20, 0.10],
}
# FIXED VALUES: market-direction CPT shape (0.81 on the indicated state, 0.05 elsewhere, / 1.01).
MD_PEAK, MD_BASE = 0.81, 0.05

# FIXED VALUES: classifier -> node, and accepted class names.
MODEL_NODE = {"type_classifier": "document_type", "sentiment_analyzer": "sentiment", "impact_modeler": "impact"}
NODE_DEFAULT = {"document_type": "announcement", "sentiment": "neutral", "impact": "medium"}
STRONG = {"positive": "very_positive", "negative": "very_negative", "high": "very_high", "low": "very_low"}
ALIASES = {"positivo": "positive", "negativo": "negative"}

# FIXED VALUES: wording of recommendations and summaries.
RECOMMENDATION = {"buy": "Comprar ativos de risco", "sell": "Proteger capital"}
RECOMMENDATION_DEFAULT = "Manter posições atuais"
ACTION = {"strong_buy": "comprar ativos de risco agressivamente", "buy": "comprar ativos de risco",
          "hold": "manter posições atuais", "sell": "reduzir exposição a risco",
          "strong_sell": "vender ativos de risco urgentemente"}
ACTION_DEFAULT = "avaliar cada posição individualmente"
HORIZON = {"immediate": "imediato", "short_term": "curto prazo", "medium_term": "médio prazo",
           "long_term": "longo prazo", "strategic": "horizonte estratégico"}
HORIZON_DEFAULT = "médio prazo"
RISK = {"very_high": "muito alto", "high": "alto", "medium": "médio", "low": "baixo", "very_low": "muito baixo"}
RISK_DEFAULT = "médio"
EXTENDED_RECOMMENDATION = {k: v[0].upper() + v[1:] for k, v in ACTION.items()}

ALL_NODES = list(ROOTS) + list(CHILDREN)
UNOBSERVED = "?"
FOREIGN = "!"  # an observed state that the node does not have


def _map_lit(d: dict) -> Column:
    return F.create_map(*[x for kv in d.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])


# ---------------------------------------------------------------- network tables

def nodes_table(spark: SparkSession) -> DataFrame:
    """``bn_nodes(node, state, ord)``."""
    rows = [(n, s, i) for n, st in ROOTS.items() for i, s in enumerate(st)]
    rows += [(n, s, i) for n, (st, _) in CHILDREN.items() for i, s in enumerate(st)]
    return spark.createDataFrame(rows, "node STRING, state STRING, ord INT")


def edges_table(spark: SparkSession) -> DataFrame:
    """``bn_edges(child, parent, pos)``."""
    rows = [(c, p, i) for c, (_, ps) in CHILDREN.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "child STRING, parent STRING, pos INT")


def priors_table(spark: SparkSession) -> DataFrame:
    rows = [(n, s, i, float(PRIORS[n][i])) for n, st in ROOTS.items() for i, s in enumerate(st)]
    return spark.createDataFrame(rows, "node STRING, state STRING, ord INT, p DOUBLE")


def market_direction_state(s: int, i: int) -> int:
    combined = (2 - s) + 0.5 * (2 - i)
    return min(max(math.trunc(2 - combined + 0.5), 0), 4)


def cpt_rows() -> list[tuple]:
    """Every child CPT as (node, state, ord, document_type, sentiment, impact, p); a
    parent is None when that root is not a parent of the node."""
    rows = []
    md_states, _ = CHILDREN["market_direction"]
    for si, s in enumerate(ROOTS["sentiment"]):
        for ii, i in enumerate(ROOTS["impact"]):
            peak = market_direction_state(si, ii)
            for k, st in enumerate(md_states):
                p = (MD_PEAK if k == peak else MD_BASE) / (MD_PEAK + 4 * MD_BASE)
                rows.append(("market_direction", st, k, None, s, i, p))
    for node in ("investment_horizon", "risk_level", "confidence_level"):
        states, parents = CHILDREN[node]
        grids = [[None] if r not in parents else ROOTS[r] for r in ("document_type", "sentiment", "impact")]
        for d, s, i in itertools.product(*grids):
            for k, st in enumerate(states):
                rows.append((node, st, k, d, s, i, 1.0 / len(states)))
    return rows


def cpt_table(spark: SparkSession) -> DataFrame:
    """A7 as a table."""
    return spark.createDataFrame(
        cpt_rows(), "node STRING, state STRING, ord INT, document_type STRING, sentiment STRING, impact STRING, p DOUBLE")


def normalize_cpt(cpt: DataFrame, parents: list[str], value: str = "p") -> DataFrame:
    """Divide by the sum per parent configuration; zero sum -> uniform."""
    w = Window.partitionBy("node", *parents)
    tot, k = F.sum(value).over(w), F.count(F.lit(1)).over(w)
    return cpt.withColumn(value, F.when(tot > 0, F.col(value) / tot).otherwise(1.0 / k))


def check_network(nodes: DataFrame, edges: DataFrame, cpt: DataFrame, tol: float = 1e-6) -> DataFrame:
    """A5: constraint report ``(check, subject, ok)``."""
    dup_states = nodes.groupBy("node", "state").count().filter("count > 1").select(
        F.lit("unique_states").alias("check"), F.col("node").alias("subject"), F.lit(False).alias("ok"))
    n_states = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("k")).select(
        F.lit("has_states").alias("check"), F.col("node").alias("subject"), (F.col("k") >= 1).alias("ok"))
    missing_parent = edges.join(nodes.select(F.col("node").alias("parent")).distinct(), "parent", "left_anti") \
        .select(F.lit("parent_exists").alias("check"), F.col("parent").alias("subject"), F.lit(False).alias("ok"))
    self_parent = edges.filter(F.col("child") == F.col("parent")).select(
        F.lit("no_self_parent").alias("check"), F.col("child").alias("subject"), F.lit(False).alias("ok"))
    sums = cpt.groupBy("node", "document_type", "sentiment", "impact").agg(
        F.sum("p").alias("s"), F.min("p").alias("lo"), F.max("p").alias("hi"),
        F.count_if(F.isnan("p")).alias("nans"))
    cpt_ok = sums.groupBy("node").agg(
        F.bool_and((F.abs(F.col("s") - 1.0) <= tol) & (F.col("lo") >= 0) & (F.col("hi") <= 1)
                   & (F.col("nans") == 0)).alias("ok")) \
        .select(F.lit("cpt_valid").alias("check"), F.col("node").alias("subject"), "ok")
    return dup_states.unionByName(n_states).unionByName(missing_parent).unionByName(self_parent) \
        .unionByName(cpt_ok)


# ---------------------------------------------------------------- A1-A4 evidence

def map_state(model: Column, predicted: Column, confidence: Column) -> Column:
    """A1: classifier class -> network state (strong classes above 0.8 confidence)."""
    c = F.coalesce(_map_lit(ALIASES)[predicted], predicted)
    conf = F.coalesce(confidence, F.lit(0.5))
    node = _map_lit(MODEL_NODE)[model]
    type_ok = c.isin(*ROOTS["document_type"])
    sent_ok = c.isin(*ROOTS["sentiment"])
    imp_ok = c.isin(*ROOTS["impact"])
    strong = _map_lit(STRONG)[c]
    return (F.when(node == "document_type", F.when(type_ok, c).otherwise(NODE_DEFAULT["document_type"]))
            .when(node == "sentiment", F.when(c.isin("positive", "negative") & (conf > 0.8), strong)
                  .when(sent_ok, c).otherwise(NODE_DEFAULT["sentiment"]))
            .when(node == "impact", F.when(c.isin("high", "low") & (conf > 0.8), strong)
                  .when(imp_ok, c).otherwise(NODE_DEFAULT["impact"])))


def mapped_outputs(preds: DataFrame) -> DataFrame:
    """A1 over a prediction table ``(doc_id, model, predicted_class, confidence)``."""
    return preds.select("doc_id", "model", _map_lit(MODEL_NODE)[F.col("model")].alias("node"),
                        map_state(F.col("model"), F.col("predicted_class"), F.col("confidence")).alias("state"),
                        F.coalesce(F.col("confidence"), F.lit(0.5)).alias("confidence"))


def remap_probabilities(probs_long: DataFrame) -> DataFrame:
    """A2: ``(doc_id, model, class, prob)`` -> ``(doc_id, node, state, prob)``.

    positive/negative/high/low above 0.8 split 70 % to the strong state, 30 % kept.
    """
    c = F.coalesce(_map_lit(ALIASES)[F.col("class")], F.col("class"))
    strong = _map_lit(STRONG)[c]
    split = c.isin("positive", "negative", "high", "low") & (F.col("prob") > 0.8)
    parts = F.when(split, F.array(F.struct(strong.alias("state"), (F.col("prob") * 0.7).alias("prob")),
                                  F.struct(c.alias("state"), (F.col("prob") * 0.3).alias("prob")))) \
        .otherwise(F.array(F.struct(c.alias("state"), F.col("prob").alias("prob"))))
    x = probs_long.select("doc_id", _map_lit(MODEL_NODE)[F.col("model")].alias("node"), F.inline(parts))
    return x.groupBy("doc_id", "node", "state").agg(F.sum("prob").alias("prob"))


def evidence(mapped: DataFrame, failed: DataFrame | None = None, adaptive: bool = True) -> DataFrame:
    """A3 (+A4): one row per document, one column per observed root (null = unobserved).

    ``failed``: (doc_id, model) outputs that errored.  Adaptive mode drops just
    those outputs; strict mode rejects the whole document.
    """
    m = mapped
    if failed is not None:
        m = m.join(failed.select("doc_id", "model"), ["doc_id", "model"], "left_anti")
        if not adaptive:
            m = m.join(failed.select("doc_id").distinct(), "doc_id", "left_anti")
    return m.groupBy("doc_id").pivot("node", list(ROOTS)).agg(F.first("state"))


# ---------------------------------------------------------------- A10-A15 inference

def evidence_key(ev: DataFrame) -> Column:
    return F.concat_ws("|", *[F.when(F.col(r).isNull(), UNOBSERVED).when(F.col(r).isin(*states), F.col(r)).otherwise(FOREIGN)
                              for r, states in ROOTS.items()])


def node_states() -> dict[str, list[str]]:
    return {**ROOTS, **{n: states for n, (states, _) in CHILDREN.items()}}


def posterior_rows(cpt: list[tuple] | None = None) -> list[tuple]:
    """A10, A12, A13, A15 for every evidence combination there can be: (key, probabilities per node).

    The posterior depends on the network alone.  An observed root is an indicator, an
    unobserved one its prior; a child sums its CPT over its parents' product; a node whose
    sum is zero (a foreign state was observed), or that has no CPT, is uniform.
    """
    cpt = cpt_rows() if cpt is None else cpt
    place = {r: i for i, r in enumerate(("document_type", "sentiment", "impact"))}
    out = []
    for observed in itertools.product(*[[None, FOREIGN, *states] for states in ROOTS.values()]):
        root = {r: {st: (PRIORS[r][i] if o is None else float(o == st)) for i, st in enumerate(ROOTS[r])}
                for r, o in zip(ROOTS, observed)}
        post = {r: [root[r][st] for st in ROOTS[r]] for r in ROOTS}
        for child, (states, _) in CHILDREN.items():
            post[child] = [0.0] * len(states)
        for node, _, k, *parents, p in cpt:
            w = p
            for r, i in place.items():
                if parents[i] is not None:
                    w *= root[r][parents[i]]
            post[node][k] += w
        for node, ps in post.items():
            total = sum(ps)
            post[node] = [x / total for x in ps] if total > 0 else [1.0 / len(ps)] * len(ps)
        key = "|".join(UNOBSERVED if o is None else o for o in observed)
        out.append((key, *post.values()))
    return out


def posterior_table(spark: SparkSession) -> DataFrame:
    """One row per evidence combination, one array of probabilities (in state order) per node."""
    return spark.createDataFrame(posterior_rows(), "key STRING, " + ", ".join(f"{n} ARRAY<DOUBLE>" for n in node_states()))


def _all_node_states() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("node"), F.lit(st).alias("state"), F.lit(i).alias("ord"))
                     for n, sts in node_states().items() for i, st in enumerate(sts)])


def infer(ev: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``(docs_with_key, posterior(key, node, state, ord, p))``.

    The posterior table has a row for each of the network's combinations, so it is bounded
    by the network, needs no look at the data, and is safe to broadcast.
    """
    docs = ev.withColumn("key", evidence_key(ev))
    rows = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(st).alias("state"), F.lit(i).alias("ord"), F.col(n)[i].alias("p"))
                     for n, sts in node_states().items() for i, st in enumerate(sts)])
    return docs, posterior_table(spark).select("key", F.inline(rows))


def heuristic_posterior(ev: DataFrame, spark: SparkSession) -> DataFrame:
    """A11 (method='heuristic'): uniform over a child's states; if a known parent
    is positive/high (or stronger) and the child has a 'high' state, x1.2 on it,
    then renormalise."""
    edges = edges_table(spark)
    docs = ev.withColumn("key", evidence_key(ev))
    combos = docs.select("key", *ROOTS).distinct()
    par = combos.select("key", F.explode(F.array(*[F.struct(F.lit(r).alias("parent"), F.col(r).alias("pstate"))
                                                   for r in ROOTS])).alias("e")).select("key", "e.*")
    boost = par.join(F.broadcast(edges), "parent").filter(
        F.col("pstate").isin("positive", "very_positive", "high", "very_high")) \
        .select("key", F.col("child").alias("node")).distinct().withColumn("boost", F.lit(True))
    x = combos.select("key", F.inline(_all_node_states())).filter(F.col("node").isin(*CHILDREN)) \
        .join(boost, ["key", "node"], "left")
    raw = F.when(F.col("boost") & (F.col("state") == "high"), 1.2).otherwise(1.0)
    w = Window.partitionBy("key", "node")
    x = x.withColumn("raw", raw).withColumn("p", F.col("raw") / F.sum("raw").over(w))
    return docs.select("doc_id", "key").join(F.broadcast(x.select("key", "node", "state", "ord", "p")), "key")


# ---------------------------------------------------------------- A16-A21 decisions and explanations

def decisions(post: DataFrame) -> DataFrame:
    """Most probable state per (key, node), ties by state order."""
    rn = F.row_number().over(Window.partitionBy("key", "node").orderBy(F.col("p").desc(), "ord"))
    return post.withColumn("rn", rn).filter("rn = 1").select("key", "node", F.col("state").alias("decision"),
                                                             F.col("p").alias("decision_p"))


def certainty(post: DataFrame) -> DataFrame:
    """1 - entropy / ln(k) per (key, node)."""
    e = F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0))
    g = post.groupBy("key", "node").agg(e.alias("h"), F.count(F.lit(1)).alias("k"))
    return g.select("key", "node", F.when(F.col("k") > 1, 1.0 - F.col("h") / F.log(F.col("k").cast("double")))
                    .otherwise(1.0).alias("certainty"))


def recommendation(direction: Column, extended: bool = False) -> Column:
    """Buy / sell / otherwise hold (``extended`` uses the five-way map)."""
    if extended:
        return F.coalesce(_map_lit(EXTENDED_RECOMMENDATION)[direction], F.lit(RECOMMENDATION_DEFAULT))
    return F.coalesce(_map_lit(RECOMMENDATION)[direction], F.lit(RECOMMENDATION_DEFAULT))


def band(conf: Column) -> Column:
    return F.when(conf > 0.8, "alta").when(conf > 0.6, "moderada").otherwise("baixa")


def summary(direction: Column, confidence: Column, horizon: Column, risk: Column) -> Column:
    """The summary sentence, defaults for unknown states."""
    action = F.coalesce(_map_lit(ACTION)[direction], F.lit(ACTION_DEFAULT))
    hz = F.coalesce(_map_lit(HORIZON)[horizon], F.lit(HORIZON_DEFAULT))
    rk = F.coalesce(_map_lit(RISK)[risk], F.lit(RISK_DEFAULT))
    conf = F.coalesce(confidence, F.lit(0.0))
    return F.concat(F.lit("A análise recomenda "), action, F.lit(" com confiança "), band(conf), F.lit(" ("),
                    F.regexp_replace(F.format_number(F.round(conf * 100, 1), 1), ",", ""), F.lit("%). "),
                    F.lit("O horizonte de investimento sugerido é de "), hz, F.lit(" com nível de risco "), rk,
                    F.lit("."))


def best_state(node: str) -> Column:
    """A16 on a posterior row: the node's most probable state, the first in order on ties."""
    states = F.array(*[F.lit(x) for x in node_states()[node]])
    return F.element_at(states, F.array_position(F.col(node), F.array_max(node)).cast("int"))


def decision_table(ev: DataFrame, spark: SparkSession, extended: bool = False) -> DataFrame:
    """A16-A18 + A20 per document: direction, horizon, risk, recommendation, summary."""
    per_key = posterior_table(spark).select(
        "key", best_state("market_direction").alias("market_direction"),
        F.array_max("market_direction").alias("market_direction_confidence"),
        best_state("investment_horizon").alias("investment_horizon"), best_state("risk_level").alias("risk_level"))
    per_key = per_key.withColumn("recommendation", recommendation(F.col("market_direction"), extended)) \
        .withColumn("summary", summary(F.col("market_direction"), F.col("market_direction_confidence"),
                                       F.col("investment_horizon"), F.col("risk_level")))
    return ev.select("doc_id", evidence_key(ev).alias("key")).join(F.broadcast(per_key), "key")
