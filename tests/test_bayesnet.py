"""Network inference invariants (values checked by hand / NumPy in SURVEY §9)."""
import itertools

import pytest
from pyspark.sql import functions as F

from finlex.operators import bayesnet as BN
from finlex.operators import factors as X


def _posterior(spark, doc_type, sentiment, impact, node="market_direction"):
    ev = spark.createDataFrame([(1, doc_type, sentiment, impact)],
                               "doc_id BIGINT, document_type STRING, sentiment STRING, impact STRING")
    docs, post = BN.infer(ev, spark)
    p = docs.select("key").join(post, "key").filter(F.col("node") == node).orderBy("ord").collect()
    return [round(r.p, 6) for r in p]


def test_full_evidence_is_cpt_row(spark):
    assert _posterior(spark, "report", "positive", "high")[1] == round(0.81 / 1.01, 6)  # buy


def test_partial_evidence_sums_over_prior(spark):
    assert _posterior(spark, None, None, "high") == [0.124752, 0.2, 0.350495, 0.2, 0.124752]


def test_uniform_children_and_decision(spark):
    assert _posterior(spark, "news", "neutral", "medium", "risk_level") == [0.2] * 5
    ev = spark.createDataFrame([(1, "report", "positive", "high")],
                               "doc_id BIGINT, document_type STRING, sentiment STRING, impact STRING")
    d = BN.decision_table(ev, spark).first()
    assert d.market_direction == "buy" and d.recommendation == "Comprar ativos de risco"
    assert d.summary.startswith("A análise recomenda comprar ativos de risco com confiança alta (80.2%).")


def test_state_mapping(spark):
    p = spark.createDataFrame([(1, "sentiment_analyzer", "positivo", 0.9), (1, "impact_modeler", "x", None),
                               (1, "type_classifier", "other", 0.3)],
                              "doc_id BIGINT, model STRING, predicted_class STRING, confidence DOUBLE")
    got = {r.node: r.state for r in BN.mapped_outputs(p).collect()}
    assert got == {"sentiment": "very_positive", "impact": "medium", "document_type": "announcement"}


def test_posterior_rows_match_a_full_enumeration():
    cpt = {(n, s, d, se, i): p for n, s, _, d, se, i, p in BN.cpt_rows()}
    for key, *ps in BN.posterior_rows()[::17]:
        seen = [None if k == BN.UNOBSERVED else k for k in key.split("|")]
        got = dict(zip(BN.node_states(), ps))
        for child, (states, parents) in BN.CHILDREN.items():
            want = [0.0] * len(states)
            for combo in itertools.product(*BN.ROOTS.values()):
                at = dict(zip(BN.ROOTS, combo))
                w = 1.0
                for r, o in zip(BN.ROOTS, seen):
                    w *= BN.PRIORS[r][BN.ROOTS[r].index(at[r])] if o is None else float(o == at[r])
                args = [at[r] if r in parents else None for r in ("document_type", "sentiment", "impact")]
                for k, st in enumerate(states):
                    want[k] += w * cpt[(child, st, *args)]
            total = sum(want)
            want = [x / total for x in want] if total else [1 / len(want)] * len(want)
            if BN.FOREIGN not in seen:
                assert all(abs(a - b) < 1e-9 for a, b in zip(got[child], want))


def test_foreign_states_give_uniform_children_not_lost_documents(spark):
    assert _posterior(spark, "report", "odd", "high") == [0.2] * 5
    ev = spark.createDataFrame([(1, "report", "odd", None)], "doc_id BIGINT, document_type STRING, sentiment STRING, impact STRING")
    assert BN.decision_table(ev, spark).count() == 1


def _default_tables(spark):
    rows = [(n, st, {}, p) for n in BN.ROOTS for st, p in zip(BN.ROOTS[n], BN.PRIORS[n])]
    rows += [(n, st, {k: v for k, v in (("document_type", d), ("sentiment", s), ("impact", i)) if v is not None}, p)
             for n, st, _, d, s, i, p in BN.cpt_rows()]
    return BN.nodes_table(spark), BN.edges_table(spark), spark.createDataFrame(rows, "node STRING, state STRING, given MAP<STRING, STRING>, p DOUBLE")


def test_network_from_tables_gives_the_default_posteriors(spark, monkeypatch):
    net = X.Network(*_default_tables(spark))
    combos = list(itertools.product(*[[None, *st] for st in BN.ROOTS.values()]))
    ev = spark.createDataFrame([("|".join(BN.UNOBSERVED if x is None else x for x in o), dict(zip(BN.ROOTS, o))) for o in combos],
                               "key STRING, observed MAP<STRING, STRING>")
    monkeypatch.setattr(X, "BROADCAST_COMBINATIONS", 10)  # the shuffle join of many combinations
    got = {}
    for r in X.infer(net, ev).orderBy("ord").collect():
        got.setdefault((r.key, r.node), []).append(r.p)
    want = {(key, n): p for key, *ps in BN.posterior_rows() if BN.FOREIGN not in key for n, p in zip(BN.node_states(), ps)}
    assert set(got) == set(want)
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_evidence_on_children_and_impossible_evidence(spark):
    net = X.Network(*_default_tables(spark))
    ev = spark.createDataFrame([(1, {"market_direction": "buy"}), (2, {"impact": "no such state"}), (3, None), (3, {"no such node": "x"})],
                               "doc_id BIGINT, observed MAP<STRING, STRING>")
    got = {}
    for r in X.infer(net, ev).collect():
        got.setdefault((r.doc_id, r.node), {}).setdefault(r.state, []).append(r.p)
    joint = {}
    for (s, ps), (i, pi) in itertools.product(zip(BN.ROOTS["sentiment"], BN.PRIORS["sentiment"]), zip(BN.ROOTS["impact"], BN.PRIORS["impact"])):
        p = next(x[-1] for x in BN.cpt_rows() if x[0] == "market_direction" and x[1] == "buy" and x[4] == s and x[5] == i)
        joint[s] = joint.get(s, 0) + ps * pi * p
    total = sum(joint.values())
    assert all(abs(got[1, "sentiment"][s][0] - joint[s] / total) < 1e-12 for s in joint)
    assert got[1, "market_direction"]["buy"] == pytest.approx([1.0]) and all(abs(x[0] - 0.2) < 1e-12 for x in got[2, "sentiment"].values())
    assert got[3, "document_type"]["report"] == pytest.approx([0.25, 0.25])  # no evidence, in both forms


def test_bad_networks_are_refused(spark):
    nodes, _, cpt = _default_tables(spark)
    edge = lambda *rows: spark.createDataFrame(list(rows), "child STRING, parent STRING, pos INT")
    for edges, word in ((edge(("impact", "sentiment", 0), ("sentiment", "impact", 0)), "cycle"), (edge(("impact", "x", 0)), "no such node")):
        with pytest.raises(ValueError, match=word):
            X.Network(nodes, edges, cpt)
    with pytest.raises(ValueError, match="twice"):
        X.Network(nodes.unionByName(nodes.filter("ord = 0")), edge(("impact", "sentiment", 0)), cpt)


def test_a_configuration_without_rows_is_uniform(spark):
    nodes = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "u", 0), ("b", "v", 1), ("b", "w", 2)], "node STRING, state STRING, ord INT")
    edges = spark.createDataFrame([("b", "a", 0)], "child STRING, parent STRING, pos INT")
    cpt = spark.createDataFrame([("a", "x", {}, 3.0), ("a", "y", {}, 1.0), ("b", "u", {"a": "x"}, 1.0)],
                                "node STRING, state STRING, given MAP<STRING, STRING>, p DOUBLE")
    got = {r.state: r.p for r in X.infer(X.Network(nodes, edges, cpt), spark.createDataFrame([(1, {"a": "y"})], "k INT, observed MAP<STRING, STRING>")).collect()}
    assert all(abs(got[s] - 1 / 3) < 1e-12 for s in "uvw")
    got = {r.state: r.p for r in X.infer(X.Network(nodes, edges, cpt), spark.createDataFrame([(1, {})], "k INT, observed MAP<STRING, STRING>")).collect()}
    assert abs(got["x"] - 0.75) < 1e-12 and abs(got["u"] - (0.75 + 0.25 / 3)) < 1e-12


def test_a_long_chain_closes_in_few_rounds(spark, monkeypatch):
    from finlex.plans.q_bayes import ancestor_closure
    rounds, kind = [], type(spark.range(1))
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: rounds.append(1) or real(self, *a, **k))
    chain = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)], "src STRING, dst STRING")
    got = ancestor_closure(chain)
    assert got.count() == 300 * 301 // 2 and got.filter("depth <> int(substr(ancestor, 2)) - int(substr(node, 2))").count() == 0
    assert len(rounds) <= 11


def test_least_depth_and_cycles_of_the_closure(spark):
    from finlex.plans.q_bayes import ancestor_closure
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e")], "src STRING, dst STRING")
    got = {(r.node, r.ancestor): r.depth for r in ancestor_closure(edges).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 1, ("a", "e"): 2, ("b", "c"): 1, ("b", "d"): 2, ("b", "e"): 3,
                   ("c", "d"): 1, ("c", "e"): 2, ("d", "e"): 1}
    for n in (1, 2, 5, 16):
        ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [("x", "r0")], "src STRING, dst STRING")
        with pytest.raises(ValueError, match="cycle"):
            ancestor_closure(ring)
