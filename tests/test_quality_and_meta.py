"""Failing paths: gate, contract, vote without probabilities, cycles, checkpoint folder."""
import pytest
from pyspark.sql import functions as F

from finlex import session
from finlex.operators import meta as MT
from finlex.operators import quality as QY
from finlex.plans.q_bayes import ancestor_closure


def test_gate_raises_whatever_is_selected(spark):
    bad = spark.createDataFrame([(1, 5.0), (2, -5.0)], "k INT, price DOUBLE")
    gated = QY.gate(bad, F.col("price") < 0, "negative order price")
    for df in (gated, gated.select("k"), gated.groupBy().count()):
        with pytest.raises(Exception, match="negative order price"):
            df.collect()
    good = QY.gate(bad.filter("k = 1"), F.col("price") < 0, "negative order price")
    assert good.count() == 1


def test_gate_lets_null_conditions_pass(spark):
    df = spark.createDataFrame([(1, None)], "k INT, price DOUBLE")
    assert QY.gate(df, F.col("price") < 0, "negative").count() == 1


def test_contract_names_columns_as_they_are(spark):
    df = spark.createDataFrame([(None, 1), ("x", 2)], "a__b STRING, `c.d` INT")
    got = {(r[0], r[1]): r[2] for r in QY.contract_report(df, {
        "a__b": {"required": True, "allowed": ["y"]}, "c.d": {"type": "int", "allowed": [1]}, "gone": {}}).collect()}
    assert got == {("a__b", "required"): 1, ("a__b", "allowed"): 1, ("c.d", "type"): 0, ("c.d", "allowed"): 1, ("gone", "present"): 1}
    assert QY.contract_report(df, {}).count() == 0


def test_vote_keeps_documents_without_probabilities(spark):
    probs = spark.createDataFrame([(1, "m", "a", 0.7), (1, "m", "b", 0.3), (2, "m", "a", None), (3, "m", None, None), (4, "n", "b", 0.5),
                                   (4, "n", "a", 0.5)], "doc_id BIGINT, model STRING, class STRING, prob DOUBLE")
    weights = spark.createDataFrame([("m", 0.5)], "model STRING, weight DOUBLE")
    got = {r[0]: (r[1], r[2]) for r in MT.weighted_vote(probs, weights).collect()}
    assert got == {1: ("a", 0.7), 2: ("unknown", 0.0), 3: ("unknown", 0.0), 4: ("a", 0.5)}


def test_long_chains_are_no_cycles_and_cycles_end(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(19)], "src STRING, dst STRING")
    got = ancestor_closure(chain)
    assert got.agg(F.max("depth")).first()[0] == 19 and got.count() == 19 * 20 // 2
    with pytest.raises(ValueError, match="cycle"):
        ancestor_closure(chain.unionByName(spark.createDataFrame([("n3", "n1")], "src STRING, dst STRING")))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_nested_contract_counts_within_present_parents(spark):
    from finlex.operators import quality as QY
    df = spark.createDataFrame([((1, [("a", 1), ("b", None)]), {"k": "1"}), ((None, None), {"k": "x"}), (None, None), ((2, []), {})],
                               "s STRUCT<n: INT, l: ARRAY<STRUCT<t: STRING, v: INT>>>, m MAP<STRING, STRING>")
    contract = {"s": {"required": True, "properties": {"n": {"type": "int", "required": True, "allowed": [1]}, "l": {
        "items": {"properties": {"v": {"required": True}, "t": {"allowed": ["a"]}}}}, "gone": {}}},
        "m": {"properties": {"k": {"type": "int", "required": True}}}, "none": {"required": True}}
    got = {(r.path, r.check): r.violations for r in QY.nested_contract_report(df, contract).collect()}
    assert got == {("s", "required"): 1, ("s.n", "type"): 0, ("s.n", "required"): 1, ("s.n", "allowed"): 1, ("s.l[].v", "required"): 1,
                   ("s.l[].t", "allowed"): 1, ("s.gone", "present"): 1, ("m.k", "type"): 1, ("m.k", "required"): 1, ("none", "present"): 1}
    assert QY.nested_contract_report(df.limit(0), contract).filter("check <> 'present' and violations > 0").count() == 0
    assert QY.nested_contract_report(df, {}).count() == 0


def test_the_stacker_reads_its_rows_from_one_table(spark):
    from finlex.plans import QUERIES
    from tests.conftest import SF_SMALL
    out = QUERIES["M9_M10_stacked_prediction"](spark, SF_SMALL)
    assert "Exchange" not in out._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert {r.method for r in out.select("method").distinct().collect()} == {"stacking"}
