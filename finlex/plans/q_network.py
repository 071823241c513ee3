"""Queries over networks given as tables (A5, A12-A15) and their DuckDB oracles.

The order network has 12 nodes in four levels; its tables follow from a rule, and the
evidence of every order (season, price, priority, status, each sometimes unobserved)
comes from the given tables.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import factors as X
from ..sources import tables as S
from .registry import q, register

R = 6

NODES = {
    "season": ["Q1", "Q2", "Q3", "Q4"], "price": ["low", "mid", "high"], "load": ["light", "heavy"],
    "demand": ["weak", "steady", "strong"], "stock": ["short", "full"], "handling": ["manual", "auto"],
    "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "delay": ["no", "yes"], "status": ["F", "O", "P"],
    "complaint": ["no", "yes"], "margin": ["thin", "fair", "wide"], "weather": ["dry", "wet"],
}
PARENTS = {"demand": ["season"], "stock": ["load"], "handling": ["price", "load"], "priority": ["demand", "price"],
           "delay": ["stock", "handling"], "status": ["stock", "demand"], "complaint": ["delay", "priority"], "margin": ["price", "status"]}
NO_TABLE = "weather"  # a node without probabilities is uniform


def weight(node: str, k: int, given: list[int]) -> float:
    """Unnormalised probability of a state; two zeros make some evidence impossible."""
    if node == "status" and k == 2 and given[1] == 0 or node == "priority" and k == 4 and given[0] > 0:
        return 0.0
    return 1.0 + (3 * k + sum((j + 2) * g for j, g in enumerate(given)) + len(node)) % 5


def cpt_rows() -> list[tuple]:
    """(node, state, {parent: state}, p)."""
    out = []
    for n, states in NODES.items():
        if n == NO_TABLE:
            continue
        parents = PARENTS.get(n, [])
        for given in itertools.product(*[range(len(NODES[p])) for p in parents]):
            ws = [weight(n, k, list(given)) for k in range(len(states))]
            out += [(n, s, {p: NODES[p][g] for p, g in zip(parents, given)}, w / sum(ws)) for s, w in zip(states, ws)]
    return out


def order_network(spark) -> X.Network:
    nodes = spark.createDataFrame([(n, s, i) for n, ss in NODES.items() for i, s in enumerate(ss)], "node STRING, state STRING, ord INT")
    edges = spark.createDataFrame([(c, p, i) for c, ps in PARENTS.items() for i, p in enumerate(ps)], "child STRING, parent STRING, pos INT")
    cpt = spark.createDataFrame(cpt_rows(), "node STRING, state STRING, given MAP<STRING, STRING>, p DOUBLE")
    return X.Network(nodes, edges, cpt)


def order_evidence(spark, sf):
    """(doc_id, season, price, priority, status), null where unobserved; every 97th order has a foreign season."""
    k = F.col("o_orderkey")
    return S.table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus").select(
        k.alias("doc_id"),
        F.when(k % 97 == 0, "Q5").when(k % 7 != 0, F.concat(F.lit("Q"), F.quarter("o_orderdate"))).alias("season"),
        F.when(k % 2 != 0, F.when(F.col("o_totalprice") < 75000, "low").when(F.col("o_totalprice") < 200000, "mid").otherwise("high")).alias("price"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"))


def _network_sql() -> str:
    tables = []
    for n in NODES:
        rows = [(s, *[g[p] for p in PARENTS.get(n, [])], p) for m, s, g, p in cpt_rows() if m == n]
        if rows:
            tables.append(f"c_{n}({', '.join(['s', *PARENTS.get(n, []), 'p'])}) AS (VALUES "
                          + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else f"{x!r}e0" for x in r) + ")" for r in rows) + ")")
    known = [n for n in NODES if n != NO_TABLE]
    joins, seen = "", []
    for n in known:
        on = " AND ".join(f"c_{n}.{p} = c_{p}.s" for p in PARENTS.get(n, []))
        joins += f" {'JOIN' if on else 'CROSS JOIN'} c_{n}{' ON ' + on if on else ''}" if seen else f"FROM c_{n}"
        seen.append(n)
    observed = ["season", "price", "priority", "status"]
    marginals = " UNION ALL ".join(f"SELECT {', '.join('e_' + o for o in observed)}, '{n}' AS node, {n} AS state, sum(p) AS p FROM seen GROUP BY ALL" for n in known)
    domain = ", ".join(f"({q(n)}, {q(s)}, {len(ss)})" for n, ss in NODES.items() for s in ss)
    same = " AND ".join(f"m.e_{o} IS NOT DISTINCT FROM ev.e_{o}" for o in observed)
    return "WITH " + ",\n".join(tables) + f""",
orders_ev AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'Q5' WHEN o_orderkey % 7 <> 0 THEN 'Q' || quarter(o_orderdate) END AS e_season,
  CASE WHEN o_orderkey % 2 <> 0 THEN CASE WHEN o_totalprice < 75000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END END AS e_price,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS e_priority, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS e_status FROM orders),
ev AS (SELECT e_season, e_price, e_priority, e_status, CAST(count(*) AS BIGINT) AS docs FROM orders_ev GROUP BY ALL),
joint AS (SELECT {', '.join(f'c_{n}.s AS {n}' for n in known)}, {' * '.join(f'c_{n}.p' for n in known)} AS p {joins}),
seen AS (SELECT ev.*, joint.* FROM ev JOIN joint ON {' AND '.join(f'(e_{o} IS NULL OR e_{o} = {o})' for o in observed)}),
m AS ({marginals}),
d(node, state, k) AS (VALUES {domain}),
t AS (SELECT e_season, e_price, e_priority, e_status, node, sum(p) AS total FROM m GROUP BY ALL)
SELECT ev.e_season AS season, ev.e_price AS price, ev.e_priority AS priority, ev.e_status AS status, ev.docs, d.node, d.state,
  round(CASE WHEN coalesce(t.total, 0) > 0 THEN coalesce(m.p, 0) / t.total ELSE 1e0 / d.k END, {R}) AS p
FROM ev CROSS JOIN d LEFT JOIN m ON m.node = d.node AND m.state = d.state AND {same}
LEFT JOIN t ON t.node = d.node AND {same.replace('m.', 't.')}"""


@register("A13_network_from_tables", _network_sql())
def a13_network(spark, sf):
    """Posterior of all 12 nodes on every order's evidence; impossible evidence and a node without a table are uniform."""
    ev = order_evidence(spark, sf)
    names = ["season", "price", "priority", "status"]
    observed = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)), lambda _, v: v.isNotNull())
    post = X.infer(order_network(spark), ev.withColumn("observed", observed))
    return post.groupBy(*names, "node", "state").agg(F.round(F.first("p"), R).alias("p"), F.count(F.lit(1)).alias("docs"))


# ---------------------------------------------------------------- A12 factors of the data

@register("A12_factor_algebra", f"""
WITH pr AS (SELECT o_orderpriority AS a, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1),
st AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p FROM orders GROUP BY 1, 2),
ln AS (SELECT o_orderstatus AS b, l_returnflag AS c, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS p
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT c AS flag, round(sum(pr.p * st.p * ln.p) / sum(sum(pr.p * st.p * ln.p)) OVER (), {R}) AS p
FROM pr JOIN st USING (a) JOIN ln USING (b) GROUP BY c""")
def a12_algebra(spark, sf):
    """P(return flag) from P(priority) P(status | priority) P(flag | status): products, summing out, normalising."""
    orders = S.table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    lines = S.table(spark, sf, "lineitem", "l_orderkey", "l_returnflag")

    def counted(df, *names):
        return df.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("p"))
    priority = X.normalized(counted(orders, "o_orderpriority"))
    status = X.normalized(counted(orders, "o_orderpriority", "o_orderstatus"), "o_orderpriority")
    flag = X.normalized(counted(orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")), "o_orderstatus", "l_returnflag"), "o_orderstatus")
    first = X.sum_out(X.product(status, priority), "o_orderpriority")
    out = X.normalized(X.sum_out(X.product(flag, first), "o_orderstatus"))
    return out.select(F.col("l_returnflag").alias("flag"), F.round("p", R).alias("p"))


# ---------------------------------------------------------------- A5 on tables with faults

_A5_SQL = """
WITH n AS (SELECT DISTINCT 'priority' AS node, o_orderpriority AS state FROM orders UNION ALL SELECT DISTINCT 'status', o_orderstatus FROM orders
  UNION ALL SELECT DISTINCT 'season', 'Q' || quarter(o_orderdate) FROM orders UNION ALL SELECT 'flag', l_returnflag FROM lineitem WHERE l_orderkey = 1 GROUP BY ALL
  UNION ALL SELECT 'flag', min(l_returnflag) FROM lineitem WHERE l_orderkey = 1),
e(child, parent) AS (VALUES ('status', 'priority'), ('season', 'season'), ('season', 'ghost'), ('flag', 'status')),
c AS (SELECT 'priority' AS node, o_orderpriority AS state, '' AS config, '' AS of, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 2
  UNION ALL SELECT 'status', o_orderstatus, o_orderpriority, 'priority', count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority)
    FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 2, 3
  UNION ALL SELECT 'season', 'Q' || quarter(o_orderdate), '', '', CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2),
ns AS (SELECT node, count(state) AS n, count(DISTINCT state) AS d FROM n GROUP BY 1),
pc AS (SELECT node, config, of, count(state) AS n, count(DISTINCT state) AS d, sum(p) AS total, bool_and(p BETWEEN 0 AND 1) AS vals FROM c GROUP BY 1, 2, 3),
pa AS (SELECT child AS node, string_agg(DISTINCT parent, ',' ORDER BY parent) AS parents FROM e GROUP BY 1),
ce AS (SELECT child AS node, product(d) AS configurations FROM e JOIN ns ON ns.node = e.parent GROUP BY 1),
sh AS (SELECT pc.node, bool_and(pc.n = pc.d AND pc.d = coalesce(ns.d, -1) AND pc.of = coalesce(pa.parents, '')) AS ok, count(DISTINCT config) AS found,
  bool_and(vals) AS vals, bool_and(abs(total - 1) <= 1e-6) AS sums FROM pc LEFT JOIN ns USING (node) LEFT JOIN pa USING (node) GROUP BY 1)
SELECT 'unique_states' AS "check", node AS subject, n = d AS ok FROM ns UNION ALL SELECT 'has_states', node, d >= 1 FROM ns
UNION ALL SELECT 'parent_exists', child || '<-' || parent, parent IN (SELECT node FROM n) FROM e
UNION ALL SELECT 'no_self_parent', child || '<-' || parent, child <> parent FROM e
UNION ALL SELECT 'cpt_shape', sh.node, sh.ok AND found = coalesce(configurations, 1) FROM sh LEFT JOIN ce USING (node)
UNION ALL SELECT 'cpt_values', node, vals FROM sh UNION ALL SELECT 'cpt_sums', node, sums FROM sh"""


@register("A5_network_faults", _A5_SQL)
def a5_faults(spark, sf):
    """The checks on tables counted from orders, with a state listed twice, a missing and a self parent, a
    configuration without rows, and raw counts for probabilities."""
    orders = S.table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    flags = S.table(spark, sf, "lineitem", "l_orderkey", "l_returnflag").filter("l_orderkey = 1")
    season = F.concat(F.lit("Q"), F.quarter("o_orderdate"))
    node = lambda n, c, df: df.select(F.lit(n).alias("node"), c.alias("state")).distinct()
    nodes = (node("priority", F.col("o_orderpriority"), orders).unionByName(node("status", F.col("o_orderstatus"), orders))
             .unionByName(node("season", season, orders)).unionByName(node("flag", F.col("l_returnflag"), flags))
             .unionByName(flags.agg(F.min("l_returnflag").alias("state")).select(F.lit("flag").alias("node"), "state")))
    edges = spark.createDataFrame([("status", "priority", 0), ("season", "season", 0), ("season", "ghost", 1), ("flag", "status", 0)],
                                  "child STRING, parent STRING, pos INT")
    none = F.create_map().cast("map<string,string>")
    priority = X.normalized(orders.groupBy(F.col("o_orderpriority").alias("state")).agg(F.count(F.lit(1)).cast("double").alias("p")))
    status = X.normalized(orders.filter("o_orderpriority <> '5-LOW'").groupBy("o_orderpriority", F.col("o_orderstatus").alias("state"))
                          .agg(F.count(F.lit(1)).cast("double").alias("p")), "o_orderpriority")
    seasons = orders.groupBy(season.alias("state")).agg(F.count(F.lit(1)).cast("double").alias("p"))
    cpt = (priority.select(F.lit("priority").alias("node"), "state", none.alias("given"), "p")
           .unionByName(status.select(F.lit("status").alias("node"), "state", F.create_map(F.lit("priority"), "o_orderpriority").alias("given"), "p"))
           .unionByName(seasons.select(F.lit("season").alias("node"), "state", none.alias("given"), "p")))
    return X.check_tables(nodes, edges, cpt)
