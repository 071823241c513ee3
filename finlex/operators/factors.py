"""Inference in any discrete network given as tables.

A network is three tables: ``nodes(node, state, ord)``, ``edges(child, parent, pos)`` and
``cpt(node, state, given MAP<parent, state>, p)``.

* A factor is a table with one column of state numbers per variable and ``p``.  A product is a
  join on the shared columns, summing out a ``groupBy`` over the others, normalising a
  division by the window sum (a zero sum gives the uniform factor).
* The structure plans a bucket tree: variables are summed out in the order that keeps the
  next factor smallest, and a bucket's potential is the product of the factors whose first
  variable it is.  Potentials depend on the network alone and are bounded by ``MAX_CELLS``;
  on a row a factor is the array of its cells, and a product aligns cells by number.
* Documents never meet a join with them: their evidence is a map of observed states, and the
  two passes of messages over the bucket tree are array products over an Arrow batch of
  combinations.  That gives the posterior of every node for evidence on any nodes, without a
  shuffle.
* Evidence repeats, so inference runs once per distinct combination and its result is
  joined back.

Evidence that cannot occur (a state the node does not have, or a combination of probability
zero) gives every node connected to it the uniform distribution; a node without a table,
and a parent configuration without rows, are uniform too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_NODES = 1_000
MAX_CELLS = 100_000  # of one factor, and of a network's tables
SLICE_CELLS = 1 << 20  # of a batch's factors at once
# Distinct combinations whose posteriors are broadcast; more meet the documents by a shuffle join.
BROADCAST_COMBINATIONS = 10_000


# ---------------------------------------------------------------- A12 factors as tables

def variables(factor: DataFrame) -> list[str]:
    return [c for c in factor.columns if c != "p"]


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on the shared variables; without shared ones every row meets every row (factors are bounded)."""
    shared = [v for v in variables(a) if v in variables(b)]
    b = b.withColumnRenamed("p", "__p")
    joined = a.join(F.broadcast(b), shared) if shared else a.crossJoin(F.broadcast(b))
    return joined.withColumn("p", F.col("p") * F.col("__p")).drop("__p")


def sum_out(factor: DataFrame, *gone: str) -> DataFrame:
    keep = [v for v in variables(factor) if v not in gone]
    return factor.groupBy(*keep).agg(F.sum("p").alias("p"))


def normalized(factor: DataFrame, *within: str) -> DataFrame:
    """Divide by the sum over the rows that agree in ``within``; a zero sum gives the uniform factor."""
    w = Window.partitionBy(*within)
    total = F.sum("p").over(w)
    return factor.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))


# ---------------------------------------------------------------- A5 checks

def check_tables(nodes: DataFrame, edges: DataFrame, cpt: DataFrame, tol: float = 1e-6) -> DataFrame:
    """A5: every constraint as (check, subject, ok), one row a subject.

    unique_states and has_states per node, parent_exists and no_self_parent per edge, and per
    table: cpt_shape (one row per state and parent configuration, over exactly the declared
    parents), cpt_values (within [0, 1], no NaN or null) and cpt_sums (one per configuration).
    """
    def rows(df: DataFrame, check: str, subject: str, ok: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), F.col(subject).alias("subject"), ok.alias("ok"))

    states = nodes.groupBy("node").agg(F.count("state").alias("n"), F.countDistinct("state").alias("d"))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("found")).distinct()
    links = edges.join(known, "parent", "left").withColumn("edge", F.concat_ws("<-", "child", "parent"))
    parents = edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    cells = (edges.join(states.select(F.col("node").alias("parent"), "d"), "parent").groupBy("child")
             .agg(F.product(F.col("d").cast("double")).alias("configurations")))
    per_config = (cpt.withColumn("config", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("given")))))
                  .groupBy("node", "config").agg(F.count("state").alias("n"), F.countDistinct("state").alias("d"), F.sum("p").alias("total"),
                                                 F.first(F.array_sort(F.map_keys("given"))).alias("of"),
                                                 F.bool_and(F.col("p").isNotNull() & ~F.isnan("p") & F.col("p").between(0, 1)).alias("values")))
    shape = (per_config.join(states.select("node", F.col("d").alias("states")), "node", "left")
             .join(parents.withColumnRenamed("child", "node"), "node", "left")
             .groupBy("node").agg(
                 F.bool_and((F.col("n") == F.col("d")) & F.coalesce(F.col("d") == F.col("states"), F.lit(False))
                            & (F.col("of") == F.coalesce("parents", F.array().cast("array<string>")))).alias("rows_ok"),
                 F.countDistinct("config").alias("found"), F.bool_and("values").alias("values"),
                 F.bool_and(F.coalesce(F.abs(F.col("total") - 1) <= tol, F.lit(False))).alias("sums"))
             .join(cells.withColumnRenamed("child", "node"), "node", "left"))
    out = [rows(states, "unique_states", "node", F.col("n") == F.col("d")), rows(states, "has_states", "node", F.col("d") >= 1),
           rows(links, "parent_exists", "edge", F.col("found").isNotNull()),
           rows(links, "no_self_parent", "edge", F.col("child") != F.col("parent")),
           rows(shape, "cpt_shape", "node", F.col("rows_ok") & (F.col("found") == F.coalesce("configurations", F.lit(1.0)))),
           rows(shape, "cpt_values", "node", F.col("values")), rows(shape, "cpt_sums", "node", F.col("sums"))]
    report = out[0]
    for x in out[1:]:
        report = report.unionByName(x)
    return report


# ---------------------------------------------------------------- the plan of a network

@dataclass
class Bucket:
    """A clique of the bucket tree: the variable it sums out, all its variables, and its neighbours."""
    variable: str
    scope: list[str]
    members: list[str] = field(default_factory=list)   # nodes whose factor belongs here
    children: list[int] = field(default_factory=list)
    parent: int | None = None

    @property
    def separator(self) -> list[str]:
        return [v for v in self.scope if v != self.variable]


def plan(states: dict[str, list[str]], scopes: dict[str, list[str]]) -> list[Bucket]:
    """Buckets in the order of summing out; ``scopes`` are the variables of each node's factor.

    The next variable is the one whose neighbours make the smallest factor, ties by name.
    """
    near = {v: set() for v in states}
    for scope in scopes.values():
        for v in scope:
            near[v] |= set(scope) - {v}
    buckets: list[Bucket] = []
    place: dict[str, int] = {}
    while near:
        v = min(near, key=lambda x: (math.prod(len(states[y]) for y in near[x]), x))
        scope = [v, *sorted(near[v])]
        if math.prod(len(states[y]) for y in scope) > MAX_CELLS:
            raise ValueError(f"a factor over {scope} is too large: the network's parts are too densely linked")
        place[v] = len(buckets)
        buckets.append(Bucket(v, scope))
        for x in near[v]:
            near[x] |= near[v] - {x}
            near[x].discard(v)
        del near[v]
    for i, b in enumerate(buckets):
        if b.separator:
            b.parent = min(place[v] for v in b.separator)
            buckets[b.parent].children.append(i)
    for node, scope in scopes.items():
        buckets[min(place[v] for v in scope)].members.append(node)
    return buckets


def cell_numbers(scope: list[str], sizes: dict[str, int], of: list[str]) -> list[int]:
    """For every cell of ``scope`` (the last variable runs fastest) the number of its cell in ``of``."""
    out = [0]
    steps, step = {}, 1
    for v in reversed(of):
        steps[v], step = step, step * sizes[v]
    for v in scope:
        out = [x + k * steps.get(v, 0) for x in out for k in range(sizes[v])]
    return out


class Network:
    """States, parents and bucket potentials of a network, read from its tables (bounded, see MAX_*)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, cpt: DataFrame):
        listed = nodes.orderBy("node", "ord").limit(MAX_CELLS + 1).collect()
        links = edges.orderBy("child", "pos").limit(MAX_CELLS + 1).collect()
        self.states: dict[str, list[str]] = {}
        for r in listed:
            self.states.setdefault(r.node, []).append(r.state)
        if len(self.states) > MAX_NODES or len(listed) > MAX_CELLS or len(links) > MAX_CELLS:
            raise ValueError("the network is too large")
        self.parents = {n: [r.parent for r in links if r.child == n] for n in self.states}
        self._check(links)
        self.sizes = {n: len(s) for n, s in self.states.items()}
        self.buckets = plan(self.states, {n: [n, *ps] for n, ps in self.parents.items()})
        self.potentials = self._potentials(cpt)

    def _check(self, links) -> None:
        for r in links:
            if r.child not in self.states or r.parent not in self.states:
                raise ValueError(f"edge {r.child} <- {r.parent}: no such node")
        for n, s in self.states.items():
            if len(set(s)) < len(s):
                raise ValueError(f"node {n} has a state twice")
        left = {n: set(p) for n, p in self.parents.items()}
        while left:
            free = [n for n, p in left.items() if not p & set(left)]
            if not free:
                raise ValueError(f"the network has a cycle among {sorted(left)}")
            for n in free:
                del left[n]

    def _factors(self, cpt: DataFrame) -> dict[str, list[float]]:
        """Each node's table as cell values over (node, *parents), normalised per parent configuration."""
        ords = F.lit(None).cast("int")
        for n in self.states:  # state numbers of the row's node and parents, the last parent fastest
            numbers = {m: F.create_map(*[F.lit(x) for k, st in enumerate(self.states[m]) for x in (st, k)]) for m in (n, *self.parents[n])}
            cell = numbers[n][F.col("state")]
            for v in self.parents[n]:
                cell = cell * self.sizes[v] + numbers[v][F.col("given")[v]]
            ords = F.when(F.col("node") == n, cell).otherwise(ords)
        rows = normalized(cpt.filter(F.col("p") > 0).select("node", ords.alias("cell"), "p",
                                                            F.to_json(F.array_sort(F.map_entries("given"))).alias("config")), "node", "config")
        listed = rows.filter(F.col("cell").isNotNull()).select("node", "cell", "p").limit(MAX_CELLS + 1).collect()
        if len(listed) > MAX_CELLS:
            raise ValueError("the network's tables are too large")
        found: dict[str, dict[int, float]] = {}
        for r in listed:
            found.setdefault(r.node, {})[r.cell] = r.p
        out = {}
        for n, parents in self.parents.items():
            configurations, k = math.prod(self.sizes[v] for v in parents), self.sizes[n]
            given = found.get(n, {})
            empty = {c for c in range(configurations)} - {c % configurations for c in given}
            out[n] = [1.0 / k if c % configurations in empty else given.get(c, 0.0) for c in range(k * configurations)]
        return out

    def _potentials(self, cpt: DataFrame) -> list[list[float]]:
        """Each bucket's product of its factors, as cell values in the order of its scope."""
        factors, out = self._factors(cpt), []
        for b in self.buckets:
            values = [1.0] * math.prod(self.sizes[v] for v in b.scope)
            for n in b.members:
                values = [x * factors[n][c] for x, c in zip(values, cell_numbers(b.scope, self.sizes, [n, *self.parents[n]]))]
            out.append(values)
        return out


# ---------------------------------------------------------------- A13 messages on a row

def _times(a: np.ndarray, of_a: list[str], b: np.ndarray, of_b: list[str]) -> np.ndarray:
    """Product over the cells of ``a``; the variables of ``b`` are among those of ``a``.  Axis 0 runs over rows."""
    order = [0, *[1 + of_b.index(v) for v in of_a if v in of_b]]
    shape = [b.shape[0], *[b.shape[1 + of_b.index(v)] if v in of_b else 1 for v in of_a]]
    return a * b.transpose(order).reshape(shape)


def _sum_to(a: np.ndarray, of_a: list[str], keep: list[str]) -> np.ndarray:
    """Sum out all other variables; the result's axes follow ``keep``."""
    left = [v for v in of_a if v in keep]
    summed = a.sum(axis=tuple(1 + i for i, v in enumerate(of_a) if v not in keep))
    return summed.transpose([0, *[1 + left.index(v) for v in keep]])


def _scaled(a: np.ndarray) -> np.ndarray:
    """The same message with greatest value one, so that long products do not underflow."""
    top = a.reshape(len(a), -1).max(axis=1).reshape(-1, *[1] * (a.ndim - 1))
    return np.divide(a, top, out=a.copy(), where=top > 0)


def marginals(net: Network, marks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """(rows, states) of every node; ``marks`` are ones where the evidence allows a state."""
    rows = len(next(iter(marks.values())))
    own, belief, up, down, out = {}, {}, {}, {}, {}

    def from_children(i: int, but: int | None = None) -> np.ndarray:
        value = own[i]
        for c in net.buckets[i].children:
            if c != but:
                value = _times(value, net.buckets[i].scope, up[c], net.buckets[c].separator)
        return value

    for i, b in enumerate(net.buckets):  # each variable is summed out after its children
        shape = [net.sizes[v] for v in b.scope]
        own[i] = _times(np.broadcast_to(np.reshape(net.potentials[i], shape), (rows, *shape)), b.scope, marks[b.variable], [b.variable])
        belief[i] = from_children(i)
        up[i] = _scaled(_sum_to(belief[i], b.scope, b.separator))
    for i in reversed(range(len(net.buckets))):  # and hears from its parent
        b, full = net.buckets[i], belief[i]
        if b.parent is not None:
            above = net.buckets[b.parent]
            rest = from_children(b.parent, but=i)
            if above.parent is not None:
                rest = _times(rest, above.scope, down[b.parent], above.separator)
            down[i] = _scaled(_sum_to(rest, above.scope, b.separator))
            full = _times(full, b.scope, down[i], b.separator)
        p = _sum_to(full, b.scope, [b.variable])
        total = p.sum(axis=1, keepdims=True)
        out[b.variable] = np.divide(p, total, out=np.full_like(p, 1.0 / p.shape[1]), where=total > 0)
    return out


def posterior(net: Network, rows: DataFrame, observed: str = "observed") -> DataFrame:
    """``rows`` with ``posterior``: an array of (node, state, ord, p) over all nodes.  A narrow step.

    ``observed`` is a map from node to state; absent or null means unobserved, and an entry
    for a node that the network lacks is not looked at.
    """
    names = list(net.states)
    spec = T.StructType.fromDDL("posterior ARRAY<STRUCT<node: STRING, state: STRING, ord: INT, p: DOUBLE>>")
    given = rows.columns
    place, largest = given.index(observed), max(len(x) for x in net.potentials)
    step = max(1, SLICE_CELLS // largest)
    head = [(n, s, k) for n in names for k, s in enumerate(net.states[n])]
    width = len(head)
    columns = [pa.array([h[j] for h in head], t) for j, t in ((0, pa.string()), (1, pa.string()), (2, pa.int32()))]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        maps = [dict(m or ()) for m in b.column(place).to_pylist()]
        marks = {n: np.array([[m.get(n) is None or m[n] == s for s in net.states[n]] for m in maps], float) for n in names}
        p = marginals(net, marks)
        repeat = pa.array(np.tile(np.arange(width), len(maps)))
        cells = pa.StructArray.from_arrays([*[c.take(repeat) for c in columns], pa.array(np.hstack([p[n] for n in names]).ravel())],
                                           ["node", "state", "ord", "p"])
        table = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(maps) + 1, width, dtype=np.int32)), cells)
        return pa.RecordBatch.from_arrays([*b.columns, table], [*given, "posterior"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, step):
                yield one(b.slice(at, step))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *spec.fields]))


def combination(observed: Column) -> Column:
    """One text for equal evidence, whatever the order of the map's entries."""
    known = F.map_filter(F.coalesce(observed, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    return F.to_json(F.array_sort(F.map_entries(known)))


def infer(net: Network, evidence: DataFrame, observed: str = "observed") -> DataFrame:
    """(the columns of ``evidence``, node, state, ord, p), inferred once per distinct combination."""
    keyed = evidence.withColumn("__key", combination(F.col(observed)))
    # equal keys have equal maps
    combos = keyed.groupBy("__key").agg(F.first(observed).alias(observed)).checkpoint()
    few = combos.count() <= BROADCAST_COMBINATIONS
    post = posterior(net, combos, observed).select("__key", "posterior")
    return keyed.join(F.broadcast(post) if few else post, "__key").select(*evidence.columns, F.inline("posterior"))
