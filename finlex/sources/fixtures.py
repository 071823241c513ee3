"""Derived fixtures over the provided tables (FIXTURES.md §3).

``ann`` (announcements, one per order) and ``preds`` (three classifier outputs
per order) are deterministic views: they scale with the data, so every query
built on them does work proportional to ``orders``.  Each has a DataFrame form
(used by the engine) and an SQL form (inlined as a CTE by the DuckDB oracles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# FIXED VALUES: class lists of the three models, in their cyclic order.
TYPE_CLASSES = ["report", "announcement", "guidance", "analysis", "news"]
SENTIMENT_CLASSES = ["positive", "neutral", "negative"]
IMPACT_CLASSES = ["high", "medium", "low"]
MODELS = {"type_classifier": TYPE_CLASSES, "sentiment_analyzer": SENTIMENT_CLASSES,
          "impact_modeler": IMPACT_CLASSES}
LABEL_COLUMN = {"type_classifier": "type_label", "sentiment_analyzer": "sentiment_label",
                "impact_modeler": "impact_label"}


def _case(col: Column, mapping: list[tuple[str, str]], default: str) -> Column:
    out = None
    for k, v in mapping:
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(default)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Slim rows of a few large files, dealt by key over tasks of bounded size before texts are made of them."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism  # the count reads footers
    return rows.repartition(max(1, min(n // 5_000, 4 * cores), n // 100_000), key)


def ann_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ann`` for work on its texts: every core has a share of the orders."""
    return ann(spark, sf_dir, orders=spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                                                  "o_totalprice", "o_orderdate", "o_orderpriority"), "o_orderkey"))


def ann(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """``orders`` may be a stream: the customer side is then a stream-static join."""
    o = orders if orders is not None else table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                                                "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    seg, key, cust = F.col("c_mktsegment"), F.col("o_orderkey"), F.col("o_custkey")
    status, prio = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    opening = _case(seg, [
        ("AUTOMOBILE", "Relatório trimestral: a companhia apresenta o resultado trimestral. "),
        ("BUILDING", "FATO RELEVANTE: comunicado ao mercado e aviso aos acionistas. "),
        ("FURNITURE", "Guidance: projeção e expectativa da administração. "),
        ("HOUSEHOLD", "Análise técnica: suporte, resistência e tendência. ")],
        "Distribuição de dividendos: pagamento de proventos. ")
    tone = (F.when(key % 7 == 0, "O conselho se reuniu. ")
            .when(status == "F", "Houve crescimento e lucro, um resultado muito forte, sem perda. ")
            .when(status == "O", "Houve queda e prejuízo; a empresa não registrou nenhuma expansão. ")
            .otherwise("O resultado foi estável e em linha com o previsto. "))
    effect = _case(prio, [("1", "Efeito enorme e extraordinário"), ("2", "Efeito expressivo"),
                          ("3", "Efeito moderado"), ("4", "Efeito razoável")], "Efeito leve e limitado")
    horizon = (F.when(cust % 4 == 0, " no curto prazo").when(cust % 4 == 1, " nos próximos meses")
               .when(cust % 4 == 2, " no longo prazo").otherwise(""))
    text = F.concat(opening, tone, effect, horizon, F.lit(", de "), (key % 40).cast("string"), F.lit(","),
                    (cust % 10).cast("string"), F.lit("% e "), (cust % 12).cast("string"),
                    F.lit(" %, no valor de R$ "),
                    F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(" mil."))
    return j.select(
        key.alias("doc_id"), text.alias("text"),
        _case(seg, [("AUTOMOBILE", "report"), ("BUILDING", "announcement"), ("FURNITURE", "guidance"),
                    ("HOUSEHOLD", "analysis")], "news").alias("type_label"),
        _case(status, [("F", "positive"), ("O", "negative")], "neutral").alias("sentiment_label"),
        F.when(prio.isin("1", "2"), "high").when(prio.isin("3", "4"), "medium").otherwise("low")
        .alias("impact_label"),
        F.when(cust % 3 == 0, "site").when(cust % 3 == 1, "pdf report").otherwise("internal email")
        .alias("source"),
        F.col("o_orderdate").cast("date").alias("doc_date"))


def ann_metadata(a: DataFrame) -> Column:
    """``ann`` metadata map: source and ISO date."""
    return F.create_map(F.lit("source"), F.col("source"), F.lit("date"), F.col("doc_date").cast("string"))


def preds_base(spark: SparkSession, sf_dir: str, a: DataFrame | None = None) -> DataFrame:
    """One row per order and model: (doc_id, confidence, model, true_class, predicted_class, _pi, _k, _arr)."""
    a = a if a is not None else ann(spark, sf_dir)
    outputs = []
    for model, classes in MODELS.items():
        arr = F.array(*[F.lit(c) for c in classes])
        k = len(classes)
        true_c = F.col(LABEL_COLUMN[model])
        ti = F.array_position(arr, true_c)  # 1-based
        pi = F.when(F.col("doc_id") % 11 == 0, (ti % k) + 1).otherwise(ti)
        outputs.append(F.struct(F.lit(model).alias("model"), true_c.alias("true_class"),
                                F.element_at(arr, pi.cast("int")).alias("predicted_class"),
                                pi.cast("int").alias("_pi"), F.lit(k).alias("_k"), arr.alias("_arr")))
    return a.select("doc_id", (((F.col("doc_id") % 50) + 50) / F.lit(100.0)).alias("confidence"),
                    F.inline(F.array(*outputs)))


def preds_long(spark: SparkSession, sf_dir: str, a: DataFrame | None = None) -> DataFrame:
    """``preds`` in long form: (doc_id, model, class, prob, predicted_class, confidence, true_class)."""
    base = preds_base(spark, sf_dir, a)
    conf = F.col("confidence")
    parts = F.array(
        F.struct(F.col("predicted_class").alias("class"), conf.alias("prob")),
        F.struct(F.element_at("_arr", ((F.col("_pi") % F.col("_k")) + 1).cast("int")).alias("class"),
                 (F.lit(0.7) * (F.lit(1.0) - conf)).alias("prob")),
        F.struct(F.element_at("_arr", (((F.col("_pi") + 1) % F.col("_k")) + 1).cast("int")).alias("class"),
                 (F.lit(0.3) * (F.lit(1.0) - conf)).alias("prob")))
    return (base.select("doc_id", "model", "predicted_class", "confidence", "true_class",
                        F.inline(parts)))


def preds(spark: SparkSession, sf_dir: str, a: DataFrame | None = None) -> DataFrame:
    """``preds`` in wide form with ``probabilities MAP<STRING,DOUBLE>``."""
    lf = preds_long(spark, sf_dir, a)
    return (lf.groupBy("doc_id", "model", "predicted_class", "confidence", "true_class")
            .agg(F.map_from_entries(F.collect_list(F.struct("class", "prob"))).alias("probabilities")))


# FIXED VALUES: the nine edge-case inputs of the reference benchmark.
EDGE_CASES = [
    (1, "", "empty"),
    (2, None, "null"),
    (3, "12345", "number"),
    (4, "a" * 1_000_000, "1,000,000 chars"),
    (5, "Ação ÇÃÕ éàü", "accents"),
    (6, "!@#$%^&*()_+-=[]{}|;':\",./<>?", "symbols"),
    (7, "texto\x00com\x01controle\x1f", "control"),
    (8, "<script>alert('x')</script>", "script"),
    (9, "SELECT * FROM users; DROP TABLE users;--", "sql"),
]


def edge_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_CASES, "case_id INT, text STRING, description STRING")


# ------------------------------------------------------------------ SQL forms

ANN_SQL = """
SELECT o_orderkey AS doc_id,
  concat(
    CASE c_mktsegment
      WHEN 'AUTOMOBILE' THEN 'Relatório trimestral: a companhia apresenta o resultado trimestral. '
      WHEN 'BUILDING'   THEN 'FATO RELEVANTE: comunicado ao mercado e aviso aos acionistas. '
      WHEN 'FURNITURE'  THEN 'Guidance: projeção e expectativa da administração. '
      WHEN 'HOUSEHOLD'  THEN 'Análise técnica: suporte, resistência e tendência. '
      ELSE 'Distribuição de dividendos: pagamento de proventos. ' END,
    CASE WHEN o_orderkey % 7 = 0 THEN 'O conselho se reuniu. '
      WHEN o_orderstatus = 'F' THEN 'Houve crescimento e lucro, um resultado muito forte, sem perda. '
      WHEN o_orderstatus = 'O' THEN 'Houve queda e prejuízo; a empresa não registrou nenhuma expansão. '
      ELSE 'O resultado foi estável e em linha com o previsto. ' END,
    CASE substr(o_orderpriority, 1, 1)
      WHEN '1' THEN 'Efeito enorme e extraordinário' WHEN '2' THEN 'Efeito expressivo'
      WHEN '3' THEN 'Efeito moderado' WHEN '4' THEN 'Efeito razoável' ELSE 'Efeito leve e limitado' END,
    CASE o_custkey % 4 WHEN 0 THEN ' no curto prazo' WHEN 1 THEN ' nos próximos meses'
      WHEN 2 THEN ' no longo prazo' ELSE '' END,
    ', de ', CAST(o_orderkey % 40 AS STRING), ',', CAST(o_custkey % 10 AS STRING), '% e ',
    CAST(o_custkey % 12 AS STRING), ' %, no valor de R$ ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING),
    ' mil.') AS text,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'report' WHEN 'BUILDING' THEN 'announcement'
    WHEN 'FURNITURE' THEN 'guidance' WHEN 'HOUSEHOLD' THEN 'analysis' ELSE 'news' END AS type_label,
  CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1','2') THEN 'high'
    WHEN substr(o_orderpriority, 1, 1) IN ('3','4') THEN 'medium' ELSE 'low' END AS impact_label,
  CASE o_custkey % 3 WHEN 0 THEN 'site' WHEN 1 THEN 'pdf report' ELSE 'internal email' END AS source,
  CAST(o_orderdate AS DATE) AS doc_date
FROM orders JOIN customer ON o_custkey = c_custkey
"""

PREDS_LONG_SQL = """
SELECT doc_id, model, predicted_class, confidence, true_class, c.class AS class, c.prob AS prob
FROM (
  SELECT doc_id, model, true_class, classes, k, pi, classes[pi] AS predicted_class,
         (doc_id % 50 + 50) / 100.0e0 AS confidence
  FROM (
    SELECT doc_id, m.model, m.classes, len(m.classes) AS k,
      CASE m.model WHEN 'type_classifier' THEN type_label
                   WHEN 'sentiment_analyzer' THEN sentiment_label ELSE impact_label END AS true_class,
      CASE WHEN doc_id % 11 = 0
           THEN (list_position(m.classes, CASE m.model WHEN 'type_classifier' THEN type_label
                   WHEN 'sentiment_analyzer' THEN sentiment_label ELSE impact_label END) % len(m.classes)) + 1
           ELSE list_position(m.classes, CASE m.model WHEN 'type_classifier' THEN type_label
                   WHEN 'sentiment_analyzer' THEN sentiment_label ELSE impact_label END) END AS pi
    FROM ann CROSS JOIN (VALUES
      ('type_classifier', ['report','announcement','guidance','analysis','news']),
      ('sentiment_analyzer', ['positive','neutral','negative']),
      ('impact_modeler', ['high','medium','low'])) m(model, classes)
  ) b0
) b CROSS JOIN LATERAL (VALUES
    (b.predicted_class, b.confidence),
    (b.classes[(b.pi % b.k) + 1], 0.7e0 * (1 - b.confidence)),
    (b.classes[((b.pi + 1) % b.k) + 1], 0.3e0 * (1 - b.confidence))) c(class, prob)
"""


def ctes(*names: str) -> str:
    """``WITH`` prefix defining the named fixtures for an oracle query."""
    defs = {"ann": ANN_SQL, "preds_long": PREDS_LONG_SQL}
    order = ["ann", "preds_long"]
    need = set(names)
    if "preds_long" in need:
        need.add("ann")
    parts = [f"{n} AS ({defs[n]})" for n in order if n in need]
    return "WITH " + ",\n".join(parts) + "\n"
