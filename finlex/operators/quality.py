"""Run-quality operators: contracts, error taxonomy, gates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: error codes with severity and component.
ERROR_TAXONOMY = {
    "NULL_TEXT": ("error", "validator"), "TEXT_TOO_SHORT": ("warning", "validator"),
    "TEXT_TRUNCATED": ("info", "validator"), "INVALID_METADATA_JSON": ("error", "validator"),
    "MISSING_METADATA_FIELD": ("error", "validator"), "EMPTY_INPUT": ("error", "preprocessor"),
    "MISSING_TEXT": ("error", "preprocessor"), "STEP_ERROR": ("error", "preprocessor"),
    "MODEL_NOT_TRAINED": ("critical", "classifier"), "PREDICTION_ERROR": ("error", "classifier"),
    "TOKENIZER_FALLBACK": ("warning", "preprocessor"), "BATCH_LIMIT": ("error", "validator"),
    "UNKNOWN_ERROR": ("error", "general"), "INTERNAL_ERROR": ("critical", "general"),
    "NOT_IMPLEMENTED": ("error", "general"),
    "INITIALIZATION_ERROR": ("critical", "initialization"), "RESOURCE_NOT_FOUND": ("error", "initialization"),
    "CONFIGURATION_ERROR": ("critical", "initialization"),
    "INVALID_INPUT": ("error", "input"), "MALFORMED_INPUT": ("error", "input"),
    "MODEL_LOAD_ERROR": ("critical", "model"), "MODEL_SAVE_ERROR": ("error", "model"),
    "PREPROCESSING_ERROR": ("error", "preprocessor"), "FEATURE_EXTRACTION_ERROR": ("error", "preprocessor"),
    "CLASSIFICATION_ERROR": ("error", "classifier"),
    "INFERENCE_ERROR": ("error", "network"), "CONVERGENCE_ERROR": ("warning", "network"),
    "INCOMPATIBLE_EVIDENCE": ("error", "network"),
    "VALIDATION_ERROR": ("error", "validator"), "DIMENSIONALITY_ERROR": ("error", "validator"),
}


def error_info(code: Column) -> Column:
    """STRUCT<severity, component> for an error code (unknown -> error / unknown)."""
    sev = F.create_map(*[x for k, (s, _) in ERROR_TAXONOMY.items() for x in (F.lit(k), F.lit(s))])
    comp = F.create_map(*[x for k, (_, c) in ERROR_TAXONOMY.items() for x in (F.lit(k), F.lit(c))])
    return F.struct(F.coalesce(sev[code], F.lit("error")).alias("severity"),
                    F.coalesce(comp[code], F.lit("unknown")).alias("component"))


def error_counts(errors: DataFrame, code_col: str = "error_code") -> DataFrame:
    """Count by (code, severity, component)."""
    e = errors.filter(F.col(code_col).isNotNull()).select(F.col(code_col).alias("error_code"),
                                                          error_info(F.col(code_col)).alias("i"))
    return e.groupBy("error_code", F.col("i.severity").alias("severity"), F.col("i.component").alias("component")) \
        .agg(F.count(F.lit(1)).alias("n"))


def nested_contract_report(df: DataFrame, contract: dict) -> DataFrame:
    """V10 with nesting: (path, check, violations) over struct, map and array columns, in one aggregate pass.

    ``contract = {field: spec}``; a spec may have ``type``, ``required``, ``allowed``,
    ``properties`` (of a struct or map: a contract again) and ``items`` (of an array: a spec).
    Paths read ``a.b`` and ``a[]``.  Within a missing parent nothing is checked.  ``type`` is
    the declared type's name, or for values of a map of strings a type they must cast to.
    """
    from pyspark.sql import types as T
    aggs: list[tuple[str, str, Column]] = []

    def count(values: Column, bad) -> Column:
        return F.sum(F.size(F.filter(values, bad)))

    def spec_checks(path: str, values: Column, kind: T.DataType | None, spec: dict, text: bool) -> None:
        # ``values``: what stands at the path in a row, as an array
        if kind is None:
            aggs.append((path, "present", F.lit(1)))
            return
        if "type" in spec:
            aggs.append((path, "type", count(values, lambda x: x.isNotNull() & x.try_cast(spec["type"]).isNull()) if text and spec["type"] != "string"
                         else F.lit(0 if kind.simpleString() == spec["type"] else 1)))
        if spec.get("required"):
            aggs.append((path, "required", count(values, lambda x: x.isNull())))
        if "allowed" in spec:
            aggs.append((path, "allowed", count(values, lambda x: x.isNotNull() & ~x.isin(*spec["allowed"]))))
        known = F.filter(values, lambda x: x.isNotNull())
        for name, below in spec.get("properties", {}).items():
            if isinstance(kind, T.StructType):
                child = kind[name].dataType if name in kind.names else None
            else:
                child = kind.valueType if isinstance(kind, T.MapType) else None
            got = known if child is None else F.transform(known, _at(name))
            spec_checks(f"{path}.{name}", got, child, below, isinstance(kind, T.MapType) and isinstance(child, T.StringType))
        if "items" in spec:
            child = kind.elementType if isinstance(kind, T.ArrayType) else None
            spec_checks(f"{path}[]", F.flatten(known) if child is not None else known, child, spec["items"], False)

    for name, spec in contract.items():
        kind = df.schema[name].dataType if name in df.columns else None
        spec_checks(name, F.array(F.col(f"`{name}`")) if kind is not None else F.array(), kind, spec, False)
    if not aggs:
        return df.sparkSession.createDataFrame([], "path STRING, check STRING, violations BIGINT")
    row = df.agg(*[a.alias(f"v{i}") for i, (_, _, a) in enumerate(aggs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("check"), F.coalesce(
        F.col(f"v{i}").cast("bigint"), F.lit(0)).alias("violations")) for i, (p, c, _) in enumerate(aggs)])))


def _at(name: str):
    return lambda x: x[name]


def contract_report(df: DataFrame, contract: dict) -> DataFrame:
    """Dataset contract in one aggregate pass.

    ``contract = {column: {"type": "bigint", "required": True, "allowed": [...]}}``;
    output ``(column, check, violations)``; an empty contract gives no rows.
    """
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    spark = df.sparkSession
    aggs, checks, meta = [], [], []
    for col, spec in contract.items():
        if col not in types:
            meta.append((col, "present", 1))
            continue
        if "type" in spec:
            meta.append((col, "type", 0 if types[col] == spec["type"] else 1))
        if spec.get("required"):
            aggs.append(F.count_if(F.col(f"`{col}`").isNull()))
            checks.append((col, "required"))
        if "allowed" in spec:
            aggs.append(F.count_if(~F.col(f"`{col}`").isin(*spec["allowed"])))
            checks.append((col, "allowed"))
    out = spark.createDataFrame(meta, "column STRING, check STRING, violations BIGINT")
    if aggs:
        row = df.agg(*[a.alias(f"v{i}") for i, a in enumerate(aggs)])
        out = out.unionByName(row.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col(f"v{i}").cast("bigint").alias("violations"))
            for i, (c, k) in enumerate(checks)])).alias("x")).select("x.*"))
    return out


def gate(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the job (before any commit) when ``condition`` holds for some row.

    The check is a filter that lets every other row through: unlike a column it cannot be
    pruned, whatever the caller selects.
    """
    return df.filter(F.when(condition, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def throughput_report(results: DataFrame, seconds: float, error_col: str = "error_code") -> DataFrame:
    """Q1: samples, processed, errors, success rate, samples per second."""
    return results.agg(F.count(F.lit(1)).alias("samples"),
                       F.count_if(F.col(error_col).isNull()).alias("processed"),
                       F.count_if(F.col(error_col).isNotNull()).alias("errors")) \
        .withColumn("success_rate", (F.col("samples") - F.col("errors")) / F.col("samples")) \
        .withColumn("samples_per_sec", F.col("samples") / F.lit(max(seconds, 1e-9)))
