"""Lexicon sources and sinks (S3-S6) and lexicon-driven counting at any size.

A lexicon is the table ``lexicon(name, category, term, ord)``.  It may be as large as a
corpus's vocabulary: it is stored one row a term in range-ordered files, and terms are
numbered within range partitions, so no task sees a whole category.  Counting is one
Aho-Corasick scan per text in a pandas UDF, with the exact non-overlapping per-term
semantics.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..session import ensure_checkpoint_dir

CATEGORIES = ("positive", "negative", "neutral")
LEXICON_SCHEMA = "name STRING, category STRING, term STRING, ord INT"
LEXICON_BYTES = 256 << 20


def default_lexicon(spark: SparkSession, name: str = "default") -> DataFrame:
    rows = [(name, c, t, i) for c in CATEGORIES for i, t in enumerate(T.DEFAULT_LEXICON[c])]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``ord``, 0-based within ``group`` by ``order``.

    Rows are range-partitioned by group and order, so those of one group in one partition
    stand together; their places plus the sizes of the group's earlier partitions are the
    ordinals.  The table of sizes has at most one row a partition and group; groups are few.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    placed = (rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
              .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint())
    sizes = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (placed.join(F.broadcast(starts), ["_part", group])
            .withColumn("ord", (F.col("_before") + F.col("_at") - F.col("_first")).cast("int"))
            .drop("_part", "_at", "_first", "_before"))


def load_lexicon(spark: SparkSession, path: str, name: str | None = None, fmt: str | None = None) -> DataFrame | None:
    """S3: ``json`` (one object ``{category: [terms]}``), ``csv`` (``term,sentiment`` in file
    order), ``jsonl`` or ``parquet`` (one row a term); by default as the path ends.

    CSV categories are lower-cased and unknown ones dropped; the lexicon is
    rejected (None) unless all three categories are present.
    """
    name = name or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    fmt = fmt or next((f for f in ("csv", "jsonl", "parquet") if path.endswith(f)), "json")
    if fmt == "csv":
        raw = spark.read.option("header", True).schema("term STRING, sentiment STRING").csv(path)
        lines = raw.select(F.lower(F.trim("sentiment")).alias("category"), F.col("term"),
                           F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                           F.monotonically_increasing_id().alias("_line")).filter(F.col("category").isin(*CATEGORIES))
        lex = numbered(lines, "category", "_file", "_block", "_line")
    elif fmt in ("jsonl", "parquet"):
        lex = spark.read.schema(LEXICON_SCHEMA).format("json" if fmt == "jsonl" else fmt).load(path) \
            .filter(F.col("category").isin(*CATEGORIES))
    else:
        raw = spark.read.option("multiLine", True).json(path)
        cats = [c for c in CATEGORIES if c in raw.columns]
        lex = raw.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("terms"))
                                             for c in cats])).alias("x")) \
            .select("x.category", F.posexplode("x.terms").alias("ord", "term"))
    lex = lex.select(F.lit(name).alias("name"), "category", "term", F.col("ord").cast("int"))
    present = {r[0] for r in lex.select("category").distinct().collect()}  # at most 3 values
    return lex if set(CATEGORIES) <= present else None


def lexicon_bytes(lex: DataFrame) -> int:
    return lex.agg(F.sum(F.octet_length("term") + F.lit(64))).first()[0] or 0


def save_lexicon(lex: DataFrame, path: str, fmt: str = "json") -> None:
    """``csv`` (``term,sentiment``), ``jsonl`` or ``parquet`` (one row a term) as files in
    range order, or ``json``, one object ``{category: [terms]}``: one row, so refused beyond
    ``LEXICON_BYTES``.
    """
    if fmt == "json":
        size = lexicon_bytes(lex)
        if size > LEXICON_BYTES:
            raise ValueError(f"the lexicon takes {size} bytes; one JSON object holds at most {LEXICON_BYTES}, use jsonl or parquet")
        lex.groupBy().pivot("category", list(CATEGORIES)).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"])) \
            .write.mode("overwrite").json(path)
        return
    ranged = lex.repartitionByRange("category", "ord").sortWithinPartitions("category", "ord")
    if fmt == "csv":
        ranged.select("term", F.col("category").alias("sentiment")).write.mode("overwrite").option("header", True).csv(path)
    elif fmt in ("jsonl", "parquet"):
        ranged.write.mode("overwrite").format("json" if fmt == "jsonl" else fmt).save(path)
    else:
        raise ValueError(f"unknown lexicon format {fmt!r}")


def resolve_lexicon(lexicons: DataFrame, name: str | None, default: DataFrame) -> DataFrame:
    """The named lexicon, else the first loaded (lowest ``load_order``), else the default."""
    if name is not None:
        named = lexicons.filter(F.col("name") == name)
    else:
        first = lexicons.agg(F.min_by("name", "load_order").alias("n"))
        named = lexicons.join(first, lexicons.name == first.n, "left_semi")
    chosen = named.drop("load_order")
    has = chosen.limit(1).count() > 0
    return chosen if has else default


def extend_lexicon(lex: DataFrame, new_terms: DataFrame) -> DataFrame:
    """Add ``(category, term)`` rows not already present; unknown categories skipped."""
    known = lex.select("category").distinct()
    cand = new_terms.join(known, "category", "left_semi") \
        .join(lex.select("category", "term"), ["category", "term"], "left_anti").dropDuplicates(["category", "term"])
    base = lex.groupBy("category").agg(F.max("ord").alias("m"), F.first("name").alias("name"))  # one row a category
    added = numbered(cand, "category", "term").join(F.broadcast(base), "category").select(
        "name", "category", "term", (F.col("m") + 1 + F.col("ord")).cast("int").alias("ord"))
    return lex.unionByName(added)


def lexicon_counts(docs: DataFrame, text_col: str, lex: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """F10 with a lexicon table: ``<category>_terms_count`` per document.

    One Aho-Corasick pass per text with the non-overlapping ``str.count`` rule per
    term, built once per task; null text counts 0.  The dictionary has to fit in a
    worker, so it is measured first and one beyond ``LEXICON_BYTES`` is refused.
    """
    size = lexicon_bytes(lex)
    if size > LEXICON_BYTES:
        raise ValueError(f"the lexicon takes {size} bytes; a dictionary of at most {LEXICON_BYTES} fits in a worker")
    bc = docs.sparkSession.sparkContext.broadcast(
        [(r["category"], r["term"].lower()) for r in lex.select("category", "term").collect() if r["term"]])

    @F.pandas_udf("positive LONG, negative LONG, neutral LONG")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        auto = ahocorasick.Automaton()
        by_term: dict[str, list[str]] = {}
        for cat, term in bc.value:
            by_term.setdefault(term, []).append(cat)
        for term, cats in by_term.items():
            auto.add_word(term, (term, cats))
        auto.make_automaton()
        for texts in batches:
            out = {c: [] for c in CATEGORIES}
            for text in texts.fillna(""):
                last_end: dict[str, int] = {}
                counts = dict.fromkeys(CATEGORIES, 0)
                for end, (term, cats) in auto.iter(text) if by_term else ():
                    if end - len(term) + 1 > last_end.get(term, -1):
                        last_end[term] = end
                        for c in cats:
                            counts[c] += 1
                for c in CATEGORIES:
                    out[c].append(counts[c])
            yield pd.DataFrame(out)

    r = docs.select(*keep, count(F.col(text_col)).alias("_c"))
    return r.select(*keep, *[F.col(f"_c.{c}").alias(f"{c}_terms_count") for c in CATEGORIES])
