"""Steps rewritten to scale: exact against plain counts by hand, and what they no longer do."""
import random
from collections import Counter

from pyspark.sql import functions as F

from finlex.functions import entities as EN
from finlex.functions import features as FE
from finlex.functions import grams as GR
from finlex.functions import scan as SC
from finlex.functions import text as TX
from finlex.operators import vocab as VO

# a term that overlaps itself, one in two dictionaries, one twice in a list, one inside another
DICTS = {"a": ["aba", "não", "não"], "b": ["não", "ab", "é 𝒳"], "c": ["zz"]}
TEXTS = ["ababa aba", "não é 𝒳 ab nãonão", "", None, "zzz zz", "q", "ab não\tzz"]


def test_scan_counts_like_python(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "k INT, t STRING").coalesce(1)
    for chars in (4_000_000, 5):  # texts in one piece and in many
        monkeypatch.setattr(SC, "PIECE_CHARS", chars)
        for r in SC.term_scan(docs, "t", DICTS).collect():
            t = r.t or ""
            for n, terms in DICTS.items():
                assert r._scan[f"{n}_count"] == sum(t.count(x) for x in terms)
                assert r._scan[f"{n}_first"] == min([t.find(x) for x in terms if x in t], default=-1)
                assert r._scan[f"{n}_distinct"] == len({x for x in terms if x in t})
            assert r._scan.n_words == len(t.split())


def test_scans_of_a_row_share_a_worker(spark):
    docs = spark.createDataFrame([("x", "y")], "t STRING, u STRING")
    two = SC.term_scan(SC.term_scan(docs, "t", DICTS, "_t"), "u", DICTS, "_u")
    assert two._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_lexicon_by_scan_equals_the_expressions(spark):
    lex = {"p": ["lucro", "em linha"], "n": ["risco"]}
    docs = spark.createDataFrame([(1, "lucro e risco em linha"), (2, ""), (3, "lucrolucro x")], "doc_id INT, t STRING")
    want = docs.select("doc_id", *[c.alias(k) for k, c in FE.lexicon_features("t", lex).items()])
    got = FE.with_lexicon_features(docs, "t", lex)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan and "split(" not in plan


def test_currency_and_negation_equal_the_whole_patterns(spark):
    rows = ["R$ 10 mil e 5 mil REAIS", "r$5 $6 us$ 7", "dez reais, 3 reais", "não é bom nem ruim", "", "sem", "12 Reais R$ 3 reais", None]
    t = F.col("t")
    negations = sum((FE.regexp_count(t, FE.negation_pattern(x)) for x in FE.T.NEGATION_TERMS), F.lit(0))
    docs = spark.createDataFrame([(x,) for x in rows], "t STRING").select(
        FE.currency_count(t).alias("c"), FE.regexp_count(t, FE.CURRENCY_RE).alias("w"),
        FE.negation_patterns("t")["negation_patterns_count"].alias("n"), negations.alias("m"))
    for r in docs.collect():
        assert r.c == r.w and r.n == r.m


def test_entity_types_and_counts(spark):
    docs = spark.createDataFrame([("empresa pagou R$ 10,5 mil, US$3 e € 7 em 01/02/2024, 12% ou 3,5 % de 40",)], "text STRING")
    e = docs.select(TX.words(TX.normalize("text")).alias("w"), "text").select("w", EN.entities("text", "w").alias("e"))
    assert Counter(x.ent_type for x in e.first().e) == {"MONEY": 3, "DATE": 1, "PERCENT": 2, "CARDINAL": 1, "ORG": 1}
    out = e.select(*[c.alias(k) for k, c in FE.entity_counts("e", "w").items()])
    r = out.first()
    assert (r.entity_ORG_count, r.entity_MONEY_count, r.entity_PERCENT_count, r.entity_CARDINAL_count, r.entity_DATE_count) == (1, 3, 2, 1, 1)
    assert r.total_entities == 8 and abs(r.financial_entity_density - 6 / e.select(F.size("w")).first()[0]) < 1e-12
    assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


def _plain(texts, cfg):
    tf, df = Counter(), Counter()
    for t in texts:
        g = GR.text_grams(t, cfg.ngram_min, cfg.ngram_max, cfg.min_token_chars)
        tf.update(g)
        df.update(set(g))
    top = sorted((t for t in tf if df[t] >= cfg.min_df), key=lambda t: (-tf[t], t))[:cfg.max_features]
    return {t: (i, df[t], tf[t]) for i, t in enumerate(sorted(top))}


def test_vocabulary_counts_only_ngrams_that_can_be_in_it(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "é", "éé", *[f"w{i}" for i in range(300)]][: rng.choice([5, 305])]) for _ in range(40)) for _ in range(120)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, "", "aa"]], "t STRING").repartition(3)
    handed, counts = [], GR.gram_counts
    monkeypatch.setattr(GR, "gram_counts", lambda *a: handed.append(a[5]) or counts(*a))
    for cfg in (VO.VocabConfig(1, 2, 2, 8), VO.VocabConfig(1, 3, 3, 12), VO.VocabConfig(1, 3, 1, 10_000), VO.VocabConfig(2, 2, 2, 20), VO.VocabConfig(1, 1, 2, 5)):
        want = _plain([*texts, None, "", "aa"], cfg)
        for pieces, held, most in ((8_000_000, 200_000, 200_000), (300, 3, 200_000), (300, 3, 2)):
            monkeypatch.setattr(GR, "PIECE_BYTES", pieces)
            monkeypatch.setattr(GR, "TERMS_HELD", held)
            monkeypatch.setattr(VO, "WORDS_HELD", most)
            handed.clear()
            assert {r.term: (r.idx, r.df, r.tf) for r in VO.fit_vocabulary(docs, "t", cfg).collect()} == want
            if cfg.max_features == 8 and most > 2:
                assert handed[0] is None and len(handed[1]) <= 12  # of over 300 words


def test_sparse_vectors_are_the_counts(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, ""), (3, "cc bb")], "doc_id BIGINT, t STRING")
    cfg = VO.VocabConfig(1, 2, 1, 50)
    vocab = VO.fit_vocabulary(docs, "t", cfg)
    vec = VO.vectorize(docs, "t", vocab, cfg)
    out = VO.sparse_vectors(vec)
    at = {r.term: r.idx for r in vocab.collect()}
    got = {r.doc_id: dict(zip(map(int, r.text_vector.indices), r.text_vector.values)) for r in out.collect()}
    assert got == {i: {at[g]: n for g, n in Counter(GR.text_grams(t, 1, 2, 2)).items()} for i, t in docs.collect()}
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()
