"""The operators on small tables: against brute force, and on the cases every operator must take."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from finlex.llm import (
    common,
    html_render,
    line_dedup,
    packing,
    pii_crf,
    robust_outliers,
    simhash_pigeonring,
    warc,
    wavelet,
    wordpiece_count,
    wu_manber,
)
from finlex.llm.queries import tokenizer_file

LONG = "palavra " * 40_000
ROWS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, LONG), (5, " \n\t "),
        (None, "one two three four five six seven eight nine ten eleven twelve"), (None, None),
        (6, "mail a@b.co or 10.0.0.1, +1 (555) 123-4567, 4111 1111 1111 1111"), (6, "mail a@b.co or 10.0.0.1, +1 (555) 123-4567, 4111 1111 1111 1111"),
        (7, "One  two three four five six seven eight nine ten eleven twelve"), (8, "é́ 日本語 \U0001f600")]


@pytest.fixture(scope="module")
def odd(docs_of):
    return docs_of([(k, t, None if k == 3 else "en", None if k == 5 else "s") for k, t in ROWS])


@pytest.fixture(scope="module")
def none(docs_of):
    return docs_of([])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(10, "five six seven eight nine ten eleven twelve thirteen"), (11, "Mail, a"), (12, None), (13, ""), (None, "or 10"),
                                  (14, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- WARC

PAGES = [(1, "u", "aaa"), (2, "u", "aaa"), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "u", "bbb"), (0, "u", "bbb"),
         (7, "u", "x" * 3000), (None, "u", "aaa"), (None, "u", "lone"), (8, "u", "dup"), (8, "u", "dup")]


@pytest.mark.parametrize("chunk,least", [(1 << 20, 0), (7, 0), (16, 3)])
def test_warc_round_trip(spark, chunk, least):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")
    got = Counter(map(tuple, warc.report(pages, chunk, least).collect()))
    want = Counter()
    for k, _, h in PAGES:
        data = (h or "").encode()
        first = min((q for q, _, g in PAGES if (g or "") == (h or "") and q is not None), default=None)
        revisit = len(data) >= least and first is not None and k != first
        want[k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
             first if revisit else None] += 1
    assert got == want


def test_chunk_rows_carry_the_digest_so_far_and_add_up(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefgh" * 10), (2, "u", "")], "page_id long, url string, html string")
    common.prepare(spark)
    got = warc.read(warc.write(warc.chunks(warc.decided(pages), 9)), 9).orderBy("page_id", "chunk_no").collect()
    one = [r for r in got if r.page_id == 1]
    assert b"".join(bytes(r.data) for r in one) == b"abcdefgh" * 10 and [r.last for r in one] == [False] * 8 + [True]
    for r in one:
        part = (b"abcdefgh" * 10)[:r.payload_bytes]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(part).digest()).decode()
    assert warc.report(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- PII

def test_pii_report_on_odd_rows(odd, none):
    got = {(r.doc_id, r.n_email): r for r in pii_crf.report(odd).collect()}
    r = got[6, 1]
    assert (r.n_ip, r.n_card, r.n_phone) == (1, 1, 1)
    base = pii_crf.written(pii_crf.base_spans(ROWS[7][1]))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r.spans.split(","))
    assert got[2, 0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2, 0].spans == ""
    assert pii_crf.report(odd).count() == len(ROWS) and pii_crf.report(none).count() == 0


def test_redaction_keeps_all_but_the_spans(odd, none):
    out = pii_crf.redact(odd)
    assert out.columns == odd.columns and pii_crf.redact(none).count() == 0
    got = {r.doc_id: r for r in out.collect()}
    assert got[6].text == "mail [EMAIL] or [IP], [PHONE], [CARD]" and got[6].n_chars == len(got[6].text)
    assert got[1].text == ROWS[0][1] and got[2].text is None and got[4].text == LONG


# ---------------------------------------------------------------- token ids

def test_token_ids_round_trip(spark, docs_of, sample_texts, odd, none):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = docs_of([(5 * k % 211, x) for k, x in enumerate(sample_texts)])
    start, want = 0, []
    for k, x in sorted((5 * k % 211, x) for k, x in enumerate(sample_texts)):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = wavelet.write(docs, tokenizer_file("word_bpe_49k.json"), shard_tokens=5000)
    assert manifest.count() > 3
    assert rows(wavelet.read(manifest)) == sorted(want, key=repr)
    got = wavelet.report(odd, tokenizer_file("word_bpe_49k.json")).collect()
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got) and len(got) == len(ROWS)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 5)} == {1}
    assert wavelet.report(none, tokenizer_file("word_bpe_49k.json")).count() == 0


# ---------------------------------------------------------------- packing

def test_packing_places_every_token_once_and_without_conflict(docs_of, sample_texts, odd, none):
    docs = docs_of([(k, x, "en", f"s{k % 3}") for k, x in enumerate(sample_texts + sample_texts[:40])])
    out = packing.report(docs, capacity=300, group_bins=4).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    n = {k: len(x.encode().split()) + 1 for k, x in enumerate(sample_texts + sample_texts[:40])}
    mark = {k: " ".join(x.lower().split()) for k, x in enumerate(sample_texts + sample_texts[:40])}
    pieces, bins = Counter(), {}
    for r in out:
        pieces[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert pieces == n
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= 300
        for what in (source, mark):
            assert len({what[r.doc_id] for r in members}) == len({r.doc_id for r in members})
    assert packing.report(none).count() == 0
    assert sum(r.n_tokens for r in packing.report(odd).collect()) == sum(len((t or "").encode().split()) + 1 for _, t in ROWS)


def test_near_copies_never_share_a_bin_and_lengths_are_tokens(docs_of):
    vocabulary = wordpiece_count.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 999)}" for _ in range(400)]
    bits = lambda a, b: (simhash_pigeonring.fingerprint(a.encode()) ^ simhash_pigeonring.fingerprint(b.encode())).bit_count()
    near = next(x for k in range(400) if bits(x := " ".join([*words[:k], "other", *words[k + 1:]]), " ".join(words)) <= 2)
    docs = [(1, " ".join(words), "en", "a"), (2, near, "en", "b"), (3, "日本語の文" * 20, "ja", "c")]
    by_words = packing.report(docs_of(docs)).collect()
    assert {r.doc_id: r.n_tokens for r in by_words} == {1: 401, 2: 401, 3: 2}
    bin_of = {r.doc_id: r.bin_id for r in by_words}
    assert bin_of[1] != bin_of[2]
    automaton = wordpiece_count.Automaton(vocabulary)
    n = Counter()
    for r in packing.report(docs_of(docs), pieces=vocabulary).collect():
        n[r.doc_id] += r.n_tokens
    assert n == {k: 1 + sum(automaton.count(wordpiece_count.START + w) for w in t.encode().split()) for k, t, *_ in docs}
    assert n[3] > 50


# ---------------------------------------------------------------- quality

def test_outliers_of_a_group_go_and_its_bulk_stays(docs_of):
    rng = random.Random(7)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 80)))
    docs = [(k, clean(), "en", "a" if k % 2 else "b") for k in range(600)]
    docs += [(600 + k, clean().replace(" ", "### "), "en", "a") for k in range(30)]
    docs += [(700, "too short", "en", "a"), (701, "same five words every time " * 9, "en", "b")]
    got = {r.doc_id: r for r in robust_outliers.report(docs_of(docs)).collect()}
    assert all(got[k].kept for k in range(600)) and not any(got[k].kept for k in range(600, 630))
    assert got[700].base_failed and got[701].base_failed and not got[701].kept


def test_estimate_matches_direct_concentration(spark):
    """The distributed steps against the same steps in numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [.3, .2, .4, .3, .2] + [1.5, .2, .3, .1, .1]
    x[:40] += 4
    names = list(robust_outliers.FLOOR)
    df = spark.createDataFrame([(0, *map(float, v)) for v in x], "g int, " + ", ".join(f"{n} double" for n in names))
    got = robust_outliers.fit(df, ["g"], names).first()
    grid = robust_outliers.START_GRID
    cells = np.floor(np.abs(x) * grid + .5) * np.sign(x)  # rounds half up in size, as Spark does
    lower = lambda v: np.sort(v)[(len(v) + 1) // 2 - 1]
    m = np.array([lower(c) for c in cells.T])
    sd = np.maximum(np.array([lower(np.abs(c - a)) for c, a in zip(cells.T, m)]) * 1.4826 / grid, list(robust_outliers.FLOOR.values()))
    mean, inverse = m / grid, np.diag(1 / sd ** 2)
    for _ in range(robust_outliers.STEPS):
        d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        bins = np.floor(robust_outliers.GRID * np.log2(np.maximum(d, 2.0 ** -20)))
        near = x[bins <= np.sort(bins)[int(np.ceil(robust_outliers.SUPPORT * len(x))) - 1]]
        mean = near.mean(axis=0)
        cov = robust_outliers.CONSISTENCY * np.cov(near.T, bias=True)
        s = np.sqrt(np.diag(cov))
        corr = 0.95 * cov / np.outer(s, s)
        np.fill_diagonal(corr, 1)
        s = np.maximum(s, list(robust_outliers.FLOOR.values()))
        inverse = np.linalg.inv(corr * np.outer(s, s))
    assert got.n == 400 and np.allclose(got["mean"], mean) and np.allclose(got["inverse"], inverse[np.triu_indices(5)])


def test_quality_on_odd_rows(odd, none):
    got = robust_outliers.report(odd).collect()
    assert len(got) == len(ROWS) and not any(r.kept for r in got if r.doc_id in (2, 3, 5))
    kept = robust_outliers.keep(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IS NULL").count() == 1 and kept.filter("doc_id IN (2, 3, 5)").count() == 0
    assert robust_outliers.report(none).count() == 0 and robust_outliers.keep(none).count() == 0


# ---------------------------------------------------------------- HTML

def test_rendered_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x"), (1, "<p>a<p>b", "x"), (2, None, "x"), (None, "", "x")], "page_id long, html string, text string")
    assert [(r.n_lines, r.n_chars, r.text) for r in html_render.report(pages).orderBy(F.col("page_id").desc_nulls_last()).collect()] == [
        (0, 0, ""), (3, 4, "a\n\nb"), (3, 4, "a\n\nb"), (0, 0, "")]
    assert html_render.report(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- SimHash

def components_by_hand(fps, bits):
    ids = sorted(fps)
    label = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= bits and label[b] != label[a]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("bucket", [256, 2])
def test_near_duplicates_match_brute_force(docs_of, sample_texts, bucket):
    rng = random.Random(8)
    texts = list(sample_texts[:70])
    for t in sample_texts[:12]:
        w = t.split()
        for _ in range(4):
            v = list(w)
            if v:
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += ["", "  ", "A", "a"]
    docs = docs_of([(1000 - k, t) for k, t in enumerate(texts)])
    fps = {1000 - k: simhash_pigeonring.fingerprint(t.encode()) for k, t in enumerate(texts)}
    want = components_by_hand(fps, 2)
    assert len(set(want.values())) < len(set(fps.values()))
    got = simhash_pigeonring.near_duplicates(docs, bucket_rows=bucket).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


def test_chains_and_stars_contract_to_their_least_node(spark):
    rng = random.Random(9)
    chain = [(k + 1, k) for k in range(100, 140)]
    star = [(k, 7) for k in range(200, 260)]
    joined = [(250, 300), (301, 300)]
    edges = [(max(e), min(e)) for e in chain + star + joined]
    rng.shuffle(edges)
    got = dict(map(tuple, simhash_pigeonring.components(common.materialize(spark.createDataFrame(edges, "a long, b long"), "t")).collect()))
    assert got == {**{k: 100 for k in range(101, 141)}, **{k: 7 for k in range(200, 260)}, 300: 7, 301: 7}


def test_near_duplicates_on_odd_rows(odd, none, docs_of):
    got = simhash_pigeonring.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == "0" * 16 == by[3].fingerprint and by[2].component_id == by[5].component_id == 2
    assert Counter(r.component_id for r in got if r.doc_id is None) == {1: 1, 2: 1}
    kept = simhash_pigeonring.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 8]
    lone = docs_of([(None, "nobody else has this text"), (9, "something quite different here")])
    assert simhash_pigeonring.keep_one(lone).count() == 2
    assert simhash_pigeonring.near_duplicates(none).count() == 0 and simhash_pigeonring.keep_one(none).count() == 0


# ---------------------------------------------------------------- decontamination

@pytest.mark.parametrize("block", [1 << 24, 20])
def test_contamination_matches_brute_force(odd, none, benchmark, block):
    items = [tuple(r) for r in benchmark.collect()]
    want = Counter()
    for k, t in ROWS[:3] + ROWS[4:]:
        n, hit, found, digest, bad = wu_manber.brute_force(t, items)
        ids = {i for i, _ in items if i is not None and wu_manber.brute_force(t, [(i, dict(items)[i])])[4]}
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        want[k, n, hit, len(ids), digest, bad] += 1
    got = wu_manber.report(odd, benchmark, block_bytes=block)
    assert Counter(map(tuple, got.filter("doc_id IS NULL OR doc_id <> 4").collect())) == want
    clean = wu_manber.decontaminate(odd, benchmark, block_bytes=block)
    assert clean.columns == odd.columns and clean.count() == len(ROWS) - sum(want[w] for w in want if w[5])
    assert wu_manber.report(none, benchmark).count() == 0
    assert wu_manber.report(odd, benchmark.limit(0)).filter("contaminated").count() == 0


# ---------------------------------------------------------------- word pieces

def test_counts_per_document(odd, none):
    pieces = wordpiece_count.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    known = set(pieces)
    want = Counter((k, len((t or "").encode().split()), sum(wordpiece_count.brute_force(wordpiece_count.START + w, known)
                                                             for w in (t or "").encode().split())) for k, t in ROWS)
    assert Counter(map(tuple, wordpiece_count.counted(odd, pieces).collect())) == want
    assert wordpiece_count.counted(none, pieces).count() == 0


# ---------------------------------------------------------------- lines

def units_by_hand(t, line_words, passage_words, window):
    """(start, end, words) of lines and passages."""
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t[a:b]) for a, b in at]
    after = [k + 1 == len(w) or "\n" in t[at[k][1]:at[k + 1][0]] for k in range(len(w))]
    rank = [hashlib.md5(x.encode()).hexdigest()[:16] for x in w]
    size, found = passage_words - window + 1, set()
    for k in range(len(w)):
        if k == 0 or after[k - 1]:
            end = next(j for j in range(k, len(w)) if after[j])
            if end - k + 1 >= line_words:
                found.add((k, end))
        if k + window <= len(w):
            begin = min(range(k, k + window), key=lambda j: (rank[j], j))
            if begin + size <= len(w):
                found.add((begin, begin + size - 1))
    return [(at[a][0], at[b][1], " ".join(w[a:b + 1])) for a, b in sorted(found)]


def removed_by_hand(docs, *sizes):
    first, out = {}, []
    for k, t in sorted(docs, key=lambda d: d[0]):
        for a, b, unit in units_by_hand(t, *sizes):
            i, s, e = first.setdefault(unit, (k, a, b))
            if i != k or a >= e:
                out.append((k, a, b, i, s))
    return sorted(out)


def test_repeated_units_match_brute_force(docs_of, sample_texts, odd, none):
    rng = random.Random(11)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "mu", "nu", "xi", "rho"]) + str(rng.randint(0, 99)) for _ in range(60))
    host = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))
    docs = [(300 - k, t) for k, t in enumerate([*sample_texts, "É x\nA  b c\na B\tc\nshort", "a b c\ny", f"{host()} {passage} {host()}",
                                               f"{host()}\n{passage}", host()])]
    for sizes in ((3, 8, 4), (5, 50, 15)):
        found = line_dedup.report(docs_of(docs), **dict(zip(("line_words", "passage_words", "window"), sizes)))
        assert sorted(map(tuple, found.collect())) == removed_by_hand(docs, *sizes)
    gone = removed_by_hand(docs, 5, 50, 15)
    inline, alone = (300 - len(sample_texts) - k for k in (2, 3))
    assert {g[0] for g in gone} >= {inline} and all(g[3] == alone for g in gone if g[0] == inline)
    out = {r.doc_id: r.text for r in line_dedup.cleaned(docs_of(docs)).collect()}
    for k, t in docs:
        hit = {i for _, a, b, *_ in (g for g in gone if g[0] == k) for i in range(a, b)}
        left = "".join(c for i, c in enumerate(t) if i not in hit)
        assert out[k].split() == left.split() and (hit or out[k] == t)
    assert line_dedup.report(none).count() == 0
    assert {(r.doc_id, r.kept_doc_id) for r in line_dedup.report(odd).collect()} >= {(7, 1), (None, 1)}
    assert line_dedup.cleaned(odd).columns == odd.columns and line_dedup.cleaned(odd).count() == len(ROWS)


def test_paragraph_units():
    t = "a b c\nd e f\n\n g h i j\n \nk"
    found = {t[a:b] for a, b, _ in line_dedup.units(t, "paragraph", 3)}
    assert {"a b c\nd e f", "g h i j"} <= found


def test_every_shared_passage_holds_a_common_unit():
    rng = random.Random(17)
    text = lambda n, many: " ".join(f"w{rng.randint(0, many)}" for _ in range(n))
    for many in (30, 10**6):  # frequent words tie
        for _ in range(500):
            n = rng.choice([50, 51, 60, 100])
            passage, a, b = text(n, many), text(rng.randint(0, 80), 10**6), text(rng.randint(0, 80), 10**6)
            one, two = f"{a} {passage} {b}", f"{passage} {a}"
            known = {d for _, _, d in line_dedup.units(one)}
            shared = [(s, e) for s, e, d in line_dedup.units(two) if d in known and e <= len(passage)]
            before = len(passage[:min(s for s, _ in shared)].split())
            behind = len(passage[max(e for _, e in shared):].split())
            assert before <= 14 and behind <= 14


def test_short_lines_go_and_a_text_that_repeats_itself_keeps_one_copy(docs_of):
    docs = [(1, "read more about our offers\nfirst own words of this text"), (2, "other words\nRead more  about our offers\nshort line"),
            (3, "short line"), (4, "again " * 200)]
    out = {r.doc_id: r.text for r in line_dedup.cleaned(docs_of(docs)).collect()}
    assert out[1] == docs[0][1] and out[2] == "other words\nshort line" and out[3] == "short line"
    assert len(out[4].split()) == 36


def test_columns_named_like_the_work_columns_pass(docs_of, spark, benchmark):
    docs = docs_of([(1, "read more about our offers\nfirst own words of this text"), (2, "read more about our offers\nsecond"),
                    (2, "read more about our offers\nsecond"), (None, None)])
    names = ["__gone", "__mark", "__of", "__doc", "__fp", "__nth", "__keep", "__n_words", "__spans", "__items", "__c0", "n", "fp", "start"]
    wide = docs.withColumns({name: F.lit("mine") for name in names})
    for out in (line_dedup.cleaned(wide), simhash_pigeonring.keep_one(wide), wu_manber.decontaminate(wide, benchmark)):
        assert out.columns == wide.columns
        got = out.collect()
        assert {r[name] for r in got for name in names} == {"mine"} and {r.doc_id for r in got} >= {1, 2}


# ---------------------------------------------------------------- joins on hot keys

def test_join_with_hot_keys_loses_and_doubles_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_FLOOR", 10)
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    look = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).filter("k <> 7")
    got = common.join_lookup(df, look, "k", "n", 3000)
    want = df.join(look, "k")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
