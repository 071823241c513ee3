"""Fill-in-middle, alignment and sharding: against brute force, and on the cases every operator must take."""
import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from finlex.llm import alignment, piece_table, shards

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "palavra é longa, " * 40_000
ODD = ["", "  a  b", " \n x\n  y \t z ", "foo \n bar  baz", "▁ a", "a▁b", "日本語 テキスト　 です", "<|endoftext|> <s> </s> <0x41>",
       "\x1c a !\x1c!  \x85 b", "tail ", "tail  \n", "\n\n a\n\n\nb", "é́ \U0001f600x", "don't we'll  'tis", " ", "a <P> b", "a<S", "<M>", "<P", "x"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def mixed(sample_texts):
    rows = [(k, t) for k, t in enumerate(ODD + sample_texts[:150])] + [(1000, None), (None, "no id here"), (None, None), (1001, LONG),
                                                                       (3, "foo \n bar  baz"), (3, "foo \n bar  baz"), (3, "other text, same id")]
    random.Random(4).shuffle(rows)
    return rows


# ---------------------------------------------------------------- piece table

def fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def test_fim_report_equals_slicing(docs_of, mixed):
    rows = mixed + [(5000 + i, "é<x") for i in range(300)]
    want = Counter()
    for k, t in rows:
        n, form, p, m, out = fim(k, t)
        want[k, n, form, p, m, sha(out), sha(t or "")] += 1
    assert Counter(map(tuple, piece_table.report(docs_of(rows)).collect())) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert piece_table.report(docs_of([])).count() == 0


def test_fim_outputs_restore_and_keep_other_columns(docs_of, mixed):
    docs = docs_of(mixed).withColumn("N", F.lit("clash")).withColumn("output", F.lit(7))
    out = piece_table.transform(docs)
    assert {"lang", "source", "fingerprint", "text", "output"} <= set(out.columns)
    got = out.collect()
    assert Counter((r.doc_id, r.output) for r in got) == Counter((k, fim(k, t)[4]) for k, t in mixed)
    for r in got:
        data, marks = (r.text or "").encode(), b"<P><S><M>"
        assert b"".join((marks if p.buffer else data)[p.start:p.start + p.length] for p in r.pieces).decode() == r.output
    back = piece_table.restore(out.drop("text"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((k, t or "") for k, t in mixed)


def test_pieces_cut_at_edges_and_beyond():
    t = piece_table.PieceTable(b"abc")
    t.cut(0)
    t.cut(3)
    assert [p.length for p in t.pieces] == [0, 3, 0] and t.text() == b"abc"
    with pytest.raises(IndexError):
        t.cut(4)
    with pytest.raises(ValueError):
        piece_table.restored(b"no sentinel", "psm")


# ---------------------------------------------------------------- alignment

class Plain:
    """Whole-text encoding and alignment by sets of ends."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
        # the bytes behind byte-level characters, in the order of the vocabulary's definition
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        ea = self.a.encode(" " + text, add_special_tokens=False)
        a = [(k, bytes(self.byte[c] for c in self.a.id_to_token(k))) for k in ea.ids]
        b = [(k, bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode())
             for k in self.b.encode(text) for p in [self.b.id_to_piece(k)]]
        want = (" " + text).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return [], []
        return a, b

    def align(self, text):
        a, b = self.tokens(text)

        def stops(tokens):
            at, out = 0, {}
            for i, (_, x) in enumerate(tokens):
                at += len(x)
                out[at] = i
            return out
        ea, eb = stops(a), stops(b)
        both = sorted(set(ea) & set(eb))
        links = [(a[ea[e]][0], b[eb[e]][0]) for e in both]
        groups, i, j = [], 0, 0
        for e in both:
            groups.append(",".join(str(k) for k, _ in a[i:ea[e] + 1]) + "|" + ",".join(str(k) for k, _ in b[j:eb[e] + 1]))
            i, j = ea[e] + 1, eb[e] + 1
        return len(a), len(b), len(both), links, ";".join(groups)


@pytest.mark.parametrize("share", [alignment.HOT_SHARE, 20])
def test_alignment_equals_whole_text_encoding(docs_of, mixed, share, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_SHARE", share)  # 20: most pairs take the shuffle join
    plain = Plain()
    found = [(k, plain.align(t)) for k, t in mixed]
    counts = Counter(x for _, f in found for x in f[3])
    top: dict = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    want = Counter((k, na, nb, ng, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha(g) if na else "")
                   for k, (na, nb, ng, links, g) in found)
    got = alignment.report(docs_of(mixed), A_FILE, B_FILE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert any(not f[0] and t for (_, t), (_, f) in zip(mixed, found))  # a text whose bytes do not come back


def test_alignment_rows_carry_groups_and_links(docs_of):
    r = alignment.align(docs_of([(1, "hello worlds"), (2, None)]), A_FILE, B_FILE).orderBy("doc_id").collect()
    assert r[0].groups_sha256 == sha(r[0].groups) and len(r[0].link_a) == len(r[0].link_b) == r[0].n_links == r[0].n_groups
    assert (r[1].n_a, r[1].n_b, r[1].groups, r[1].groups_sha256, r[1].link_a) == (0, 0, "", "", [])
    none = docs_of([])
    assert alignment.report(none, A_FILE, B_FILE).count() == 0


# ---------------------------------------------------------------- shards

def check_places(rows, docs, n_shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in docs)
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < n_shards and r.grown_shard in (r.shard, n_shards) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len({r.shard for r in rows if r.doc_id == k}) == 1 for k in {k for k, _ in docs})


def test_shards_hold_every_row_once(docs_of, mixed):
    rows = shards.report(docs_of(mixed)).collect()
    check_places(rows, mixed)
    again = shards.report(docs_of(sorted(mixed, key=repr)).repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))  # neither order nor partitions matter
    assert shards.report(docs_of([])).count() == 0


def test_buckets_fit_their_size_with_a_hot_key_and_equal_rows(spark, docs_of):
    docs = ([(k, "word %d " % k * 20) for k in range(1500)] + [(7, "hot key %d " % k * 20) for k in range(800)] + [(8, "equal row " * 20)] * 800)
    df = docs_of(docs).repartition(6)
    written = shards.write(df, bucket_bytes=20_000)
    sizes = {r.bucket: r["size"] for r in written.groupBy("bucket").agg(F.sum(shards.size_of(F.col("text"))).alias("size")).collect()}
    assert len(sizes) > 20 and max(sizes.values()) < 3 * 20_000
    at = shards.places(written).select("doc_id", "shard", "slot", shards.size_of(F.col("text")).alias("size"),
                                       F.crc32("text").alias("text_crc32"), F.lit("key").alias("law"),
                                       shards.shard_of(F.col("doc_id"), 9, shards.SEED).alias("grown_shard"))
    check_places(at.collect(), docs)
    assert {"lang", "source", "fingerprint"} <= set(written.columns)


def test_shards_grow_and_are_even(spark):
    keys = spark.range(40_000).select(*[shards.shard_of(F.col("id"), n, 1).alias(f"s{n}") for n in (1, 8, 9, 10)])
    got = keys.groupBy("s8").count().collect()
    assert len(got) == 8 and all(abs(r["count"] - 5000) < 400 for r in got)
    assert keys.filter("s1 <> 0 or (s9 <> s8 and s9 <> 8) or (s10 <> s9 and s10 <> 9)").count() == 0
    assert abs(keys.filter("s9 = 8").count() - 40_000 / 9) < 400


def test_fisher_yates_gives_every_order():
    import numpy as np
    seen = Counter(tuple(shards.fisher_yates(3, np.random.default_rng(s))) for s in range(3000))
    assert len(seen) == 6 and all(abs(n - 500) < 120 for n in seen.values())
    assert shards.fisher_yates(0, np.random.default_rng(1)) == [] and shards.fisher_yates(1, np.random.default_rng(1)) == [0]


def test_shuffle_mixes_neighbours(spark, docs_of):
    rows = shards.report(docs_of([(k, f"t{k}") for k in range(2000)])).collect()
    other = shards.report(docs_of([(k, f"t{k}") for k in range(2000)]), seed=2).collect()
    slot = {r.doc_id: (r.shard, r.slot) for r in rows}
    assert slot != {r.doc_id: (r.shard, r.slot) for r in other}
    order = [k for k, _ in sorted(slot.items(), key=lambda x: x[1])]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 40
