"""The per-text parts of the operators against brute force."""
import collections
import io
import json
import random
import time
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash

from finlex.llm import html_render, packing, pii_crf, robust_outliers, simhash_pigeonring, wavelet, wordpiece_count, wu_manber

WORD = r"[^\x20\x09-\x0D]+"


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---------------------------------------------------------------- PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_pattern(t):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns(sample_texts):
    rng = random.Random(1)
    made = ["".join(rng.choice("a1.@-+ ()_%2é\n9") for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    made += ["".join(rng.choice("0123456789.+-() @a") for _ in range(rng.randint(0, 60))) for _ in range(8000)]
    for t in [*made, *sample_texts, "4111 1111 1111 1111 x@y.z _q@r.s", "1.2.3.4.5.6.7.8 256.1.1.1"]:
        assert pii_crf.base_spans(t) == base_by_pattern(t)


def test_base_spans_take_linear_time_on_long_runs():
    for t in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "(1" * 100_000 + "x", "+1" * 100_000, "a.b" * 100_000 + "@"):
        pii_crf.tokens(t)


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary, chain = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    ends = np.array([[0, 1], [1, 2], [1, 3]])
    got = pii_crf.propagate(unary, ends, np.zeros(3, int), chain[None], rounds=200)
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(chain[y[i], y[j]] for i, j in ends))
        for i in range(4):
            want[i, y[i]] += w
    p = np.exp(got - got.max(axis=1, keepdims=True))
    assert np.allclose(p / p.sum(axis=1, keepdims=True), want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_skip_edges_carry_a_label_to_a_distant_repeat():
    pair = "mail +1 (555) 123-4567 " + "word " * 200 + "call 123-4567 now"
    other = "call 765-4321 now"
    docs = [pii_crf.tokens(t) for t in [pair] * 30 + [other] * 40 + ["x +1 (555) 888-1234 y " + "w " * 99 + "+1 555 888-1234."] * 60]
    counts = collections.Counter()
    for toks in docs:
        label = [max(t[2], 0) for t in toks]
        for t, y in zip(toks, label):
            counts["shape", f"{y}|{t[3]}"] += 1
        chain, skip = pii_crf.edges(toks)
        for i, j in chain:
            counts["chain", f"{label[i]}|{label[j]}"] += 1
        for i, j in skip:
            if label[i] and label[j]:
                counts["skip", f"{label[i]}|{label[j]}"] += 1
    field = pii_crf.fit([(*k, n) for k, n in counts.items()])
    toks = pii_crf.tokens(pair)
    base, every = pii_crf.spans_of(toks, field.label([toks])[0])
    a = pair.rindex("123-4567")
    assert len(base) == 1 and every == [*base, (a, a + 8, 3)]
    toks = pii_crf.tokens(other)
    assert pii_crf.spans_of(toks, field.label([toks])[0]) == ([], [])


def field_of(w):
    shapes = {"": np.log([0.9, 0.025, 0.025, 0.025, 0.025])}
    return pii_crf.Field({}, shapes, np.zeros((5, 5)), w * np.eye(5))


@pytest.mark.parametrize("repeats", [1, 3, 30, 1000])
@pytest.mark.parametrize("w", [4.0, 8.0])
def test_every_repeat_of_a_labelled_number_is_found(repeats, w):
    text = "call +1 (555) 123-4567 " + ("word " * 20 + "or 555-123-4567 ") * repeats
    toks = pii_crf.tokens(text)
    assert len(toks) == repeats + 1
    assert field_of(w).label([toks])[0] == [4] * (repeats + 1)
    assert field_of(w).label([toks[1:]])[0] == [0] * repeats


@pytest.mark.parametrize("text,found", [
    ("+1 555 123 4567 then 555 123 4567 x", ["555 123 4567"]), ("+1 555 123 4567 then (555) 123 4567.", ["(555) 123 4567"]),
    ("+1 555 123 4567 then 99 555 123 4567", ["555 123 4567"]), ("+1 555 123 4567 then 1 5551234567", ["1 5551234567"]),
    ("4111 1111 1111 1111 12", ["4111 1111 1111 1111"]), ("12 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("4111-1111-1111-1111-12", ["4111-1111-1111-1111", "4111-1111-1111-1111-12"]),
    ("+1 555 123 4567 4111 1111 1111 1111", ["+1 555 123 4567", "4111 1111 1111 1111"]),
    ("555 123 4567 555 987 6543", ["555 123 4567", "555 987 6543"]), ("1 2 3 4 5 6 7 8", []),
    ("123 456 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("in 2020 or 12 34 5", []), ("abc123 456 7890 12a", ["456 7890"]), ("7 1234567 7", ["1234567"]),
])
def test_candidates_of_spaced_digit_groups(text, found):
    assert sorted(text[a:b] for a, b, y, _, _ in pii_crf.tokens(text) if y < 0) == sorted(found)


def test_spaced_cards_are_found_by_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        sizes = [rng.choice([1, 2, 3, 4]) for _ in range(rng.randint(4, 9))]
        groups = ["".join(rng.choice("0123456789") for _ in range(n)) for n in sizes]
        text = " ".join(groups)
        spans = {(a, b) for a, b, _, _, _ in pii_crf.tokens(text)}
        for i in range(len(groups)):
            for j in range(i + 1, len(groups) + 1):
                d = "".join(groups[i:j])
                if 12 <= len(d) <= 19 and pii_crf.luhn(d) and sizes[j - 3:j] != [3, 3, 4]:  # found, or shares digits with one that is
                    a = len(" ".join(groups[:i])) + bool(i)
                    b = len(" ".join(groups[:j]))
                    assert any(x < b and a < y and 12 <= len(pii_crf.digits_of(text[x:y])) <= 19
                               and pii_crf.luhn(pii_crf.digits_of(text[x:y])) for x, y in spans)


def test_a_spaced_repeat_of_a_phone_number_is_found():
    text = "call +1 555 123 4567 " + ("word " * 20 + "or 555 123 4567 ") * 3
    toks = pii_crf.tokens(text)
    assert len(toks) == 4 and field_of(8.0).label([toks])[0] == [4] * 4


def test_skip_potentials_agree_with_enumeration():
    rng = np.random.default_rng(3)
    same = 0
    for _ in range(60):
        n = 5
        unary, chain = rng.normal(size=(n, 3)) * 2, rng.uniform(-1, 1, size=(3, 3))
        fixed, key, w = np.array([rng.integers(0, 3), 0, 0, 0, 0]), np.array([0, 1, 0, 1, 0]), 4.0
        ends = np.array([[0, 1], [3, 4]])
        got = pii_crf.settle(unary, fixed, ends, chain, key, w)
        want = np.zeros((n, 3))
        for y in np.ndindex(*[3] * n):
            if fixed[0] and y[0] != fixed[0]:
                continue
            e = sum(unary[i, y[i]] for i in range(n) if not fixed[i]) + sum(chain[y[i], y[j]] for i, j in ends)
            e += w * sum(key[i] == key[j] and y[i] == y[j] for j in range(n) for i in range(j))
            want[np.arange(n), y] += np.exp(e)
        sure = np.sort(want / want.sum(axis=1, keepdims=True), axis=1)[:, -1] > 0.7
        same += (got.argmax(axis=1) == want.argmax(axis=1))[sure].all()
    assert same == 60


# ---------------------------------------------------------------- statistics

def stats_by_hand(t):
    w, lines = re.findall(WORD, t), t.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if re.search(WORD, x):
            dup += x in seen
            seen.add(x)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics_match_their_definitions(sample_texts):
    rng = random.Random(2)
    made = ["".join(rng.choice("ab  \n#é 日") for _ in range(rng.randint(0, 120))) for _ in range(2000)]
    for t in [*made, *sample_texts, "", "\n\n"]:
        assert robust_outliers.statistics(t.encode())[:5] == stats_by_hand(t)


# ---------------------------------------------------------------- SimHash

def fingerprint_by_hand(t):
    w = re.findall(WORD, lower_az(t))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_their_definition(sample_texts):
    for t in [*sample_texts[:40], "", " \n", "A", "É b", "a b c", "a b c " * 40000]:
        assert simhash_pigeonring.fingerprint(t.encode()) == fingerprint_by_hand(t)


@pytest.mark.parametrize("bits,segments", [(2, 7), (2, 5), (3, 8), (0, 4)])
def test_some_chain_finds_every_pair_and_no_other(bits, segments):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(3)]
    fps = np.unique(np.array([*base, *near], np.uint64))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= bits}
    got = set()
    for start in range(segments):
        got |= set(zip(*(x.tolist() for x in simhash_pigeonring.chain_links(fps, start, segments, bits))))
    assert got == want


# ---------------------------------------------------------------- Wu-Manber

def test_search_finds_what_comparison_finds():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "C", "dé", "e1"])
    for _ in range(300):
        items = [(k, " ".join(word() for _ in range(rng.randint(0, 14)))) for k in range(rng.randint(0, 5))]
        text = ", ".join(word() for _ in range(rng.randint(0, 60)))
        words = wu_manber.words_of(text.encode())
        spans, found = wu_manber.Matcher([(k, t.encode()) for k, t in items], 4).hits(words)
        n, hit, n_items, _, bad = wu_manber.brute_force(text, items, 4)
        assert (len(words), sum(b - a for a, b in wu_manber.merged(spans)), len(found), bool(spans)) == (n, hit, n_items, bad)


# ---------------------------------------------------------------- token ids

@pytest.fixture(scope="module", params=[True, False], ids=["by_rank", "by_library"])
def encoder(request):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    assert wavelet.by_rank(source)
    return wavelet.Encoder(source, request.param)


def test_ranks_are_not_used_when_a_merge_is_out_of_order():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    for at in (0, 20_000, len(merges) - 2):
        changed = [*merges[:at], merges[at + 1], merges[at], *merges[at + 2:]]
        assert not wavelet.by_rank(json.dumps(spec | {"model": spec["model"] | {"merges": changed}}))
    assert not wavelet.by_rank(json.dumps(spec | {"normalizer": None}))


def test_words_of_any_signs_encode_as_by_the_library(encoder):
    rng = random.Random(7)
    signs = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz\xe4\xf6\xfc\xdf\xe9\xe8\xe7\xff\xb5\xaa\xd7\xf701239.,'<|>#&\x01\x7f-_"
    words = ["".join(rng.choices(signs, k=rng.randint(1, 14))) for _ in range(20_000)]
    want = encoder.tokenizer.encode_batch(words, add_special_tokens=False)
    for w, got, e in zip(words, encoder.encode([w.encode() for w in words]), want):
        assert np.frombuffer(got, encoder.dtype).tolist() == e.ids, w


def test_cached_words_encode_as_whole_texts(encoder, sample_texts):
    odd = ["a<|endoftext|>b c <|startoftext|>. X", "<|ENDOFTEXT|>. it's IT'S, don't. 've'", "é́ ÀÉ İstanbul. İ, ΑΣ, Straße! 123, 4a.5,,, ...",
           " x y  z \x1c a\x1fb", "", "\n\t ", "A.b,c d!e日本語, 日本。x", "ǅ ǆ ŉ.", "a ́b.,", "x" * 5000 + "."]
    texts = [*sample_texts, *odd]
    for t, got in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, encoder.dtype).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_a_small_cache_changes_nothing(encoder, sample_texts, monkeypatch):
    want = encoder.encode([t.encode() for t in sample_texts])
    monkeypatch.setattr(wavelet, "CACHE_WORDS", 50)
    assert [encoder.encode([t.encode()])[0] for t in sample_texts] == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000])
def test_shard_lookups_match_the_ids(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 3000, n).astype("<u2")
    ids[::7] = 3
    shard = wavelet.Shard(io.BytesIO(wavelet.dump([None, 5], [n // 2, n - n // 2], ids, 16)))
    assert (shard.decode() == ids).all()
    assert shard.documents()[0] == [None, 5] and shard.documents()[1].tolist() == [n // 2, n - n // 2]
    for i in range(0, n, max(1, n // 50)):
        assert shard.access(i) == ids[i]
    at = np.flatnonzero(ids == 3)
    assert shard.count(3) == len(at) and shard.count(3, n // 3, n // 2) == (ids[n // 3:n // 2] == 3).sum()
    assert shard.count(65_535) == 0 and shard.count(1 << 20) == 0
    assert [shard.select(3, k) for k in range(0, len(at), max(1, len(at) // 40))] == at[::max(1, len(at) // 40)].tolist()
    with pytest.raises(IndexError):
        shard.select(3, len(at))


# ---------------------------------------------------------------- word pieces

def test_automaton_counts_the_greedy_pieces(sample_texts):
    pieces = wordpiece_count.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    automaton, known = wordpiece_count.Automaton(pieces), set(pieces)
    words = {w for t in sample_texts for w in t.encode().split()} | {"日本語".encode(), b"\xff\xfe", "é́".encode(), b"a" * 3000}
    for w in words:
        assert automaton.count(wordpiece_count.START + w) == wordpiece_count.brute_force(wordpiece_count.START + w, known)


# ---------------------------------------------------------------- packing

def test_each_piece_goes_to_the_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(50):
        pieces = [(rng.randint(1, 20), rng.choice([None, 0, 1, 2]), rng.choice([None, 10, 11, 12, 13])) for _ in range(60)]
        bins, want = [], []
        for n, s, c in pieces:
            fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n
                    and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append({"left": 20, "s": set(), "c": set()})
            want.append((k, 20 - bins[k]["left"]))
            bins[k]["left"] -= n
            bins[k]["s"].add(s)
            bins[k]["c"].add(c)
        assert packing.pack_group(pieces, 20) == want


def test_many_short_texts_of_one_source_pack_in_seconds():
    begun = time.perf_counter()
    placed = packing.pack_group([(2, 0, None)] * 20_000, 2048)
    assert placed == [(k, 0) for k in range(20_000)] and time.perf_counter() - begun < 20


# ---------------------------------------------------------------- HTML

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div>b<div>c</div>", "a\nb\nc"), ("a  <b> b</b>\n c", "a b c"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>three</ul>", "- one\n- two\n  3. x\n  4. y\n- three"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apples<td>3</table>", "Name    Qty\nApples  3"),
    ("<table><tr><td>a<td><table><tr><td>x<td>y<tr><td>zz<td>w</table><td>b</table>", "a  x   y  b\n   zz  w"),
    ("<head><title>t</title></head><body>b<script>var a='</p>'</script><style>p{}</style></body>", "b"),
    ("a<p hidden>no</p><p style='color:red; DISPLAY : none'>no</p><template>no</template>b<div style='visibility:hidden'>no</div>", "ab"),
    ("x<!-- no --><!doctype html>y &amp; &lt;b&gt; &nbsp;z", "xy & <b>  z"),
    ("1 < 2 and <3", "1 < 2 and <3"), ("</p></div></table>x</b>", "x"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("<a title='a > b'>t</a>", "t"), ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
])
def test_layout(page, text):
    assert html_render.render(page) == text


@pytest.mark.parametrize("page,text", [
    ("<table><form><tr><td>x</table>", "x"), ("<table>a<tr>b<td>x<tr><div>c</div><td>y</table>d", "ab\nc\n\nx\ny\n\nd"),
    ("<table><td>x", "x"), ("<table><tbody><p>a<tr><td>x</table>", "a\n\nx"), ("<table><tr><td>a</td><table><tr><td>b", "a\n\nb"),
    ("<table><caption>c<tr><td>x</table>", "c\nx"), ("<table><colgroup><col><tr><td>x</table>", "x"),
    ("a<svg><title>no</title><defs><text>no</text></defs><text>b</text><text>c</text></svg>d", "a\nb\nc\nd"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"), ("<svg><defs><p>x", "x"),
    ("<textarea>\na &amp; b</textarea>", "a & b"), ("<select><optgroup label=g><option>a<option selected>b</select>", "g\na\nb"),
    ("<svg><desc/><text>a</text></svg>", "a"), ("<datalist><option>no</datalist>a", "a"),
])
def test_visible_content_of_tables_and_controls(page, text):
    assert html_render.render(page) == text


def test_no_visible_word_is_lost():
    rng = random.Random(8)
    tags = ["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "form", "div", "p", "b", "ul", "li", "dl", "dd", "select",
            "option", "svg", "text", "g", "math", "mi", "pre", "span", "a", "center", "hr", "br", "col"]
    for _ in range(4000):
        words, bits = [], []
        for _ in range(rng.randint(1, 30)):
            if rng.random() < 0.4:
                words.append(f"q{len(words):03}q")
                bits.append(words[-1])
            else:
                bits.append(f"<{rng.choice(['', '', '', '/'])}{rng.choice(tags)}>")
        page = "".join(bits)
        shown = html_render.render(page)
        assert all(shown.count(w) == 1 for w in words), page


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td rowspan=2>x<td>1<td>9<tr><td>2<td>8</table>", "x  1  9\n   2  8"),
    ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr></tr><tr><td>f<td>g<td>h</table>", "a  b  c\nd     e\nf  g  h"),
    ("<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3<tbody><tr><td>4<td>5</table>", "x  1\n   2\n   3\n4  5"),
    ("<table><tr><td>p<td colspan=2 rowspan=2>q<td>r<tr><td>s<td>t<tr><td>u<td>v<td>w<td>y</table>", "p  q     r\ns        t\nu  v  w  y"),
    ("<div style='visibility:hidden'>a<p style='visibility: visible'>b<i>c</i></p>d<table><tr><td>e<td style='visibility:visible'>f</table></div>g",
     "bc\n\n  f\n\ng"),
    ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
    ("<div style='display:none'><p style='visibility:visible'>a</div>b", "b"),
    ("<details>a<summary>b</summary>c<p>d</details>e", "b\ne"),
    ("<details open><summary>b</summary>c</details>e", "b\nc\ne"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=10><li>a<li value=x>b</ol>", "10. a\n9. b"),
])
def test_spans_visibility_and_list_numbers(page, text):
    assert html_render.render(page) == text


def test_cells_are_placed_as_by_a_grid():
    rng = random.Random(5)
    for _ in range(2000):
        group = [[("", rng.randint(1, 3), rng.choice([0, 1, 1, 1, 2, 3, 9])) for _ in range(rng.randint(0, 4))]
                 for _ in range(rng.randint(0, 7))]
        held, want = set(), []
        for r, row in enumerate(group):
            at, cells = 0, []
            for content, span, rows in row:
                while (r, at) in held:
                    at += 1
                cells.append((at, span, content))
                taken = [c for c in range(at, at + span) if (r, c) not in held]
                held |= {(q, c) for q in range(r + 1, r + rows if rows else len(group)) for c in taken}
                at += span
            want.append(cells)
        assert html_render._placed(group) == want, group


def test_many_cells_of_many_rows_take_time_in_proportion():
    n = 20_000
    start = time.process_time()
    group = [[("", 1, 2 + k) for k in range(n)], *([("", 1, 1)] for _ in range(n))]
    assert [row[0][0] for row in html_render._placed(group)] == [0, n, *[0] * (n - 1)]
    assert time.process_time() - start < 20


def test_deep_and_broken_pages_do_not_raise():
    html_render.render("<div>" * 50_000 + "x")
    html_render.render("<b>" * 20_000 + "</i>" * 2000)
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "<li>", "</ul>", "<ul>", "x", " y ", "<", "&amp;", "<!--", "-->",
            "<pre>", "\n", "</pre>", "<a b='", "<br/>", "<td colspan=3>", "<style>", "</style>", "<dd>", "<select><option>q"]
    for _ in range(2000):
        html_render.render("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
