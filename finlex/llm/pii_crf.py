"""Personal data by rules and a skip-chain conditional random field (operator 2).

Base spans follow fixed patterns.  Every other token that looks like a number of seven or
more digits or like an address is a candidate.  Digit groups between which blanks, brackets,
dots or hyphens stand (at most three) are candidates together where they repeat the digits
of a base span, or all but its first ones; where they are 12 to 19 digits that pass the card
check, inside a run that does not; where they are 3, 3 and 4 digits; else where what is left
of a run has 7 to 15 digits, about two a group or more, or in a longer rest at 3 and 4.  The field's variables are the base spans
(clamped to their kind) and the candidates of one document, its labels none, email, ip,
card and phone.  Factors: a log-linear score of the token's shape; a chain factor between
neighbours at most ``GAP`` code points apart; a skip factor between every two tokens with
the same key (the last seven digits, or the address), however far apart.  A candidate whose
best label is not none becomes a span.  Base spans always stay.

The skip factors of a key depend on how many of its tokens have each label, so they are one
potential over these counts, and a round takes linear time however often a key repeats.  A
token sees the expected counts of its key's other tokens (exact for clamped ones); the
chains between are solved by sum-product, exact on them.  Rounds run to convergence, for
each document alone, from several starts: every key's free tokens at their best common
label, every token by its score and its clamped repeats, and the better result with whole
keys changed.  The result with the greatest mean-field bound of the partition sum counts.

All other tokens are labelled none by construction, which makes the messages through them
constant; so leaving them out is exact.

Training (piecewise, on the corpus itself with the base spans as labels; of the unmatched
candidates a share ``MISSED`` counts as missed by the rules): counts of shape
and label, of neighbouring labels and of agreeing skip pairs (all pairs of a key) over all documents.  Shapes
are a finite set, so the driver receives a bounded number of count rows.

Defined cases: a null or empty text has no spans; repeated documents each get their row;
texts of any length are read whole, each pattern in linear time; an empty table trains a
field without counts and gives an empty result; other columns pass through ``redact``
untouched and are not read otherwise.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, prepare, texts

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
GAP = 80
ROUNDS = 20
SETTLE = 500  # most rounds of a document's skip potentials beyond one a token
STARTS = 10  # most further starts with whole keys changed
DAMPING = 0.3
MISSED = 0.1  # share of unmatched candidates taken to be of some kind the rules miss
SKIP_LIMIT = 8.0  # bounds of the trained pair scores
CHAIN_LIMIT = 2.0

# Possessive forms of the patterns: each has one way to parse, so they match the same spans
# in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_NUMBER = re.compile(r"(?<![A-Za-z0-9().+-])\+?[0-9(][0-9().-]*+")
_RUN = re.compile(r"(?<![A-Za-z0-9])[0-9]++(?:[ ().-]{1,3}+[0-9]++)++")
_DIGITS = re.compile(r"[0-9]+")
_CARD_GROUPS = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
_ONCE = {str(d): d for d in range(10)}
_TWICE = {str(d): 2 * d if d < 5 else 2 * d - 9 for d in range(10)}
_ADDRESS = re.compile(r"(?<!\S)[^\s@]++@[^\s@]++")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """The address pattern, found from each @: the run before it, cut at the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        left = text[floor:at]
        start = at - (len(left) - len(left.rstrip(_LOCAL)))
        floor = at + 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def tokens(text: str) -> list[tuple[int, int, int, str, str]]:
    """(start, end, label or -1, shape, key) of the base spans and candidates of a text, in order."""
    if not _ANY.search(text):
        return []
    base = base_spans(text)
    out = [(a, b, k + 1, *_shape(text[a:b])) for a, b, k in base]
    covered, end = [], -1
    for a, b, _ in base:
        if a >= end:
            covered.append([a, b])
        else:
            covered[-1][1] = max(covered[-1][1], b)
        end = max(end, b)
    found = [(m.start(), m.end()) for m in _ADDRESS.finditer(text)]
    for m in _NUMBER.finditer(text):
        s = m.group()
        body = s.rstrip("().-")
        a = m.start() + len(s) - len(s.lstrip("("))
        b = m.start() + len(body)
        if b < len(text) and text[b].isalnum() and ord(text[b]) < 128:
            continue
        if sum("0" <= c <= "9" for c in body) >= 7:
            found.append((a, b))
    k, last, plain = 0, -1, []
    for a, b in sorted(found):
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if a >= last and not (k < len(covered) and covered[k][0] < b):
            plain.append((a, b))
            last = b
    known = {digits_of(text[a:b]) for a, b, kind in base if kind > 1}
    more, repeats = spaced(text, covered, plain, known)
    k = 0
    for a, b in plain:
        while k < len(repeats) and repeats[k][1] <= a:
            k += 1
        if not (k < len(repeats) and repeats[k][0] <= a and b <= repeats[k][1]):
            more.append((a, b))
    out += [(a, b, -1, *_shape(text[a:b])) for a, b in {*more, *repeats}]
    return sorted(out, key=lambda t: (t[0], t[2], t[1]))


def spaced(text: str, covered: list, plain: list, known: set[str]) -> tuple[list, list]:
    """Candidates of several digit groups outside the ``covered`` spans: new ones, and those that repeat ``known`` digits.

    ``plain`` are the candidates without blanks, which stay beside the new ones unless a repeat holds them.
    """
    more, repeats = [], []
    suffixes = {d[k:] for d in known for k in range(len(d) - 6)}
    keys = {d[-7:] for d in known}
    c = p = 0
    for run in _RUN.finditer(text):
        groups: list[tuple[int, int]] = []
        parts = [groups]  # of the run, between base spans
        for g in _DIGITS.finditer(text, run.start(), run.end()):
            a, b = g.span()
            while c < len(covered) and covered[c][1] <= a:
                c += 1
            if c < len(covered) and covered[c][0] < b or b < len(text) and text[b].isalnum() and ord(text[b]) < 128:
                groups = []
                parts.append(groups)
            else:
                groups.append((a, b))
        for groups in parts:
            if len(groups) < 2:
                continue
            n = len(groups)
            digit = [text[a:b] for a, b in groups]
            taken = [False] * n
            whole = "".join(digit)
            at = [0, *itertools.accumulate(map(len, digit))]  # digits before a group
            group = {x: i for i, x in enumerate(at)}

            def take(i: int, j: int, into: list) -> None:
                a, b = groups[i][0], groups[j - 1][1]
                if a and text[a - 1] == "(" and ")" in text[a:b]:
                    a -= 1
                if a and text[a - 1] == "+":
                    a -= 1
                into.append((a, b))
                taken[i:j] = [True] * (j - i)

            i = 0
            while known and i < n:
                for size in range(19, 6, -1):
                    j = group.get(at[i] + size)
                    if j and whole[at[j] - 7:at[j]] in keys:
                        d = whole[at[i]:at[j]]
                        if d in suffixes or any(d[k:] in known for k in range(size - 6)):
                            take(i, j, repeats)
                            i = j - 1
                            break
                i += 1
            gap = [text[groups[i][1]:groups[i + 1][0]] for i in range(n - 1)]
            # a card begins and ends at a blank, or inside a token too long for a phone number
            long, i = [False] * n, 0
            while i < n:
                j = i + 1
                while j < n and " " not in gap[j - 1]:
                    j += 1
                long[i:j] = [sum(map(len, digit[i:j])) > 15] * (j - i)
                i = j
            cut = [True, *(" " in gap[i] or long[i] for i in range(n - 1)), True]
            odd = [0, 0, *itertools.accumulate(g not in (" ", "-") for g in gap)]  # gaps before a group no card has
            # check sums of the digits before each place, when those at even or at odd places count once
            sums = [[0, *itertools.accumulate(_ONCE[x] if k % 2 == first else _TWICE[x] for k, x in enumerate(whole))]
                    for first in (0, 1)]
            size_of = [len(d) for d in digit]

            def cards(i: int) -> Iterator[int]:
                """Ends of the untaken sub-runs from group ``i`` that pass the card check."""
                for size in (16, 15, 14, 13, 19, 18, 17, 12):
                    j = group.get(at[i] + size)
                    if j and cut[i] and cut[j] and odd[j] == odd[i + 1] and not any(taken[i:j]):
                        once = sums[(at[j] - 1) % 2]
                        if (once[at[j]] - once[at[i]]) % 10 == 0:
                            yield j

            for i in range(n):
                if not taken[i]:
                    for j in cards(i):
                        if size_of[i:j] in _CARD_GROUPS:
                            take(i, j, more)
                            break
            # telephone groups stay candidates beside sub-runs that pass the card check by chance
            phone, i = [], 0
            while i < n - 2:
                if size_of[i:i + 3] == [3, 3, 4] and not any(taken[i:i + 3]):
                    code = i and not taken[i - 1] and size_of[i - 1] <= 3 and groups[i - 1][0] and text[groups[i - 1][0] - 1] == "+"
                    phone.append((i - 1 if code else i, i + 3))
                    i += 2
                i += 1
            closes = {j for _, j in phone}
            for i in range(n):
                if not taken[i]:
                    j = next((j for j in cards(i) if j not in closes), None)
                    if j:
                        take(i, j, more)
            for i, j in phone:
                take(i, j, more)
            i = 0
            while i < n:
                while p < len(plain) and plain[p][1] <= groups[i][0]:
                    p += 1
                if taken[i] or p < len(plain) and plain[p][0] < groups[i][1]:
                    i += 1
                    continue
                j, q = i, p
                while j < n and not taken[j]:
                    while q < len(plain) and plain[q][1] <= groups[j][0]:
                        q += 1
                    if q < len(plain) and plain[q][0] < groups[j][1]:
                        break
                    j += 1
                if 7 <= at[j] - at[i] <= 15:
                    if at[j] - at[i] >= 2 * (j - i) - 1:  # not a list of single digits
                        take(i, j, more)
                else:
                    for k in range(i, j - 1):
                        if size_of[k:k + 2] == [3, 4]:
                            take(k, k + 2, more)
                i = j
    return more, sorted(repeats)


def _checks(s: str, d: str) -> bool:
    """Whether a token passes the check of the kind it looks like."""
    if s.count(".") == 3 and all(p.isdigit() for p in s.split(".")):
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    return luhn(d) if 12 <= len(d) <= 19 else True


def _shape(s: str) -> tuple[str, str]:
    d = digits_of(s)
    shape = ",".join((f"d{min(len(d), 20)}", f".{min(s.count('.'), 4)}", f"-{min(s.count('-') + s.count(' '), 4)}",
                      f"@{min(s.count('@'), 1)}", f"a{int(any(c.isalpha() for c in s))}", f"v{int(_checks(s, d))}"))
    key = s.lower() if "@" in s else d[-7:] if len(d) >= 7 else s
    return shape, key


def possible(shape: str) -> list[bool]:
    """Whether a candidate of this shape can have each label: kinds have their number of digits and pass their check."""
    n, dots, gaps, at, _, v = (int(f[1:]) for f in shape.split(","))
    return [True, at == 1, at == 0 and dots == 3 and gaps == 0 and v == 1, at == 0 and dots == 0 and 12 <= n <= 19 and v == 1,
            at == 0 and 7 <= n <= 15]


def edges(toks: list) -> tuple[list, list]:
    """Chain edges, and skip edges to the previous token of the same key, which join all tokens of a key, as (earlier, later)."""
    chain = [(i, i + 1) for i in range(len(toks) - 1) if toks[i + 1][0] - toks[i][1] <= GAP]
    seen: dict[str, int] = {}
    skip = []
    for i, t in enumerate(toks):
        if t[4] in seen:
            skip.append((seen[t[4]], i))
        seen[t[4]] = i
    return chain, skip


@dataclass
class Field:
    """Trained factors: shape scores, chain and skip matrices over the labels."""
    shapes: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray
    clamp = np.where(np.eye(len(LABELS)) > 0, 0.0, -50.0)

    def unary(self, shape: str) -> np.ndarray:
        got = self.shapes.get(shape)
        if got is None:
            got = sum((self.weights[f] for f in ["", *shape.split(",")] if f in self.weights), np.zeros(len(LABELS)))
            if shape:
                got = np.where(possible(shape), got, -50.0)
            self.shapes[shape] = got
        return got

    def label(self, docs: list[list]) -> list[list[int]]:
        """Best label of every token of every document."""
        return [self._label(toks) for toks in docs]

    def _label(self, toks: list) -> list[int]:
        if all(t[2] > 0 for t in toks):  # all clamped: nothing to infer
            return [t[2] for t in toks]
        fixed = np.array([max(t[2], 0) for t in toks])
        unary = np.array([self.clamp[t[2]] if t[2] > 0 else self.unary(t[3]) for t in toks])
        chain, skip = edges(toks)
        ends = np.array(chain, np.int64).reshape(-1, 2)
        if not skip:
            return propagate(unary, ends, np.zeros(len(ends), np.int64), self.chain[None],
                             rounds=ROUNDS + len(toks)).argmax(axis=1).tolist()
        key = np.arange(len(toks))
        for i, j in skip:
            key[j] = key[i]
        return settle(unary, fixed, ends, self.chain, key, self.skip[0, 0]).argmax(axis=1).tolist()


def settle(unary: np.ndarray, fixed: np.ndarray, ends: np.ndarray, chain: np.ndarray, key: np.ndarray, w: float) -> np.ndarray:
    """Marginals of the tokens; those of one ``key`` have a pair score of ``w`` for each two with equal labels.

    ``fixed`` has the labels of clamped tokens and 0 for free ones.
    """
    n, k = unary.shape
    free = fixed == 0
    clamped = np.eye(k)[fixed] * ~free[:, None]
    unary = np.where(free[:, None], unary, np.where(clamped > 0, 0.0, -50.0))

    def by_key(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, k))
        np.add.at(out, key, x)
        return out

    def held(belief: np.ndarray) -> np.ndarray:
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return np.where(free[:, None], p / p.sum(axis=1, keepdims=True), clamped)

    def bound(p: np.ndarray) -> float:
        total = by_key(p)
        pairs = w / 2 * ((total ** 2).sum() - (p ** 2).sum())
        return ((p * (unary - np.log(np.maximum(p, 1e-300))))[free].sum() + pairs
                + np.einsum("ia,ab,ib->", p[ends[:, 0]], chain, p[ends[:, 1]]))

    votes = by_key(clamped)
    m = np.bincount(key[free], minlength=n)

    def common(near: np.ndarray) -> np.ndarray:
        """Every key's free tokens at their best common label, given scores of the tokens."""
        scores = by_key(np.where(free[:, None], near, 0.0)) + w * m[:, None] * votes
        return np.where(free[:, None], np.eye(k)[scores.argmax(axis=1)[key]], clamped)

    def around(p: np.ndarray) -> np.ndarray:
        near = unary.copy()
        np.add.at(near, ends[:, 0], p[ends[:, 1]] @ chain.T)
        np.add.at(near, ends[:, 1], p[ends[:, 0]] @ chain)
        return near

    src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    psi = np.concatenate([np.broadcast_to(chain, (len(ends), k, k)), np.broadcast_to(chain.T, (len(ends), k, k))])

    def settled(p: np.ndarray) -> np.ndarray:
        msg = np.zeros((len(src), k))
        for _ in range(SETTLE + n):
            belief = np.where(free[:, None], unary + w * (by_key(p)[key] - p), unary)
            np.add.at(belief, dst, msg)
            new = held(belief)
            moved = np.abs(new - p).max()
            p = DAMPING * p + (1 - DAMPING) * new
            if len(src):
                x = (belief[src] - msg[back])[:, :, None] + psi
                top = x.max(axis=1)
                out = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
                out -= out.max(axis=1, keepdims=True)
                moved = max(moved, np.abs(out - msg).max())
                msg = DAMPING * msg + (1 - DAMPING) * out
            if moved < 1e-6:
                break
        return p

    best = max((settled(p) for p in (common(unary), held(unary + w * votes[key]))), key=bound)
    for _ in range(STARTS):  # whole keys change their label while that is better
        start = common(around(best))
        if (start.argmax(axis=1) == best.argmax(axis=1)).all() or bound(other := settled(start)) <= bound(best) + 1e-9:
            break
        best = other
    return best


def propagate(unary: np.ndarray, ends: np.ndarray, kind: np.ndarray, pair: np.ndarray,
              rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Log beliefs after damped loopy sum-product over all edges at once; exact on trees."""
    if not len(ends):
        return unary
    src = np.concatenate([ends[:, 0], ends[:, 1]])
    dst = np.concatenate([ends[:, 1], ends[:, 0]])
    psi = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        x = (belief[src] - msg[back])[:, :, None] + psi
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - msg).max()
        msg = damping * msg + (1 - damping) * new
        if moved < 1e-6:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    return belief


# ---------------------------------------------------------------- training

def fit(counts: list[tuple[str, str, int]]) -> Field:
    """The field from (what, value, count) rows: ``shape`` "label|shape", ``chain`` and ``skip`` "label|label"."""
    k = len(LABELS)
    shapes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    chain, agree = np.ones((k, k)), np.ones(2)
    for what, value, n in sorted(counts):
        a, _, b = value.partition("|")
        if what == "shape":
            shapes[b][int(a)] += n
        elif what == "chain":
            chain[int(a), int(b)] += n
        else:
            agree[0 if a == b else 1] += n
    names = sorted({f for s in shapes for f in s.split(",")})
    weights = np.zeros((len(names) + 1, k))
    if shapes:
        x = np.array([[1.0, *(float(f in s.split(",")) for f in names)] for s in shapes])
        y = np.array(list(shapes.values()))
        y[:, 1:] += y[:, :1] * MISSED / (k - 1)
        y[:, 0] *= 1 - MISSED
        total = y.sum()
        step = np.zeros_like(weights)
        for _ in range(600):  # gradient descent with momentum on the penalised likelihood
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            grad = x.T @ (y.sum(axis=1, keepdims=True) * p - y) / total + 1e-3 * weights
            step = 0.9 * step - 0.5 * grad
            weights += step
    joint = chain / chain.sum()
    lift = np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))
    w = float(np.clip(np.log(agree[0] / agree[1]), 0.0, SKIP_LIMIT))
    return Field({}, dict(zip(["", *names], weights)), np.clip(lift, -CHAIN_LIMIT, CHAIN_LIMIT), w * np.eye(k))


_TOKENS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("shape", T.StringType()), T.StructField("key", T.StringType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()),
                             ("shape", pa.string()), ("key", pa.string())]))


def tokenized(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens) of every document: one pass over the texts, without them in the result."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("start", "end", "label", "shape", "key"), t)) for t in tokens(x)] for x in texts(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], ["doc_id", "tokens"])

    kind = docs.schema["doc_id"].dataType
    return map_arrow(docs.select("doc_id", "text"), batch,
                     T.StructType([T.StructField("doc_id", kind), T.StructField("tokens", _TOKENS)]))


def _unpack(column: pa.Array) -> list[list]:
    return [[tuple(t.values()) for t in doc] for doc in column.to_pylist()]


def train(tokenised: DataFrame) -> Field:
    """Count over all documents, then fit; what reaches the driver is bounded by the shapes."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[tuple[str, str], int] = defaultdict(int)
        for toks in _unpack(b.column(0)):
            label = [max(t[2], 0) for t in toks]
            for t, y in zip(toks, label):
                n["shape", f"{y}|{t[3]}"] += 1
            for i, j in edges(toks)[0]:
                n["chain", f"{label[i]}|{label[j]}"] += 1
            votes: dict[str, dict[int, int]] = {}
            for t, y in zip(toks, label):
                if y:  # an unlabelled repeat says nothing about agreement
                    seen = votes.setdefault(t[4], {})
                    for other, c in seen.items():
                        n["skip", f"{other}|{y}"] += c
                    seen[y] = seen.get(y, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.string()), pa.array([v for _, v in n], pa.string()),
                                           pa.array(list(n.values()), pa.int64())], ["what", "value", "n"])

    rows = map_arrow(tokenised.filter(F.size("tokens") > 0).select("tokens"), batch, "what string, value string, n long")
    return fit([tuple(r) for r in rows.groupBy("what", "value").agg(F.sum("n")).collect()])


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def spans_of(toks: list, labels: list[int]) -> tuple[list, list]:
    """(base spans, all spans) as (start, end, kind), ordered by start, then kind."""
    base = [(t[0], t[1], t[2] - 1) for t in toks if t[2] > 0]
    more = [(t[0], t[1], y - 1) for t, y in zip(toks, labels) if t[2] < 0 and y]
    order = lambda s: (s[0], s[2], s[1])
    return sorted(base, key=order), sorted(base + more, key=order)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base spans, their digest, and all spans."""
    spark = docs.sparkSession
    prepare(spark)
    found = materialize(tokenized(docs), "tokens")
    field = spark.sparkContext.broadcast(train(found))
    names = [f"n_{k}" for k in KINDS]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        toks = _unpack(b.column(1))
        n, digest, spans = [], [], []
        for t, y in zip(toks, field.value.label(toks)):
            base, every = spans_of(t, y)
            n.append([sum(s[2] == k for s in base) for k in range(len(KINDS))])
            digest.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
        n = np.array(n, np.int64).reshape(-1, len(KINDS))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, k]) for k in range(len(KINDS))),
                                           pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                                          ["doc_id", *names, "base_sha256", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_arrow(found, batch, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string")


def masked(text: str, spans: list) -> str:
    """``text`` with each span replaced by its kind; overlapping spans share the first one's kind."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; ``n_chars``, if there, follows the text."""
    spark = docs.sparkSession
    prepare(spark)
    field = spark.sparkContext.broadcast(train(materialize(tokenized(docs), "tokens")))
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(b.columns)
        raw = columns[at].to_pylist()
        toks = [tokens(x or "") for x in raw]
        new = [x if not t else masked(x, spans_of(t, y)[1]) for x, t, y in zip(raw, toks, field.value.label(toks))]
        columns[at] = pa.array(new, columns[at].type)
        if size is not None:
            columns[size] = pa.array([n if not t else len(x) for n, t, x in zip(columns[size].to_pylist(), toks, new)],
                                     columns[size].type)
        return pa.RecordBatch.from_arrays(columns, b.schema.names)

    return map_arrow(docs, batch, docs.schema)
