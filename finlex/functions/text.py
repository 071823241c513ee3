"""Text operators as Column expressions (V3, T1, T2, T4-T7, T9, counting rules).

Everything here is a JVM-side expression: it runs inside whole-stage codegen,
needs no shuffle and no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w, \s and \d are ASCII; these classes cover all of Unicode, as the reference's
# patterns do: a no-break space is common in web text.  The form is valid in Java and RE2.
WORD_CHAR = r"[\p{L}\p{N}_]"
_SPACES = (r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
SPACE = f"[{_SPACES}]"
DIGIT = r"\p{Nd}"
PUNCT = rf"[^\p{{L}}\p{{N}}_{_SPACES}]"
CONTROL_CHARS = "[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F]"
SENTENCE_BREAK = f"(?<=[.!?]){SPACE}+"

# The same sets for Java, in few predicates a character: \p{Z} holds the separators above, single
# characters below U+0100 are one bit set.  What is neither letter, number nor ``_`` is a
# punctuation or a space, so a run of both is one match.
_JAVA_SPACES = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\p{Z}"
JAVA_SPACE = f"[{_JAVA_SPACES}]"
_RUNS = {  # (remove_punctuation, remove_numbers): runs that become one space
    (True, True): r"[^\p{L}\p{Nl}\p{No}_]+",
    (True, False): r"[^\p{L}\p{N}_]+",
    (False, True): rf"[{_JAVA_SPACES}\p{{Nd}}]+",
    (False, False): f"{JAVA_SPACE}+",
}

NORMALISATION_VARIANTS = {
    # name: (lowercase, remove_punctuation, remove_numbers)
    "type": (True, True, False),
    "sentiment": (True, True, True),
    "impact": (True, False, False),
}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def remove_control_chars(col: str | Column) -> Column:
    """V3: drop ASCII control characters except tab, LF and CR."""
    return F.regexp_replace(_c(col), CONTROL_CHARS, "")


def normalize(col: str | Column, lowercase: bool = True, remove_punctuation: bool = True,
              remove_numbers: bool = False) -> Column:
    """Lower-case, punctuation and (optionally) digits to space, collapse, trim.

    Null or empty input gives ``''``.
    """
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    if lowercase:
        c = F.lower(c)
    return F.trim(F.regexp_replace(c, _RUNS[remove_punctuation, remove_numbers], " "))


def normalize_variant(col: str | Column, variant: str = "type") -> Column:
    """The three normalisation option sets used by the three models."""
    lower, punct, nums = NORMALISATION_VARIANTS[variant]
    return normalize(col, lower, punct, nums)


def words(norm: str | Column) -> Column:
    """T4: word tokens of normalised text (ARRAY<STRING>, no empty tokens)."""
    return F.array_remove(F.split(_c(norm), " "), "")


def whitespace_words(col: str | Column) -> Column:
    """Python ``str.split()``: split on whitespace runs, drop empties."""
    return F.array_remove(F.split(_c(col), f"{JAVA_SPACE}+"), "")


def sentences(text: str | Column) -> Column:
    """T5: split after ``.``, ``!`` or ``?`` followed by whitespace."""
    return F.filter(F.split(F.trim(F.coalesce(_c(text), F.lit(""))), SENTENCE_BREAK),
                    lambda s: s != "")


def ngrams(words_col: str | Column, min_n: int = 1, max_n: int = 3) -> Column:
    """Space-joined n-grams, n-major then position order."""
    w = _c(words_col)
    parts = []
    def gram(n: int):
        # one-argument lambda: F.transform treats a two-argument one as (element, index)
        return lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")

    for n in range(min_n, max_n + 1):
        parts.append(F.when(F.size(w) >= n, F.transform(
            F.sequence(F.lit(1), F.size(w) - n + 1), gram(n))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def ngrams_joined(joined: str | Column, min_n: int = 1, max_n: int = 3) -> Column:
    """T6 over space-joined words, as compiled regex scans instead of lambdas.

    For n >= 2 a zero-width look-ahead at every word start captures the next n
    words, so each n-gram list is one ``regexp_extract_all`` pass.
    """
    j = _c(joined)
    parts = []
    for n in range(min_n, max_n + 1):
        if n == 1:
            parts.append(F.filter(F.split(j, " "), lambda x: x != ""))
        else:
            pat = r"(?:^| )(?=([^ ]+" + r"(?: [^ ]+)" * (n - 1) + r"))"
            parts.append(F.regexp_extract_all(j, F.lit(pat), 1))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def fallback_tokens(text: str | Column) -> Column:
    """Whitespace words, whole text as one sentence, n-grams = words."""
    t = F.coalesce(_c(text), F.lit(""))
    ws = whitespace_words(t)
    return F.struct(F.array(t).alias("sentences"), ws.alias("words"), ws.alias("ngrams"))


# ---------------------------------------------------------------- counting rules

def count_substr(text: str | Column, term: str) -> Column:
    """Non-overlapping substring occurrences (Python ``str.count``)."""
    t = _c(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("bigint")


def count_terms(text: str | Column, terms: Iterable[str]) -> Column:
    """Sum of occurrences of every term (duplicates in the list count twice)."""
    total = F.lit(0).cast("bigint")
    for term in terms:
        total = total + count_substr(text, term.lower())
    return total


def contains_any(text: str | Column, terms: Iterable[str]) -> Column:
    t = _c(text)
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(t, F.lit(term.lower()))
    return out


def distinct_present(text: str | Column, terms: Iterable[str]) -> Column:
    t = _c(text)
    total = F.lit(0).cast("bigint")
    for term in terms:
        total = total + F.contains(t, F.lit(term.lower())).cast("bigint")
    return total


def first_position(text: str | Column, terms: Iterable[str]) -> Column:
    """Smallest 0-based position of any term, null when none occurs."""
    t = _c(text)
    pos = [F.when(F.locate(term.lower(), t) > 0, F.locate(term.lower(), t) - 1) for term in terms]
    return F.least(*pos) if len(pos) > 1 else pos[0]


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(default))


def derived_metadata(norm: str | Column, words_col: str | Column,
                     sentences_col: str | Column) -> Column:
    """text_length, word_count, sentence_count, complexity score and level."""
    n = _c(norm)
    wc = F.size(_c(words_col)).cast("bigint")
    sc = F.size(_c(sentences_col)).cast("bigint")
    ok = (wc > 0) & (sc > 0)
    score = F.when(ok, wc.cast("double") / sc.cast("double"))
    level = (F.when(~ok, F.lit(None).cast("string"))
             .when(score > 25, "alta").when(score > 15, "média").otherwise("baixa"))
    return F.struct(F.length(n).cast("bigint").alias("text_length"), wc.alias("word_count"),
                    sc.alias("sentence_count"), score.alias("complexity_score"),
                    level.alias("complexity_level"))
