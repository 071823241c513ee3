"""Greedy word-piece lengths by a linear longest-match automaton (operator 9).

The vocabulary's pieces form a trie over UTF-8 bytes.  Every node has a failure link, taken
when the next byte has no child: the longest piece that begins the node's string is popped,
then the longest of what is left, until the rest is a node again.  The number of pieces
popped on the way is computed beforehand, so a word is measured in one pass over its bytes
without building a piece.

A word is a run of anything but ASCII white space; the start mark goes before it.  Bytes no
piece covers count one each (byte fallback), which the trie holds as single-byte pieces.

Defined cases: a null or empty text has no words and no tokens; words of any length are
measured whole; repeated documents each get their row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, text_bytes

START = "▁".encode()  # the mark this kind of vocabulary puts before a word
CACHE_WORDS = 500_000


class Automaton:
    def __init__(self, pieces: list[bytes]):
        """``pieces`` must hold every single byte."""
        child: list[dict[int, int]] = [{}]
        last, parent, is_piece = [0], [0], [False]
        for p in pieces:
            u = 0
            for c in p:
                v = child[u].get(c)
                if v is None:
                    v = child[u][c] = len(child)
                    child.append({})
                    last.append(c)
                    parent.append(u)
                    is_piece.append(False)
                u = v
            is_piece[u] = True
        self.child = child
        self.fail, self.popped = [0] * len(child), [0] * len(child)
        level = list(child[0].values())
        while level:  # breadth first: shorter strings are done before
            for v in level:
                if is_piece[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    self.fail[v], self.popped[v] = self._step(self.fail[parent[v]], last[v], self.popped[parent[v]])
            level = [w for v in level for w in child[v].values()]

    def _step(self, u: int, c: int, count: int) -> tuple[int, int]:
        """The node reached with byte ``c`` from ``u`` and the pieces popped until then."""
        child, fail, popped = self.child, self.fail, self.popped
        while (v := child[u].get(c)) is None:
            count += popped[u]
            u = fail[u]
        return v, count

    def count(self, word: bytes) -> int:
        """Number of pieces of the greedy longest-match split."""
        child, fail, popped = self.child, self.fail, self.popped
        u = n = 0
        for c in word:
            while (v := child[u].get(c)) is None:
                n += popped[u]
                u = fail[u]
            u = v
        while u:
            n += popped[u]
            u = fail[u]
        return n


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a sentence-piece model as bytes, with every single byte."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return sorted({*kept, *(bytes([b]) for b in range(256))})


def counted(docs: DataFrame, pieces: list[bytes], start: bytes = START) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Automaton(pieces))  # as large as the vocabulary

    def run(batches):
        automaton, known = shared.value, {}
        for b in batches:
            words_n, tokens_n = [], []
            for data in text_bytes(b.column(1)):
                words = data.split()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        n = known[w] = automaton.count(start + w)
                    total += n
                words_n.append(len(words))
                tokens_n.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words_n, pa.int64()), pa.array(tokens_n, pa.int64())],
                                             ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def brute_force(word: bytes, pieces: set[bytes]) -> int:
    """Greedy longest match by trying every length; for tests."""
    n = 0
    while word:
        k = next(k for k in range(len(word), 0, -1) if word[:k] in pieces)
        word, n = word[k:], n + 1
    return n
