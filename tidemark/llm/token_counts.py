"""Token counts by a linear longest-match automaton.

Greedy word-pieces: of a word, the longest piece of the vocabulary that begins it, then the longest continuation piece
that begins the rest, and so on; a word that can't be cut that way is one unknown token. The vocabulary is a trie with
two roots, for beginnings and for continuations. Each node has a failure link, to where matching goes on when no child
fits, and the number of tokens that are popped on the way. So a word's count takes steps in proportion to its letters,
and no piece is built.

Counts per word are kept in a dictionary of bounded size in each worker. What is broadcast is the vocabulary (checked: at
most ``MOST_PIECES`` pieces). Words stand between white space. Defined results: a null or empty text has no words and no
tokens; repeated rows get the same counts each; an empty table gives no rows; with an empty vocabulary every word is
unknown. Columns other than the counts are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import ship

MOST_PIECES = 1_000_000
KEPT_WORDS = 400_000
BEGIN, CONTINUE, NOWHERE = 0, 1, -1


class Automaton:
    def __init__(self, beginnings: Iterable[str], continuations: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((BEGIN, beginnings), (CONTINUE, continuations)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.children[node].get(c)
                    if nxt is None:
                        nxt = self.children[node][c] = len(self.children)
                        self.children.append({})
                        token.append(False)
                    node = nxt
                if piece:
                    token[node] = True
        n = len(self.children)
        self.fail, self.pops = [NOWHERE] * n, [0] * n
        queue = [BEGIN, CONTINUE]
        for node in queue:  # by depth, as the queue grows
            for c, child in self.children[node].items():
                queue.append(child)
                if token[child]:
                    self.fail[child], self.pops[child] = CONTINUE, 1
                    continue
                z, popped = self.fail[node], self.pops[node]
                while z != NOWHERE and c not in self.children[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z != NOWHERE:
                    self.fail[child], self.pops[child] = self.children[z][c], popped

    def count(self, word: str) -> int:
        """The tokens of a word; 0 where it can't be cut."""
        children, fail, pops = self.children, self.fail, self.pops
        node, popped = BEGIN, 0
        for c in word:
            while (nxt := children[node].get(c)) is None:
                popped += pops[node]
                node = fail[node]
                if node == NOWHERE:
                    return 0
            node = nxt
        while node != CONTINUE:
            popped += pops[node]
            node = fail[node]
            if node == NOWHERE:
                return 0
        return popped


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Beginnings (pieces with the mark of a word's start, without it) and continuations of a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if p[0] != "▁"]


_automata: dict[str, tuple[Automaton, dict[str, int]]] = {}


def _automaton(tag: str, shared) -> tuple[Automaton, dict[str, int]]:
    if tag not in _automata:
        _automata.clear()
        _automata[tag] = Automaton(*shared.value), {}
    return _automata[tag]


def counted(text: str | None, automaton: Automaton, known: dict[str, int]) -> tuple[int, int, int]:
    words = text.split() if text else []
    counts = list(map(known.get, words))
    if None in counts:
        for i, n in enumerate(counts):
            if n is None:
                counts[i] = n = automaton.count(words[i])
                if len(words[i]) <= 64:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[words[i]] = n
    unknown = counts.count(0)
    return len(words), sum(counts) + unknown, unknown


def count_tokens(docs: DataFrame, vocabulary: tuple[list[str], list[str]], text: str = "text") -> DataFrame:
    """docs with n_words, n_tokens and n_unknown."""
    if sum(map(len, vocabulary)) > MOST_PIECES:
        raise ValueError("the vocabulary is too large to broadcast")
    spark = docs.sparkSession
    ship(spark)
    shared, tag = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def counts(texts: pd.Series) -> pd.DataFrame:
        automaton, known = _automaton(tag, shared)
        return pd.DataFrame([counted(t, automaton, known) for t in texts], columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_tokens", "n_unknown")]
    return docs.select(*kept, counts(F.col(f"`{text}`").cast("string")).alias("__c")).select(*kept, "__c.n_words", "__c.n_tokens", "__c.n_unknown")
