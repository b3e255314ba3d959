"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton holds every run of words of every item, in a number of states that grows with the items' words. A
document's words stream through it once; the automaton tracks the longest suffix that occurs in an item. Where that is
at least ``window`` words long, these words are hit, and the state of the suffix of exactly ``window`` words tells which
items hold that window. An item of fewer words is one window of its own, found by links to the items that end there.

Items are dealt into blocks of at most ``block_words`` words, an automaton each, so that memory is bounded whatever the
size of the benchmark; a document passes through the blocks in turn, in one task, and its hits are united. Blocks lie in
the shared folder and each Python worker keeps one at a time while it has several.

Defined results: null and empty texts have no words, and an item without words has no window; items with equal texts
each count; repeated rows get the same result each; an empty benchmark hits nothing and an empty table gives no rows.
Null item ids are left out of the lists of ids but count as items; ids are compared and sorted as strings. Extra columns
are kept unless they clash with a result's name, in which case the result's column replaces them.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import ANY_CASE_WORD, words_of
from tidemark.runtime import fresh_path, ship

WINDOW = 8


class Automaton:
    """A generalised suffix automaton over word ids, of which no match runs over the end of an item."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = array("q", [-1])
        self.length = array("q", [0])
        self.items: list[str | None] = []
        self.holders: dict[int, set[int]] = {}  # by the state of a whole window
        self.short: dict[int, list[tuple[int, int]]] = {}  # state: (words, item) of items shorter than a window
        self.near: list[int] = []

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def build(self, items: Iterable[tuple[str | None, list[str]]]) -> Automaton:
        texts = []
        for name, words in items:
            if words:
                ids = [self.words.setdefault(w, len(self.words)) for w in words]
                texts.append(ids)
                self.items.append(name)
                last = 0
                for i in ids:
                    last = self._extend(last, i)
        for item, ids in enumerate(texts):
            state = 0
            for k, i in enumerate(ids):
                state = self.next[state][i]
                if k + 1 >= self.window:
                    state = self._suffix(state)
                    self.holders.setdefault(state, set()).add(item)
            if len(ids) < self.window:
                self.short.setdefault(state, []).append((len(ids), item))
        # The nearest state on the way to the root, itself included, at which short items end.
        self.near = [-1] * len(self.next)
        if self.short:
            for state in sorted(range(len(self.next)), key=self.length.__getitem__):
                self.near[state] = state if state in self.short else self.near[self.link[state]] if state else -1
        return self

    def _suffix(self, state: int) -> int:
        """The state that holds the suffix of window words of a match that ends here."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of hit words, which may touch or overlap, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, window, near = self.next, self.link, self.length, self.window, self.near
        shorts = bool(self.short)
        state = matched = 0
        for at, word in enumerate(map(self.words.get, words)):
            if word is None:
                state = matched = 0
                continue
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            if not state:
                matched = 0
                continue
            matched += 1
            if matched >= window:
                start = at + 1 - matched
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], at + 1)
                else:
                    spans.append((start, at + 1))
                found |= self.holders[self._suffix(state)]
            if shorts:
                s = near[state]
                while s >= 0:
                    for n, item in self.short[s]:
                        if n <= matched:
                            spans.append((at + 1 - n, at + 1))
                            found.add(item)
                    s = near[link[s]] if s else -1
        return spans, found


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def write_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = 1_000_000) -> list[str]:
    """Builds the automata from (id, text) rows, which come to the driver one after the other; returns their files."""
    spark = items.sparkSession
    folder = fresh_path(spark, "decontamination")
    rows = items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator(prefetchPartitions=False)
    taken = ((r[0], words_of(r[1])) for r in rows)
    paths: list[str] = []

    def write(block: list) -> None:
        path = f"{folder}/{len(paths)}.block"
        fs, name = pafs.FileSystem.from_uri(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(name, compression=None) as out:
            out.write(pickle.dumps(Automaton(window).build(block), protocol=5))
        paths.append(path)

    block, size = [], 0
    for item in taken:
        block.append(item)
        size += len(item[1])
        if size >= block_words:
            write(block)
            block, size = [], 0
    if block:
        write(block)
    return paths


_open: dict[str, Automaton] = {}


def _block(path: str) -> Automaton:
    if path not in _open:
        _open.clear()
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name, compression=None) as source:
            _open[path] = pickle.loads(source.read())
    return _open[path]


def cleaned(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first to its last word."""
    if not spans:
        return text
    places = [m.span() for m in ANY_CASE_WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join((*out, text[at:]))


RESULT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("n_items", pa.int64()), ("longest", pa.int64()), ("clean_text", pa.string())]
RESULT_SQL = "n_words long, n_hit long, spans array<array<long>>, items array<string>, n_items long, longest long, clean_text string"


def find_contamination(docs: DataFrame, blocks: list[str], text: str = "text", rows_at_once: int = 512, clean: bool = True) -> DataFrame:
    """docs with n_words, n_hit, spans (of words, united), items, n_items, longest (words of the longest span) and clean_text."""
    ship(docs.sparkSession)
    taken = {n for n, _ in RESULT} | {"__text"}
    kept = [c for c in docs.columns if c.lower() not in taken]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                texts = batch.column("__text").to_pylist()
                words = list(map(words_of, texts))
                spans: list[list] = [[] for _ in texts]
                items: list[list] = [[] for _ in texts]
                for path in blocks:
                    automaton = _block(path)
                    for i, w in enumerate(words):
                        hit, found = automaton.stream(w)
                        if found:
                            spans[i] += hit
                            items[i] += [automaton.items[k] for k in found]
                spans = list(map(united, spans))
                columns = [
                    [len(w) for w in words],
                    [sum(b - a for a, b in s) for s in spans],
                    spans,
                    [sorted(x for x in k if x is not None) for k in items],
                    list(map(len, items)),
                    [max((b - a for a, b in s), default=0) for s in spans],
                    [cleaned(t, s) if clean and t is not None else None for t, s in zip(texts, spans, strict=True)],
                ]
                arrays = [batch.column(c) for c in kept] + [pa.array(v, kind) for v, (_, kind) in zip(columns, RESULT, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(n for n, _ in RESULT)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "__text"), RESULT_SQL])
    return given.mapInArrow(find, schema)


def decontaminated(found: DataFrame, most_items: int = 2, longest: int = 13, coverage: float = 0.2) -> DataFrame:
    """Drops documents beyond a limit (items, words of a span, share of words hit); cuts the spans out of the others."""
    over = (F.col("n_items") >= most_items) | (F.col("longest") >= longest) | (F.col("n_hit") > F.lit(coverage) * F.col("n_words"))
    return found.filter(~over)


