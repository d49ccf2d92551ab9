"""Benchmark decontamination with Aho-Corasick automata over normalised item windows.

Items and documents are lower-cased (A-Z) and split into words. Every run of ``WINDOW`` words of an item
(or the whole item if it is shorter, but not empty) is a pattern. The automaton reads each document once;
every word inside an occurrence is hit, and hits are mapped back to code points of the original text.

The benchmark is read in blocks of at most ``block_words`` words; each block becomes one broadcast and one
automaton, so memory per task is bounded whatever the number of items. A worker keeps ``KEEP`` automata.

Defined results: null or empty texts have no words and no hits; null and empty items have no windows, items
without an id mark words but are not listed; an item given twice counts once; repeated documents are judged
each by itself; extra columns stay untouched; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import bytes_of, fresh, words_of

WINDOW = 10
BLOCK_WORDS = 60_000
KEEP = 2

RESULT = "n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<start:bigint,end:bigint>>"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def windows(text: str | None, size: int = WINDOW) -> list[tuple[str, int]]:
    """An item's patterns with their numbers of words."""
    words = [w.decode() for w in words_of((text or "").encode())]
    if not words:
        return []
    return [(f" {' '.join(words[i : i + size])} ", min(size, len(words))) for i in range(max(1, len(words) - size + 1))]


def blocks_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """Items in blocks of bounded size, one block at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of((row.t or "").encode())
        # an item over the bound is cut into pieces that overlap by a window, so that no window is lost
        for at in range(0, max(1, len(words) - WINDOW + 1), block_words):
            piece = words[at : at + block_words + WINDOW - 1]
            if not piece:
                continue
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((row.i, b" ".join(piece).decode()))
            size += len(piece)
    if block:
        yield block


def automaton_of(block: list[tuple[int | None, str]]) -> ahocorasick.Automaton:
    patterns: dict[str, tuple[int, set]] = {}
    for item, text in block:
        for pattern, n in windows(text):
            patterns.setdefault(pattern, (n, set()))[1].add(item)
    out = ahocorasick.Automaton()
    for pattern, (n, items) in patterns.items():
        out.add_word(pattern, (n, tuple(items)))
    out.make_automaton()
    return out


def scan(raw: bytes, automata: list[ahocorasick.Automaton]) -> tuple[int, int, list[int], list[dict]]:
    """Number of words, hit words, items and hit spans of one text."""
    words = words_of(raw)
    n = len(words)
    if not n:
        return 0, 0, [], []
    normal = (b" " + b" ".join(words) + b" ").decode()
    ends: list[int] = []
    sizes: list[int] = []
    items: set = set()
    for automaton in automata:
        for end, (size, of) in automaton.iter(normal):
            ends.append(end)
            sizes.append(size)
            items.update(of)
    if not ends:
        return n, 0, [], []
    # the blank that ends a pattern is the (k+1)-th of the text when k words are complete
    blanks = np.fromiter(accumulate((len(w.decode()) + 1 for w in words), initial=0), np.int64, n + 1)
    stop = np.searchsorted(blanks, np.array(ends))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, stop - np.array(sizes), 1)
    np.add.at(edge, stop, -1)
    hit = np.cumsum(edge)[:-1] > 0
    # back to the original: byte places of the words, then code points
    places = [m.span() for m in _WORD.finditer(raw)]
    lead = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    spans = [{"start": int(lead[places[a][0]]), "end": int(lead[places[b - 1][1]])} for a, b in zip(change[::2], change[1::2], strict=True)]
    items.discard(None)
    return n, int(hit.sum()), sorted(items), spans


def contamination(text: Column, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> Column:
    """The struct RESULT of a whole text against the whole benchmark."""
    context = benchmark.sparkSession.sparkContext
    blocks = [(uuid.uuid4().hex, context.broadcast(b)) for b in blocks_of(benchmark, item, item_text, block_words)]

    @F.arrow_udf(returnType=RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        raws = [t.as_py() for t in texts]
        rows = [(0, 0, set(), [])] * len(raws)
        for at in range(0, max(1, len(blocks)), KEEP):
            loaded = [_automaton(*b) for b in blocks[at : at + KEEP]]
            found = [scan(r, loaded) for r in raws]
            rows = found if at == 0 else [_joined(a, b, r) for a, b, r in zip(rows, found, raws, strict=True)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(span)]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["n_words", "n_hit", "items", "spans"]
        )

    return scanned.asNondeterministic()(bytes_of(text))


def _automaton(key: str, block) -> ahocorasick.Automaton:
    if key not in _AUTOMATA:
        while len(_AUTOMATA) >= KEEP:
            _AUTOMATA.pop(next(iter(_AUTOMATA)))
        _AUTOMATA[key] = automaton_of(block.value)
    return _AUTOMATA[key]


def _joined(a: tuple, b: tuple, raw: bytes) -> tuple:
    """Hits of two groups of blocks together."""
    if not b[1]:
        return a
    if not a[1]:
        return b
    spans: list[dict] = []
    for s in sorted([*a[3], *b[3]], key=lambda x: (x["start"], x["end"])):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1] = {"start": spans[-1]["start"], "end": max(spans[-1]["end"], s["end"])}
        else:
            spans.append(dict(s))
    text = raw.decode()
    hit = sum(len(words_of(text[s["start"] : s["end"]].encode())) for s in spans)
    return a[0], hit, sorted({*a[2], *b[2]}), spans


def with_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "contamination", **how) -> DataFrame:
    """Adds the struct of hits; nothing is shuffled."""
    return docs.withColumn(out, contamination(F.col(text), benchmark, **how))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any hit word, with their own columns only."""
    (name,) = fresh(docs, "contamination")
    return with_contamination(docs, benchmark, out=name).filter(F.col(f"{name}.n_hit") == 0).drop(name)
