"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (a run of `min_match` words)
are tiled: again and again the longest run of words that both have and that no
earlier tile overlaps is marked, down to runs of min_match words.  Reordered
passages are found, as tiles may come in any order.  Coverage is the share of the
item's words in tiles.  Seeds and tiles are found by Karp-Rabin hashes, and tiles are confirmed word by
word.

Words are runs of letters and digits in lower case.  The benchmark is the stated
query set: it goes to the executors in blocks of at most `block_words` words, and
every block meets all documents.

Defined cases: null and empty texts match nothing; an item with fewer words than
a seed is matched as one whole run; an item without words matches nothing; items
that repeat are each reported; rows that repeat are each judged; empty tables give
an empty result; long runs of one word cost time, not memory.  Columns other than doc_id, item_id and text are ignored by `matches` and
kept by `drop_contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, pieces

MIN_MATCH, THRESHOLD, BLOCK_WORDS = 5, 0.5, 2_000_000

WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of `size` ids."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + ids[k : len(ids) - size + 1 + k].astype(np.uint64)
    return out


def _windows(ids: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the runs of `size` free words, and their Karp-Rabin hashes."""
    if size > len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(taken[size:] == taken[: len(ids) - size + 1])
    out, part, step, done, width = None, ids.astype(np.uint64), np.uint64(_BASE), 0, 1
    while True:  # by doubling: out holds the hashes of runs of `done` words
        if size & width:
            out = part if out is None else out[: len(ids) - done - width + 1] * step + part[done : len(ids) - width + 1]
            done += width
        if done == size:
            return at, out[at]
        part = part[: len(ids) - 2 * width + 1] * step + part[width : len(ids) - width + 1]
        width, step = 2 * width, np.uint64(int(step) ** 2 % (1 << 64))


def _longest(free: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def tiles(item: np.ndarray, doc: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(item start, doc start, length) of the tiles, the longest first, of equals that with the smallest item start, then the smallest
    doc start.  Memory is in proportion to the words, however often they repeat.

    The running search: the greatest length at which item and document have a hash in common is found by halving, since every
    shorter length has one too; all matches of that length are marked; then shorter ones are looked for.
    """
    free_item, free_doc, out = item > 0, np.isin(doc, item) & (doc > 0), []
    most = min(_longest(free_item), _longest(free_doc))
    while most >= size:
        low, high = size - 1, most  # runs of `low` words are known to match
        while low < high:
            mid = (low + high + 1) // 2
            if np.isin(_windows(item, free_item, mid)[1], _windows(doc, free_doc, mid)[1]).any():
                low = mid
            else:
                high = mid - 1
        if low < size:
            break
        (a, own), (b, other) = _windows(item, free_item, low), _windows(doc, free_doc, low)
        order = np.argsort(other, kind="stable")
        b, other = b[order], other[order]
        for i, h in zip(a.tolist(), own.tolist()):
            if not free_item[i : i + low].all():
                continue
            lo, hi = np.searchsorted(other, np.uint64(h), "left"), np.searchsorted(other, np.uint64(h), "right")
            for j in b[lo:hi].tolist():
                if free_doc[j : j + low].all() and (item[i : i + low] == doc[j : j + low]).all():
                    out.append((i, j, low))
                    free_item[i : i + low] = False
                    free_doc[j : j + low] = False
                    break
        most = low - 1
    return out


class Block:
    """Some items, with their vocabulary and the seeds of all of them, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items = []
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item_id, text in items:
            found = words(text)
            if not found:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found])
            size = min(min_match, len(ids))
            hashes = _rolled(ids, size)
            by_size.setdefault(size, []).append((hashes, np.full(len(hashes), len(self.items)), np.arange(len(hashes))))
            self.items.append((item_id, ids, size))
        self.seeds = {}
        for size, parts in by_size.items():
            h, k, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.seeds[size] = h[order], k[order], at[order]

    def match(self, text: str | None, least: float) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, words of the item, words covered, tiles) of each item that is covered enough."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], np.int64)
        for size, (h, item, at) in self.seeds.items():
            known = np.convolve(ids > 0, np.ones(size, int), "valid") == size if len(ids) >= size else np.zeros(0, bool)
            where = np.flatnonzero(known)
            if not len(where):
                continue
            own = _rolled(ids, size)[where]
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            ranges = np.unique(np.stack([lo, hi], 1)[hi > lo], axis=0)  # of equal hashes, so they are disjoint
            seeds = np.concatenate([np.arange(x, y) for x, y in ranges.tolist()] or [np.zeros(0, np.int64)])
            seeds = seeds[np.argsort(item[seeds], kind="stable")]
            own = item[seeds]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            for k, starts in zip(own[first].tolist(), np.split(at[seeds], first[1:])):
                item_id, words_of, _ = self.items[k]
                if _reach(starts, size) < least * len(words_of):
                    continue
                found = tiles(words_of, ids, size)
                covered = sum(t[2] for t in found)
                if covered >= least * len(words_of):
                    yield item_id, len(words_of), covered, len(found)


def _reach(starts: np.ndarray, size: int) -> int:
    """How many words of the item any tiling could cover."""
    s = np.sort(starts)
    return int(np.minimum(np.diff(s, append=s[-1] + size), size).sum())


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items, streamed through the driver one block at a time."""
    now, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        size = len(words(row.text))
        if now and n + size > most:
            yield now
            now, n = [], 0
        now.append((row.item_id, row.text))
        n += size
    if now:
        yield now


MATCHES = "item_id long, item_words long, covered_words long, n_tiles long"


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, block_words: int = BLOCK_WORDS, kind: str = "long") -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles) for each document and item with coverage >= threshold; kind: of doc_id."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast(kind), F.col("text").cast("string"))
    schema = f"doc_id {kind}, {MATCHES}"
    out = None
    for block in blocks(benchmark, block_words):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = Block(held.value, min_match)
            for batch in pieces(batches, "text"):
                found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in b.match(t, threshold)]
                kinds = [batch.schema.field(0).type] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(5)], ["doc_id", "item_id", "item_words", "covered_words", "n_tiles"])

        part = source.mapInArrow(run, schema)
        part = part if out is None and len(block) else cut(part)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH) -> DataFrame:
    """The rows of docs, columns unchanged, whose text matches no item.  Texts are judged and joined by their MD5, so rows
    with the same doc_id, or none, are judged one by one."""
    key = F.md5(F.encode("text", "UTF-8"))
    hit = matches(docs.select(key.alias("doc_id"), "text"), benchmark, threshold, min_match, kind="string")
    hit = cut(hit.select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hit, key == hit["_hit"], "left_anti")
