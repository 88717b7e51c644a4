"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at `threshold` or fewer differing bits.  Anchors
are the words of a covering code: bits 0-22 and 23-45 are each covered by the
perfect binary Golay code (length 23, radius 3), the other 18 bits are free.
Every fingerprint has one home anchor, the nearest word in each block.  A
fingerprint y within the threshold of x lies, block by block, within the radius
plus the bits by which the two differ there of x's home; so every fingerprint is
replicated to all anchors within radius + threshold (about 61 of 2^24 for a
threshold of 2) and compared there with the fingerprints at home.  No link can
be lost and no bucket is capped.

Equal fingerprints are one node, so copies never meet as pairs.  Links are
reduced to components with checkpointed label rounds (`components`).

Defined cases: null and empty texts have no words and the fingerprint zero,
which links like any other; fewer words than a shingle are one shingle; repeated
rows each get a row; an empty table gives an empty result.  Only doc_id and text
are read; `keep_one` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, pieces
from graphloom.llm.components import component_of

SHINGLE, SEED, THRESHOLD = 3, 42, 2

#: Length, radius and generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code.
N, RADIUS, GENERATOR = 23, 3, 0b101011100011


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= size:
        return [h(joined, SEED)]
    return [h(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[size - 1 :])]


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def vote(hashes: list[int]) -> int:
    """Bits that are set in over half the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(h, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            fp = [vote(shingle_hashes(x, shingle)) if x else 0 for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("t")).mapInArrow(run, "doc_id long, fp long")


@cache
def _code(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The syndromes of the low 12 and high 11 bits of a block, and by syndrome (start, errors, excess):
    the error patterns of weight up to RADIUS + threshold, and by how much each exceeds the radius."""

    def syndrome(x: int) -> int:
        for i in range(N - 1, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    unit = [syndrome(1 << i) for i in range(N)]
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for w in range(RADIUS + threshold + 1):
        for bits in combinations(range(N), w):
            s = e = 0
            for i in bits:
                s ^= unit[i]
                e |= 1 << i
            found[s].append((e, max(0, w - RADIUS)))
    start = np.cumsum([0, *map(len, found)])
    flat = [x for f in found for x in f]  # the one within the radius comes first
    return low, high, start, np.array([e for e, _ in flat], np.int64), np.array([x for _, x in flat], np.int64)


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fp & (1 << N) - 1, fp >> N & (1 << N) - 1


def home(fp: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The nearest anchor, as a number of 46 bits."""
    low, high, start, errors, _ = _code(threshold)
    a, b = (x ^ errors[start[low[x & 4095] ^ high[x >> 12]]] for x in _blocks(fp))
    return a | b << N


def reach(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within radius + threshold."""
    low, high, start, errors, excess = _code(threshold)
    row = np.arange(len(fp))
    parts = []
    for x in _blocks(fp):
        s = (low[x & 4095] ^ high[x >> 12])[row]
        n = start[s + 1] - start[s]
        at = np.repeat(np.arange(len(row)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + start[s][at]
        parts = [(p[at]) for p in parts] + [x[row[at]] ^ errors[k], excess[k]]
        row = row[at]
        spare = sum(parts[1::2]) <= threshold
        row, parts = row[spare], [p[spare] for p in parts]
    return row, parts[0] | parts[2] << N


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b), a < b, among distinct fingerprints (column fp)."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(home(fp, threshold)), pa.array(fp)], ["anchor", "a"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for i in range(0, len(fp), 4096):
                row, anchor = reach(fp[i : i + 4096], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i : i + 4096][row])], ["anchor", "b"])

    left = nodes.select("fp").mapInArrow(at_home, "anchor long, a long")
    right = nodes.select("fp").mapInArrow(around, "anchor long, b long")
    near = (F.col("l.anchor") == F.col("r.anchor")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # Spark takes a mapped table for as large as its input, so it would broadcast the anchors of all
    return left.alias("l").join(right.alias("r").hint("merge"), near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) and
    n_links (linked fingerprints other than the row's own) of each row of docs."""
    fps = cut(fingerprints(docs, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = cut(links(nodes, threshold))
    named = component_of(nodes.withColumnRenamed("fp", "node"), edges, "first")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    labels = named.join(ends, "node", "left").select(F.col("node").alias("fp"), F.col("label").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return fps.join(labels, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, columns unchanged, without all but one of each group: the smallest doc_id stays, and
    all rows with it; rows with a null doc_id stay."""
    dropped = near_duplicates(docs, threshold, shingle).filter("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
