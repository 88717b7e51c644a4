"""SimHash near-dedup at a stated similarity: links of fingerprints, checked by the whole shingle sets, and an exact way for the rest.

At a Jaccard similarity of 0.8 fingerprints often differ in more bits than anchors can reach, so the links that SimHash gives (`simhash.links`
on five-word shingles) are the first pairs but cannot be all.  The others are found with no loss by a
prefix-filtered join.

Shingles have one global order: those that every SHARE-th text does not repeat come first, the others by
how often they do.  The share does not fall as the input grows, so passages that more and more texts have are known as common.  The order
decides only how much is compared.  Two sets at the threshold or above share a
shingle among the first n - ceil(threshold * n) + 1 of each, so texts meet by the shingles of these prefixes.
In a first pass every text is compared with its SimHash links and with one of those that it meets: of the texts with the most shared
shingles, at each of its own, the one it meets most often.  In a group of near copies that is the one nearest to the middle, so a large
group costs a row a member, and a few members are left apart.  In a second pass all pairs that
meet and are not yet in one component are compared.  Each pair is checked by its whole sets, in whole numbers, unless the sets' sketches
(parities of shingles by class of hash) differ by too much already.

Equal sets are one node, so copies never meet as pairs.  Sets are told apart by 64 bits of hash, as shingles are.
Defined cases: null and empty texts have no shingles and equal each other; fewer words than a shingle are one
shingle; null doc_ids are kept; rows that repeat are copies; an empty table gives an empty result.  Columns other than doc_id and text are
ignored by `components` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, pieces, release, small_enough
from graphloom.llm.components import component_of
from graphloom.llm.simhash import SEED, links, shingle_hashes, vote

#: The similarity from which texts link, as a fraction, and the words of a shingle.
NUM, DEN, SHINGLE = 4, 5, 5

#: One text in so many tells which shingles are common: those that OFTEN of them have, up to about COMMON of the most frequent.
SHARE, OFTEN, COMMON = 4, 3, 1_000_000

#: Up to so many texts to compare are looked up by a broadcast of their doc_ids, more by a shuffle.
BROADCAST = 500_000

#: Classes of a sketch, a multiple of 8.
BUCKETS = 1024

#: Sets that a task remembers to have sent.
SEEN = 1_000_000


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size) if text else [], np.uint64)).view(np.int64)


def _key(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("t"))


def common(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are common in a share of the texts, sorted, and how many of these have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(x, size) for x in b.column("t").to_pylist()]))], ["h"])

    sample = _texts(docs).filter(F.pmod(F.xxhash64("t"), F.lit(SHARE)) == 0).select("t").distinct()
    found = cut(sample.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN))
    release(docs.sparkSession)
    least, held = OFTEN, 0
    for k, n in found.groupBy("count").agg(F.count("*")).orderBy(F.desc("count")).collect():
        held += n
        if held > COMMON:
            least = k + 1
            break
    found = found.filter(F.col("count") >= least).toArrow()
    h, n = (found.column(c).to_numpy() for c in ("h", "count"))
    order = np.argsort(h)
    return h[order], n[order]


def prefix(s: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first shingles of a set, as many as must hold one of any set that links with it."""
    often = np.zeros(len(s), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        often = np.where(h[at] == s, n[at], 0)
    return s[np.lexsort((s, often))[: len(s) + 1 - (NUM * len(s) + DEN - 1) // DEN]] if len(s) else s


def sketch(s: np.ndarray) -> bytes:
    """The size of a set, and whether an odd number of its shingles falls into each of BUCKETS classes of hash.  A class whose parity differs
    holds a shingle that only one of two sets has, so sketches rule pairs out with no loss."""
    odd = np.bincount((s.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) & 1
    return len(s).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Whether the sets of sketches x and y, in pairs, can be at the threshold or above."""
    x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, 4 + BUCKETS // 8) for z in (x, y))
    n, m = (np.ascontiguousarray(z[:, :4]).view("<u4")[:, 0].astype(np.int64) for z in (x, y))
    apart = np.maximum(np.bitwise_count(x[:, 4:] ^ y[:, 4:]).sum(1, dtype=np.int64), np.abs(n - m))
    # of sets that link, (DEN - NUM) / (DEN + NUM) of the shingles of both, at most, are in one only
    return apart * (DEN + NUM) <= (n + m) * (DEN - NUM)


def keyed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, key (of its shingle set), fp (the SimHash of its shingles) and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            found = [shingle_hashes(x, size) if x else [] for x in b.column("t").to_pylist()]
            own = [np.unique(np.array(x, np.uint64)).view(np.int64) for x in found]
            fp = np.array([vote(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(_key, own)), pa.int64()), pa.array(fp), pa.array(list(map(sketch, own)), pa.binary())], ["doc_id", "key", "fp", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, key long, fp long, sketch binary")


def prefixes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(token, key, at) of every shingle in a text's prefix; at has the set's size in its upper 32 bits and the shingle's place in the lower.
    A task sends a set once, however many copies it reads."""
    held = docs.sparkSession.sparkContext.broadcast(common(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in pieces(batches, "t", 1 << 20):
            parts = []
            for x in b.column("t").to_pylist():
                s = shingle_set(x, size)
                if (key := _key(s)) not in seen:
                    seen.add(key)
                    p = prefix(s, *held.value)
                    parts.append((p, np.full(len(p), key), (len(s) << 32) + np.arange(len(p))))
            if len(seen) > SEEN:
                seen.clear()
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)], ["token", "key", "at"])

    return _texts(docs).mapInArrow(run, "token long, key long, at long")


def _may_link(a: str, b: str) -> Column:
    """Whether sets that have their first common shingle where a and b say can reach the threshold."""
    (na, pa_), (nb, pb) = ((F.shiftright(f"{x}.at", 32), F.col(f"{x}.at").bitwiseAND(0xFFFFFFFF)) for x in (a, b))
    return (DEN + NUM) * F.least(na - pa_, nb - pb) >= NUM * (na + nb)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets are at the threshold or above.  Sketches rule out most others before sets are sent."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array(may_link(*(b.column(c).to_pylist() for c in ("x", "y")))))

    of = lambda c, n: nodes.select(F.col("key").alias(c), F.col("sketch").alias(n))
    pairs = cut(pairs.distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(possible, "a long, b long"))
    release(docs.sparkSession)
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(nodes, "key").select(F.col("key").alias("_key"), "first"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a task sends a set once
        for b in pieces(batches, "t"):
            found = [(k, s) for x in b.column("t").to_pylist() for s in [shingle_set(x, size)] for k in [_key(s)] if k not in seen and not seen.add(k)]
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["key", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column("s").to_pylist(), b.column("z").to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    firsts = wanted.select("first").distinct()
    firsts = F.broadcast(firsts) if small_enough(firsts, BROADCAST) else firsts.hint("merge")
    own = _texts(docs)
    held = own.join(firsts, own["doc_id"].eqNullSafe(firsts["first"]), "left_semi").mapInArrow(whole, "key long, s binary")
    held = cut(held.join(wanted, held["key"] == wanted["_key"], "left_semi").groupBy("key").agg(F.any_value("s").alias("s")))
    release(docs.sparkSession)
    both = pairs.join(held.withColumnRenamed("key", "a"), "a").join(held.select(F.col("key").alias("b"), F.col("s").alias("z")), "b")
    found = cut(both.select("a", "b", "s", "z").mapInArrow(check, "a long, b long"))
    release(docs.sparkSession)
    return found


def _leaders(met: DataFrame) -> DataFrame:
    """(a, b): each text with the one that has the most shared shingles at most of its own."""
    rank = cut(met.groupBy("key").agg(F.count("*").alias("rank")))
    lead = cut(met.join(rank.hint("merge"), "key").groupBy("token").agg(F.max_by("key", F.struct("rank", "key")).alias("lead")))
    of = met.join(lead.hint("merge"), "token").filter("key <> lead").groupBy("key", "lead").agg(F.count("*").alias("k"))
    return cut(of.groupBy("key").agg(F.max_by("lead", F.struct("k", "lead")).alias("lead"))).select(*_ordered("key", "lead"))


def linked(nodes: DataFrame, docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) among nodes (key, first, fp, sketch) that join all those of a component."""
    near = links(nodes.select("fp").distinct())
    by = nodes.select("fp", "key")
    same = by.groupBy("fp").agg(F.min("key").alias("lead"))  # one text stands for a fingerprint, and the others are compared with it
    near = near.join(same.withColumnsRenamed({"fp": "a", "lead": "x"}), "a").join(same.withColumnsRenamed({"fp": "b", "lead": "y"}), "b").select(*_ordered("x", "y"))
    near = cut(near.unionByName(by.join(same, "fp").filter("key <> lead").select(*_ordered("key", "lead"))))
    release(docs.sparkSession)

    tokens = prefixes(docs, size)
    release(docs.sparkSession)
    several = cut(tokens.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token"))
    release(docs.sparkSession)
    met = cut(tokens.join(several.hint("merge"), "token"))
    release(docs.sparkSession)
    pairs = near.unionByName(_leaders(met))
    release(docs.sparkSession)
    edges = _checked(pairs, nodes, docs, size)

    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = component_of(ends.withColumn("name", F.col("node")), edges, "name").withColumnRenamed("label", "part")
    met = cut(met.join(label, met["key"] == label["node"], "left").select("token", "key", "at", F.coalesce("part", "key").alias("part")).dropDuplicates(["token", "key"]))
    release(docs.sparkSession)
    most = met.groupBy("token", "part").count().groupBy("token").agg(F.max(F.struct("count", "part")).alias("x"), F.count("*").alias("parts")).filter("parts > 1")
    most = cut(most.select("token", F.col("x.part").alias("main")))
    met = cut(met.join(most.hint("merge"), "token"))
    release(docs.sparkSession)
    at = F.col("l.token") == F.col("r.token")
    more = met.filter("part <> main").alias("l").join(met.alias("r"), at & (F.col("l.part") != F.col("r.part")) & _may_link("l", "r"))
    return edges.unionByName(_checked(more.select(*_ordered("l.key", "r.key")), nodes, docs, size))


def components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links) of each row of docs."""
    own = cut(keyed(docs, size))
    nodes = cut(own.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.any_value("sketch").alias("sketch")))
    edges = cut(linked(nodes, docs, size))
    ends = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(nodes, "key")
    label = component_of(ends.select(F.col("key").alias("node"), "first"), edges, "first")
    named = cut(nodes.select("key", "first").join(label, nodes["key"] == label["node"], "left").select("key", F.coalesce("label", "first").alias("component_id")))
    return own.select("doc_id", "key").join(named.hint("merge"), "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, columns unchanged, without all but one of each group: the smallest doc_id stays, and
    all rows with it; rows with a null doc_id stay."""
    dropped = cut(components(docs, size).filter("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct())
    release(docs.sparkSession)  # only the ids are left when the texts are dealt out
    dropped = F.broadcast(dropped) if small_enough(dropped, BROADCAST) else dropped.hint("merge")
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
