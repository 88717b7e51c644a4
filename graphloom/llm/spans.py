"""Substring dedup by sliding sentence spans.

Every run of `size` consecutive sentences is hashed and counted over all
documents, and so is every shorter run that has LEAST words or more or is a whole text; a run that
occurs again has one first occurrence (the smallest doc_id,
then the earliest place), and every sentence of its other occurrences goes.  A run whose two runs of one sentence
fewer are counted themselves is left out: where it repeats, they do, and they cover it.  What repeats only as parts of sentences stays.

Sentences end after . ! ? … (and closing marks) before white space, or at a line
feed; runs are compared by their text with white space folded and A-Z lower-cased.
Spans are told apart by 128 bits of hash.

Defined cases: null and empty texts have no sentences; a text with fewer sentences
than a span is one span; a null doc_id comes after every other; rows that repeat
doc_id and text are one occurrence, so the first document stays in all of them; an empty table gives
an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, pieces

SIZE, LEAST = 3, 10
SPANS = "doc_id long, version long, pos int, h long, h2 long"

#: A match can begin only where a run of marks does, so long runs are read once.
_END = re.compile(r"(?<![.!?…])[.!?…]++[\"'»”’)\]]*+(?=\s)|\n")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that has more than white space."""
    out, start, at, solid = [], 0, 0, False
    for m in _END.finditer(text):
        solid = solid or not text[at : m.end()].isspace()
        at = m.end()
        if solid:
            out.append((start, at))
            start, solid = at, False
    if solid or text[at:].strip():
        out.append((start, len(text)))
    return out


def _key(text: str) -> bytes:
    return b" ".join(text.encode("utf-8").lower().split())


def _spans(texts: list[str | None], size: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, place, hash) of each run; a place is the first sentence times size + 1, plus the number of sentences."""
    for k, t in enumerate(texts):
        keys = [_key(t[a:b]) for a, b in sentences(t)] if t else []
        upto = np.cumsum([0, *(x.count(b" ") + 1 for x in keys)]).tolist()
        for n in range(1, size + 1):
            for i in range(len(keys) - n + 1):
                if n < size and upto[i + n] - upto[i] < LEAST and n < len(keys):
                    continue
                if n > 1 and upto[i + n - 1] - upto[i] >= LEAST and upto[i + n] - upto[i + 1] >= LEAST:
                    continue
                yield k, i * (size + 1) + n, hashlib.blake2b(b"\n".join(keys[i : i + n]), digest_size=16).digest()


def _version(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)


def repeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, version, places): of each text, the places of its non-first repeated spans.

    Spans are counted by hash first, and only those that occur again go on with their places; the texts are cut into spans twice, which
    is less than to keep all places.  A span that a third of the documents have is counted before it is shuffled, and joined by
    shuffles on both sides, which Spark may split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            found = list(_spans(texts, size))
            at = pa.array([x[0] for x in found], pa.int64())
            version = pa.array(list(map(_version, texts)), pa.int64())
            h = np.frombuffer(b"".join(x[2] for x in found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids.take(at), version.take(at), pa.array([x[1] for x in found], pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "version", "pos", "h", "h2"])

    spans = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPANS)
    often = cut(spans.groupBy("h", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h", "h2"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "pos")
    again = cut(spans.join(often.hint("merge"), ["h", "h2"]).select("h", "h2", place.alias("place")))
    firsts = cut(again.groupBy("h", "h2").agg(F.min("place").alias("first")))
    later = again.join(firsts.hint("merge"), ["h", "h2"]).filter("place <> first")
    return later.groupBy("place.doc_id", "place.version").agg(F.sort_array(F.collect_set("place.pos")).alias("places"))


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, kept text, n_sentences, n_removed) of each row."""
    marks = repeated(docs, size).select(F.col("doc_id").alias("_id"), F.col("version").alias("_of"), "places")

    def version(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(list(map(_version, b.column("text").to_pylist())), pa.int64())], ["doc_id", "text", "_version"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts, n, gone = [], [], []
            for t, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist()):
                s = sentences(t) if t else []
                out = np.zeros(len(s), bool)
                for p in places or []:
                    i, run_size = divmod(p, size + 1)
                    out[i : i + run_size] = True
                texts.append("".join(t[a:e] for (a, e), x in zip(s, out) if not x) if s else t)
                n.append(len(s)), gone.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])

    own = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(version, "doc_id long, text string, _version long")
    joined = own.join(marks, own["doc_id"].eqNullSafe(marks["_id"]) & (own["_version"] == marks["_of"]), "left")
    return joined.select("doc_id", "text", "places").mapInArrow(run, "doc_id long, text string, n_sentences long, n_removed long")
