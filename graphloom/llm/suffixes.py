"""Suffix-array dedup: removal of every byte covered by a string of `length` bytes that also starts elsewhere.

Suffixes that can have such a string in common have the same leading token: of the `length` bytes that a suffix begins with, the
smallest hash among all runs of GRAM bytes.  Neighbouring suffixes mostly share theirs, so a document is a list of
segments, each the bytes of consecutive suffixes with one token.

1. Segments are counted by token, without their bytes; where a token occurs once, no suffix under it repeats.
2. Of the others, those with equal bytes (told by token and a 64-bit hash of all bytes) are one class.  All suffixes
   of a class with two members or more repeat: nothing has to be compared for copies, however many.
3. Where a token has several classes, one segment of each is sent with its bytes.  Sampled splitters range-partition them by
   token, and a bucket sorts their suffixes by multikey quicksort, eight bytes a level, so equality is equality of the bytes.
4. Tokens whose classes have more than `most` bytes would be too much for one bucket.  Their suffixes are compared across
   buckets, as rows of the first eight bytes and a hash of all, counted before they are shuffled.

Texts are UTF-8 bytes; matches never cross documents; overlaps count; strings are judged on the input.
Defined cases: null and empty texts have no bytes; a text shorter than `length` keeps all; rows that repeat a text lose all of it,
if it is long enough, as each repeats the other, whatever their doc_id; null doc_ids are kept; an empty table gives
an empty result.  Columns other than doc_id and text are ignored by `remaining` and kept by `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, pieces, settled

LENGTH, GRAM, MOST, BATCH = 400, 32, 16 << 20, 1 << 20

_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)

SEGMENTS = "token long, content long, rid long, start long, n long"
BYTES = "token long, hot boolean, rid long, start long, bytes binary"
SUFFIXES = "token long, lead long, h long, rid long, start long"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def rolled(text: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` bytes, by doubling."""
    part, step, out, done = _BYTES[text], _STEP, None, 0
    width = 1
    while True:
        if size & width:
            out = part if out is None else out[: len(text) - done - width + 1] * step + part[done : len(text) - width + 1]
            done += width
        if done == size:
            return _mixed(out)
        part = part[: len(text) - 2 * width + 1] * step + part[width : len(text) - width + 1]
        width, step = 2 * width, np.uint64(int(step) ** 2 % (1 << 64))


def segments(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, first suffix, end of suffixes) of the segments of a text that has `length` bytes or more.  A segment ends where
    the first run that hashes to the token leaves the window, so two suffixes of one segment are never equal."""
    gram = min(GRAM, length)
    grams, width, most = rolled(text, gram), 1, length - gram + 1
    low = grams
    while 2 * width <= most:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if most > width:
        low = np.minimum(low[: len(low) - (most - width)], low[most - width :])
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1])])
    return low[first].view(np.int64), first, np.r_[first[1:], len(low)]


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """The segments of docs (rid, t): the hash of their bytes, and how many suffixes they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in pieces(batches, "t", 1 << 20):
            parts, contents = [], []
            for rid, t in zip(b.column("rid").to_pylist(), b.column("t").to_pylist()):
                if t is None or len(t) < length:
                    continue
                token, a, e = segments(np.frombuffer(t, np.uint8), length)
                parts.append((token, np.full(len(a), rid), a, e - a))
                whole = memoryview(t)
                contents += [digest(whole[x : y + length - 1]) for x, y in zip(a.tolist(), e.tolist())]
            if parts:
                token, rid, start, n = map(np.concatenate, zip(*parts))
                content = np.array(contents, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, content, rid, start, n)], ["token", "content", "rid", "start", "n"])

    return docs.select("rid", "t").mapInArrow(run, SEGMENTS)


def _runs(again: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The (start, end) covered by the strings that start where again is true."""
    at = np.flatnonzero(again)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.r_[0, breaks + 1]].tolist(), (at[np.r_[breaks, len(at) - 1]] + length).tolist()))


def sorted_repeats(parts: list[bytes], groups: list[int], length: int) -> list[np.ndarray]:
    """By part, which of its suffixes have their first `length` bytes in common with another suffix of the same group.

    A multikey quicksort of all suffixes at once: each level orders what is still equal by its next eight bytes and drops what is alone.
    Now and then the rest is compared with the first of its equals as a whole, so that long equal strings need few levels.
    """
    text = b"".join(parts) + bytes(8)
    word = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
    window = np.ndarray((len(text) - length - 7,), f"V{length}", text, 0, (1,)) if len(text) >= length + 8 else None
    sizes = np.array([len(p) for p in parts])
    n = np.maximum(0, sizes - length + 1)
    first = np.cumsum(sizes) - sizes
    own = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    found = np.zeros(len(text), bool)
    at, group = own, np.repeat(np.array(groups, np.int64), n)
    for level, depth in enumerate(range(0, length, 8)):
        key = word[at + depth].astype(np.uint64)
        if length - depth < 8:
            key >>= np.uint64(8 * (8 - length + depth))
        order = np.lexsort((key, group))
        at, key, group = at[order], key[order], group[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        at, group = at[several], group[several]
        if level in (1, 5, 13) and len(at):
            leads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            lead = np.repeat(at[leads], np.diff(np.r_[leads, len(at)]))
            same = np.concatenate([window[at[i : i + 4096]] == window[lead[i : i + 4096]] for i in range(0, len(at), 4096)])
            alone = np.add.reduceat(same, leads) < 2
            same &= ~np.repeat(alone, np.diff(np.r_[leads, len(at)]))
            found[at[same]] = True
            at, group = at[~same], group[~same]
        if not len(at):
            break
    found[at] = True
    return [found[a : a + k] for a, k in zip(first.tolist(), n.tolist())]


def _bucket(length: int):
    """Segments sorted by token -> the runs of them that repeat."""

    def resolved(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        again = sorted_repeats([r[3] for r in rows], [r[0] for r in rows], length)
        runs = [(rid, start + a, start + e) for (_, rid, start, _), x in zip(rows, again) for a, e in _runs(x, length)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*runs) if runs else [[]] * 3)], ["rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("token", "rid", "start", "bytes"))):
                if held > BATCH and row[0] != rows[-1][0]:
                    yield resolved(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield resolved(rows)

    return run


def _suffixes(length: int):
    """Segments -> a row for each suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "bytes", 1 << 18):
            parts = b.column("bytes").to_pylist()
            h = [rolled(np.frombuffer(p, np.uint8), length) for p in parts]
            lead = np.concatenate([np.ndarray((len(x),), ">i8", p, 0, (1,)) for p, x in zip(parts, h)]).astype(np.int64)
            k = np.repeat(np.arange(len(h)), [len(x) for x in h])
            start = np.concatenate([np.arange(len(x)) for x in h]) + b.column("start").to_numpy()[k]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.column("token").to_numpy()[k], lead, np.concatenate(h).view(np.int64), b.column("rid").to_numpy()[k], start)], ["token", "lead", "h", "rid", "start"])

    return run


def _with_bytes(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of chosen segments (token, hot, rid, start, n), from docs (rid, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t", 1 << 20):
            rows = [(s["token"], s["hot"], rid, s["start"], t[s["start"] : s["start"] + s["n"] + length - 1]) for rid, t, own in zip(*(b.column(c).to_pylist() for c in ("rid", "t", "own"))) for s in own]
            if rows:
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["token", "hot", "rid", "start", "bytes"])

    own = chosen.groupBy("rid").agg(F.collect_list(F.struct("token", "hot", "start", "n")).alias("own"))
    return docs.select("rid", "t").join(own, "rid").mapInArrow(run, BYTES)


def repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(rid, start, end) of runs of bytes that repeat; docs has rid and t (bytes), and is read more than once.  Runs of a row may overlap."""
    every = _segments(docs, length)
    tokens = every.groupBy("token").agg(F.count("*").alias("k"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    tokens = cut(tokens.filter("k > 1").select("token", (F.col("lo") < F.col("hi")).alias("mixed")))
    shared = cut(every.join(tokens.hint("merge"), "token"))
    copies = cut(shared.groupBy("token", "content").agg(F.count("*").alias("k")).filter("k > 1").select("token", "content"))
    end = F.col("start") + F.col("n") + (length - 1)
    whole = shared.join(copies.hint("merge"), ["token", "content"], "left_semi").select("rid", "start", end.alias("end"))

    one = F.min(F.struct("rid", "start", "n")).alias("one")
    classes = cut(shared.filter("mixed").groupBy("token", "content").agg(one).select("token", "one.*"))
    large = classes.groupBy("token").agg(F.sum(F.col("n") + (length - 1)).alias("held")).filter(F.col("held") > most).select("token", F.lit(True).alias("hot"))
    chosen = classes.join(cut(large).hint("merge"), "token", "left").select("token", F.coalesce("hot", F.lit(False)).alias("hot"), "rid", "start", "n")
    sent = cut(_with_bytes(docs, chosen, length))

    near = sent.filter("NOT hot").repartitionByRange("token").sortWithinPartitions("token")
    near = near.mapInArrow(_bucket(length), "rid long, start long, end long")
    apart = sent.filter("hot").mapInArrow(_suffixes(length), SUFFIXES)
    key = ["token", "lead", "h"]
    twice = cut(apart.groupBy(*key).agg(F.count("*").alias("k")).filter("k > 1").drop("k"))
    far = apart.join(twice.hint("merge"), key, "left_semi").select("rid", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(near).unionByName(far)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of runs; those that touch are one."""
    out: list[list[int]] = []
    for a, e in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def _kept(t: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, e in runs:
        out.append(t[at:a])
        at = e
    return b"".join([*out, t[at:]])


def marked(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """docs as the struct `row`, its bytes t and the list `runs` of what repeats."""
    rows = settled(docs).select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("t"))
    found = repeats(rows, length, most).groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    return rows.join(found, "rid", "left")


def remaining(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; kept is what remains, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            rows = []
            for d, t, runs in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), b.column("runs").to_pylist()):
                m = merged([(r["start"], r["end"]) for r in runs or []])
                rows.append((d, len(t), sum(e - a for a, e in m), len(m), _kept(t, m)))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    own = marked(docs.select(F.col("doc_id").cast("long"), "text"), length, most)
    return own.select("row.doc_id", "t", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs, columns unchanged but for text, which is what remains; a character cut in two goes
    as a whole.  Null texts stay null."""

    @F.pandas_udf("string")
    def rest(t, runs):
        return t.combine(runs, lambda x, r: _kept(bytes(x), merged([(y["start"], y["end"]) for y in r])).decode("utf-8", "ignore"))

    left = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(rest("t", F.coalesce("runs", F.array().cast("array<struct<start:bigint,end:bigint>>"))))
    return marked(docs, length).select(*(left.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
