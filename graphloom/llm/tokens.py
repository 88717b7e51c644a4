"""Token counts by offset-mapped attribution.

A whole document is encoded once; every token has a byte span.  The spans are
joined with the spans of the sections (by binary search, as both are sorted),
and a token that crosses a boundary goes to the section with most of its bytes,
the earlier one on a tie.  So the sections' counts add up to the document's.

Sections are lines (with their line feed) unless the caller gives others.
White space of LONG characters or more, on which the pattern's search would run out of stack, is encoded apart, at the places where the
pattern itself separates it: all of the run but its last character, which belongs to what follows.

Defined cases: null and empty texts have no tokens and no sections; a section
may have no tokens; repeated rows each get their rows; an empty table gives an
empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-tokenizer's pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The characters that the pattern's \s stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 10_000


@cache
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(enc: tiktoken.Encoding, text: str, long: int = LONG) -> list[int]:
    """The tokens of a whole text."""
    out, at = [], 0
    for m in re.finditer(f"[{WHITE}]{{{long},}}", text):
        start, end = m.span()
        end -= end < len(text)
        out += enc.encode_ordinary(text[at:start]) + enc._encode_single_piece(text[start:end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def line_ends(text: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By section (that ends at ends): its tokens, and how many of them cross a boundary."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    best = a.copy()
    for t in np.flatnonzero(a != b):
        edges = np.concatenate(([start[t]], ends[a[t] : b[t]], [stop[t]]))
        best[t] = a[t] + int(np.argmax(np.diff(edges)))
    n = len(ends)
    return np.bincount(best, minlength=n), np.bincount(best[a != b], minlength=n)


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_crossing, section_end, section_tokens): the sections as lists, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(vocabulary)
        for b in pieces(batches, "text"):
            n, cross, ends, counts = [], [], [], []
            for text in b.column("text").to_pylist():
                if not text:
                    n.append(0), cross.append(0), ends.append([]), counts.append([])
                    continue
                ids = np.array(encode(enc, text), np.int64)
                e = line_ends(text.encode())
                own, crossing = attribute(lengths[ids], e)
                n.append(len(ids)), cross.append(int(crossing.sum())), ends.append(e), counts.append(own)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(cross, pa.int64()), pa.array(ends, longs), pa.array(counts, longs)], ["doc_id", "n_tokens", "n_crossing", "section_end", "section_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_crossing long, section_end array<long>, section_tokens array<long>")
