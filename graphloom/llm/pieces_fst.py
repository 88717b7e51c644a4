"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from the vocabulary once:

* the normaliser, whose first state writes a dummy space before any text and whose second one maps spaces to U+2581;
* the pieces, a trie whose arcs weigh minus a piece's score, with byte fallback as arcs that are dearer than any piece;
* the neighbours, an acceptor whose states are pieces: after one piece another may follow if merging
  the characters of both, by the vocabulary's order of merges, ends in just these two.  Only paths that merging leaves pass it.

An input is composed with them state by state (place, last piece).  The path of the tropical semiring's
least weight is looked for depth first, longest arcs first, and states that reach no end are not entered again.
The vocabulary is one of merges: the acceptor leaves a single path through pieces, which is the library's own encoding,
so the first one found is the shortest.

No piece of the vocabulary has U+2581 after another character, so every path
passes through the state before each space that follows a word, as it does through those
around a character that is in no piece, and the shortest path of a
text is made of those of its words; the compiler checks this and otherwise takes a
text as one word.  Paths of words are kept in a table of bounded size, and long words are read without recursion.

Defined cases: null and empty texts have no ids and decode to the empty text;
lone control, unassigned and any other characters outside the vocabulary are bytes; very long
words cost time in proportion to their length; repeated rows each get a row;
an empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KEPT_WORDS, KEPT_PAIRS = 500_000, 1_000_000


class Normaliser:
    """Two states: the first writes the dummy space, the second maps characters."""

    def __init__(self) -> None:
        self.first, self.arcs = MARK, {" ": MARK}

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        for x, y in self.arcs.items():
            text = text.replace(x, y)
        return self.first + text


class Neighbours:
    """Whether merging leaves two pieces apart; a table of bounded size."""

    def __init__(self, weight: dict[str, float]) -> None:
        self.weight, self.known = weight, {}

    def merged(self, text: str) -> list[str]:
        """What is left of the characters when the best pair of neighbours, the leftmost of equals, is merged again and again."""
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(self.weight[x], i, x) for i in range(len(part) - 1) if (x := part[i] + part[i + 1]) in self.weight]
        heapq.heapify(heap)
        while heap:
            _, i, x = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= len(part) or part[i] + part[j] != x:
                continue
            part[i], part[j] = x, ""
            k = after[i] = after[j]
            if k < len(part):
                before[k] = i
                if (y := x + part[k]) in self.weight:
                    heapq.heappush(heap, (self.weight[y], i, y))
            if (k := before[i]) >= 0 and (y := part[k] + x) in self.weight:
                heapq.heappush(heap, (self.weight[y], k, y))
        return [x for x in part if x]

    def __call__(self, a: str, b: str) -> bool:
        if (ok := self.known.get((a, b))) is None:
            if len(self.known) >= KEPT_PAIRS:
                self.known.clear()
            ok = self.known[a, b] = self.merged(a + b) == [a, b]
        return ok


class Transducer:
    def __init__(self, path: str = VOCABULARY) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in usual}
        self.weight = {self.text[i]: -sp.get_score(i) for i in usual}
        self.dear = max(self.weight.values()) + 10.0  # of one byte
        self.normalise, self.follows = Normaliser(), Neighbours(self.weight)
        self.longest = max(map(len, self.weight))
        self.trie: dict = {}
        for x in self.weight:
            if self.follows.merged(x) == [x]:
                at = self.trie
                for c in x:
                    at = at.setdefault(c, {})
                at[""] = x
        self.splits = not any(MARK in x.lstrip(MARK) for x in self.weight)
        inner = "".join(map(re.escape, sorted({c for x in self.weight for c in x} - {MARK})))
        self.words = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{MARK}{inner}]+" if self.splits else r"(?s:.+)")
        self.known = Known(self.path)
        self.raw = [bytes([self.value[i]]) if i in self.value else self.text[i].encode() for i in range(n)]
        self.is_byte = np.isin(np.arange(n), list(self.value))

    def _arcs(self, word: str, s: int) -> list[str]:
        """The pieces from s on, the shortest first; a character in no piece is by itself."""
        at, out = self.trie, []
        for c in word[s : s + self.longest]:
            if c not in at:
                break
            at = at[c]
            if "" in at:
                out.append(at[""])
        return out or [word[s]]

    def path(self, word: str) -> tuple[tuple[int, ...], float]:
        """The ids and the weight of the shortest path of a normalised text."""
        n, dead, place, taken, arcs = len(word), set(), 0, [], self._arcs
        near, follows, last = self.follows.known, self.follows, ""
        open_ = [arcs(word, 0)] if n else []
        while place < n:
            if not open_[-1]:  # no piece here leads to the end
                open_.pop()
                x = taken.pop()
                last = taken[-1] if taken else ""
                dead.add((place, x))
                place -= len(x)
                continue
            x = open_[-1].pop()
            if last and (ok := near.get((last, x))) is not True and (ok is False or not follows(last, x)) or dead and (place + len(x), x) in dead:
                continue
            taken.append(x)
            last = x
            place += len(x)
            if place < n:
                open_.append(arcs(word, place))
        ids, weight = [], 0.0
        for x in taken:
            if x in self.id:
                ids.append(self.id[x])
                weight += self.weight[x]
            else:
                raw = x.encode("utf-8", "surrogatepass")
                ids += [self.byte[b] for b in raw]
                weight += self.dear * len(raw)
        return tuple(ids), weight

    def __call__(self, text: str | None) -> tuple[np.ndarray, float]:
        """The ids, as 32-bit integers, and the weight of a text's shortest path."""
        known = self.known
        paths = [known[w] for w in self.words.findall(self.normalise(text or ""))]
        return np.fromiter(chain.from_iterable([p[0] for p in paths]), "<i4"), sum([p[1] for p in paths], 0.0)

    def encode(self, text: str | None) -> tuple[list[int], float]:
        ids, weight = self(text)
        return ids.tolist(), weight

    def decode(self, ids: list[int]) -> str:
        """Pieces and byte fallback are put together as bytes; what then isn't UTF-8 becomes U+FFFD."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


class Known(dict):
    """Shortest paths of words by word, found when first asked for; a table of bounded size.  When it is full it becomes the older half,
    from which words that are asked for again come back."""

    def __init__(self, path) -> None:
        self.path, self.older = path, {}

    def __missing__(self, word: str) -> tuple[tuple[int, ...], float]:
        found = self.older.get(word) or self.path(word)
        if len(word) < 100:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, weight, decoded) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in pieces(batches, "text"):
            ids, weights = zip(*map(t.encode, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(weights), pa.array(list(map(t.decode, ids)))], ["doc_id", "ids", "weight", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, weight double, decoded string")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, weight, ids_sha256 of the little-endian 32-bit ids, round_trip) of each row.  U+2581 in a text
    decodes to a space, as in any such vocabulary; round_trip allows for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in pieces(batches, "text"):
            rows = []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids, w = t(text)
                rows.append((d, len(ids), int(t.is_byte[ids].sum()), round(w, 3), hashlib.sha256(ids.tobytes()).hexdigest(), t.decode(ids.tolist()) == (text or "").replace(MARK, " ")))
            names = ["doc_id", "n_ids", "n_byte_ids", "weight", "ids_sha256", "round_trip"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, weight double, ids_sha256 string, round_trip boolean")
