"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine.

The kernel of two words is the cosine of their gap-weighted subsequences: every triple of letters within `span` characters counts
DECAY ** (characters spanned), so inserted characters and gaps cost a little, not everything.  Landmarks are
words; the kernel to them, whitened by the landmarks' own kernel, is a word's feature vector (the cosine's POWER-th power, a kernel too).  The machine is trained on
words of labelled sentences: stems are words and their beginnings; those that toxic documents hold oftener than chance
allows among so many, and clean ones hardly ever, are toxic, however rare beside others, and so are the words that
have one and are oftener in toxic documents than in clean ones.  All other words of clean documents are clean.  Words
that two clean documents or more hold, and toxic ones not much oftener (`purity`), are known to be clean: an exact check after the
machine takes them as its clean end, since their longer forms may be toxic and the kernel hardly tells a word from those.  A
sentence scores as its worst word, a document as its worst sentence, mapped to 0..1 by a logistic curve fitted to
the training documents.

Toxic words are also trained on with one character put in between (`idxiot`), so that such spellings need not be in the labelled texts.

Words are runs of non-space characters, lower-cased, without punctuation at their ends; runs of three or more single
characters (`i d i o t`) also count joined, and words with marks in them (`st*upid`) without these.  Training takes the `sample` labels with the
smallest hash of doc_id, by label, and the first `most_chars` characters of those documents; of near copies among them one is
kept, or a text that was copied often would make all its words toxic or clean.  All else covers all data.
Defined cases: null and empty texts score as the machine's clean end; without labelled rows of both kinds every score is 0; ties
score alike; very long words are read in windows of `longest` characters; repeated rows each get a row; an empty table gives an empty
result.  A doc_id that documents repeat is
trained on with its first text in order, one with both labels with either.  Columns other than doc_id, text (and toxic, in training) are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces

DECAY = 0.7
POWER = 3  #: of the cosine, which keeps unlike words apart
KEPT_WORDS = 200_000
SKETCH = 8
CLEAN = -3.0  #: the margin of texts without words, and of words known to be clean


@dataclass(frozen=True)
class Settings:
    sample: int = 1500  #: labels of each kind
    most_chars: int = 20_000  #: of a document, in training
    alike: float = 0.5  #: share of a text's words that an earlier text has, from which it counts as a copy
    inserted: float = 3.0  #: weight of a toxic word with a character put in, of the word's own
    clean_words: int = 20_000  #: of the sample's clean texts, those with the smallest hash
    landmarks: int = 48  #: of each kind, toxic and frequent clean words
    span: int = 5
    longest: int = 24
    stem: int = 4  #: letters of the shortest beginning
    purity: float = 0.9  #: of a toxic stem: its rate in toxic documents, of the sum of its rates in both kinds
    surprise: float = 1.0  #: gain over chance from which a stem is toxic
    rounds: int = 4  #: of training, each with the clean documents' worst words of those before
    boost: float = 30.0  #: weight of a word that is a clean document's worst
    steps: int = 300
    penalty: float = 3e-3


_SPLIT = re.compile(r"\S+")
_EDGE = ".,;:!?…\"'()[]{}«»“”‘’|<>*_~`#$%&"
_MARKS = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:\w[\s.\-_*]{1,2}){2,}\w(?![^\s.,;:!?])")


def words(text: str) -> set[str]:
    t = text.lower()
    out = {w for x in _SPLIT.findall(t) if (w := x.strip(_EDGE))}
    out |= {_MARKS.sub("", w) for w in out if not w.isalnum()} - {""}
    for m in _SPACED.findall(t):
        out.add(re.sub(r"[\s.\-_*]", "", m))
    return out


class Kernel:
    """Features of words: the whitened kernel to the landmarks."""

    def __init__(self, landmarks: list[str], s: Settings) -> None:
        self.s, self.landmarks = s, landmarks
        self.offsets = [(a, b) for b in range(2, s.span) for a in range(1, b)]
        table: dict[int, dict[int, float]] = {}
        own = self._triples(landmarks)
        for row, code, weight in zip(*own):
            at = table.setdefault(int(code), {})
            at[row] = at.get(row, 0.0) + weight
        self.codes = np.array(sorted(table), np.int64)
        self.matrix = np.zeros((len(table) + 1, len(landmarks)), "f4")
        norms = np.sqrt(np.maximum(1e-9, self._norms(own, len(landmarks))))
        for k, code in enumerate(self.codes):
            for row, weight in table[int(code)].items():
                self.matrix[k, row] = weight / norms[row]
        gram = self.kernel(landmarks)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        keep = value > 0.05
        self.white = (vector[:, keep] / np.sqrt(value[keep])).astype("f4")

    def _letters(self, found: list[str]) -> np.ndarray:
        w = self.s.longest
        x = np.zeros((len(found), w + 2), np.int64)
        for k, word in enumerate(found):
            codes = [2, *map(ord, word[: w]), 3]  # marks of both ends
            x[k, : len(codes)] = codes
        return x

    def _triples(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, weight) of every weighted triple."""
        x, parts = self._letters(found), []
        for a, b in self.offsets:
            one, two, three = x[:, : x.shape[1] - b], x[:, a : x.shape[1] - b + a], x[:, b:]
            row, at = np.nonzero(three)
            parts.append((row, (one[row, at] << 42) | (two[row, at] << 21) | three[row, at], np.full(len(row), DECAY ** (b - 2))))
        return tuple(np.concatenate(p) for p in zip(*parts))

    @staticmethod
    def _norms(triples: tuple, n: int) -> np.ndarray:
        """Squared lengths; a triple that a word has twice counts as two."""
        return np.bincount(triples[0], triples[2] ** 2, minlength=n)

    def kernel(self, found: list[str]) -> np.ndarray:
        """The cosine kernel of words to landmarks."""
        row, at, weight = self._known(triples := self._triples(found))
        order = np.argsort(row, kind="stable")
        row, at, weight = row[order], at[order], weight[order].astype("f4")
        out = np.zeros((len(found), len(self.landmarks)), "f4")
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for i in range(0, len(first), 1024):
            cut = first[i : i + 1024]
            own = slice(cut[0], first[i + 1024] if i + 1024 < len(first) else len(row))
            out[row[cut]] = np.add.reduceat(self.matrix[at[own]] * weight[own, None], cut - cut[0], axis=0)
        return (out / np.sqrt(np.maximum(1e-9, self._norms(triples, len(found))))[:, None].astype("f4")) ** POWER

    def _known(self, triples: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in codes, weight) of the triples that landmarks have."""
        row, code, weight = triples
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return row[hit], at[hit], weight[hit]

    def features(self, found: list[str]) -> np.ndarray:
        return self.kernel(found) @ self.white


class Machine:
    def __init__(self, kernel: Kernel, weight: np.ndarray, bias: float) -> None:
        self.kernel, self.weight, self.bias, self.slope, self.shift = kernel, weight, bias, 2.0, 0.0
        self.known: dict[str, float] = {}
        self.clean: frozenset[str] = frozenset()

    def _chop(self, word: str) -> list[str]:
        w = self.kernel.s.longest
        return [word] if len(word) <= w else [word[i : i + w] for i in range(0, len(word) - w // 2, w // 2)]

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The margin of the worst word of each text."""
        each = [[p for x in words(t) for p in self._chop(x)] if t else [] for t in texts]
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        fresh = list({x for e in each for x in e if x not in known})
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            known.update(zip(part, (self.kernel.features(part) @ self.weight + self.bias).tolist()))
            known.update((x, CLEAN) for x in part if x in self.clean)
        return np.array([max((known[x] for x in e), default=CLEAN) for e in each])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, count: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both classes alike in weight, by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), "f4")])
    c, y = np.sqrt(count).astype("f4"), y.astype("f4")
    c[y > 0] *= 0.5 / c[y > 0].sum()
    c[y < 0] *= 0.5 / c[y < 0].sum()
    rate = 1 / (2 * np.linalg.eigvalsh((x1 * c[:, None]).T @ x1)[-1] + s.penalty)
    w = v = np.zeros(x1.shape[1], "f4")
    for t in range(s.steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        g = -2 * x1.T @ (c * y * slack) + s.penalty * v
        new = (v - rate * g).astype("f4")
        v, w = new + np.float32(t / (t + 3)) * (new - w), new
    return w[:-1].astype("f4"), float(w[-1])


def _surprise(in_bad: Counter, in_good: Counter, n_bad: int, n_good: int) -> dict[str, float]:
    """The log-likelihood gain of each word that is in more toxic texts than its share, over what chance gives among so many words."""
    often = {w: n for w, n in in_bad.items() if n > 1} or in_bad
    chance = np.log(len(often) + 1)
    out = {}
    for w, n in often.items():
        expected = (n + in_good[w]) * n_bad / (n_bad + n_good)
        out[w] = (n * np.log(n / expected) if n > expected else 0.0) - chance
    return out


def stems(word: str, least: int) -> list[str]:
    """The word, with a mark of its end, and its beginnings of `least` letters or more."""
    return [word + "$", *(word[:k] for k in range(least, len(word) + 1))]


def toxic_stems(bad: list[set[str]], good: list[set[str]], s: Settings) -> dict[str, float]:
    """The stems that speak for a toxic text; where none is beyond chance, the one with the largest gain."""
    in_bad = Counter(x for d in bad for x in {x for w in d for x in stems(w, s.stem)})
    known = {x for x, n in in_bad.items() if n > 1} or set(in_bad)
    of = {w: known.intersection(stems(w, s.stem)) for w in set().union(*good)}
    in_good = Counter(x for d in good for x in set().union(*(of[w] for w in d)))
    odd = _surprise(in_bad, in_good, len(bad), len(good))
    pure = {x: g for x, g in odd.items() if in_bad[x] * len(good) * (1 - s.purity) >= s.purity * in_good[x] * len(bad)}
    least = min(s.surprise, max(pure.values(), default=0.0))
    return {x: g for x, g in pure.items() if g >= least}


def _landmarks(mined: dict[str, float], toxic: dict[str, set[str]], in_bad: Counter, most: int) -> list[str]:
    """Toxic words, in turn the most frequent not yet taken of each stem that no stem of larger gain overlaps."""
    by: dict[str, list[str]] = {}
    for w in sorted(toxic, key=lambda w: (-in_bad[w], w)):
        by.setdefault(min(toxic[w], key=lambda x: (-mined[x], -len(x), x)), []).append(w)
    queues, out = [by[x] for x in sorted(by, key=lambda x: (-mined[x], x))], []
    for k in range(max(map(len, queues), default=0)):
        out += [q[k] for q in queues if k < len(q)]
    return out[:most]


def originals(texts: list[str], alike: float) -> list[str]:
    """The texts without near copies of earlier ones.  A text is compared with those that it shares one of its SKETCH smallest word
    hashes with."""
    out, of, by = [], [], {}
    for t in dict.fromkeys(texts):
        own = words(t)
        low = sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in own)[:SKETCH]
        near = {k for h in low for k in by.get(h, ())}
        if not own or any(len(own & of[k]) >= alike * len(own) for k in near):
            continue
        for h in low:
            by.setdefault(h, []).append(len(out))
        out.append(t)
        of.append(own)
    return out


def inserted(word: str) -> list[str]:
    """The word with one character put in between, a mark or a letter by turns."""
    return [word[:k] + "x1*-a.0"[(k + len(word)) % 7] + word[k:] for k in range(1, len(word))] if len(word) > 4 else []


def fit(rows: list[tuple[str, int]], s: Settings = Settings()) -> Machine | None:
    """A machine fitted to texts and labels."""
    bad, good = (originals([t for t, y in rows if y == kind and t], s.alike) for kind in (1, 0))
    if not bad or not good:
        return None
    own = lambda t: {w for w in words(t) if len(w) <= s.longest}
    bad_words, good_words = list(map(own, bad)), list(map(own, good))
    in_bad, in_good = Counter(w for d in bad_words for w in d), Counter(w for d in good_words for w in d)
    mined = toxic_stems(bad_words, good_words, s)
    toxic = {w: x for w, n in in_bad.items() if n * len(good) > in_good[w] * len(bad) and (x := mined.keys() & set(stems(w, s.stem)))}
    firm = {w for w, n in in_good.items() if n > 1 and in_bad[w] * len(good) * (1 - s.purity) < s.purity * n * len(bad)}
    toxic = {w: x for w, x in toxic.items() if w not in firm} or toxic
    likely = _landmarks(mined, toxic, in_bad, s.landmarks)
    often = [w for w, _ in sorted(in_good.items(), key=lambda x: (-x[1], x[0])) if w not in toxic][: s.landmarks // 2]
    if not likely or not often:
        return None
    rest = sorted((w for w in in_good if w not in toxic), key=lambda w: (zlib.crc32(w.encode()), w))
    clean, near = rest[: s.clean_words], Counter()
    spelt = {v: s.inserted * in_bad[w] for w in likely for v in inserted(w) if v not in in_good and v not in toxic}
    for _ in range(s.rounds):
        hard = [w for w, _ in sorted(near.items(), key=lambda x: (-x[1], x[0]))]
        kernel = Kernel(list(dict.fromkeys(likely + often + hard[: s.landmarks])), s)
        own_clean = list(dict.fromkeys(clean + hard))
        x = np.vstack([kernel.features([*toxic, *spelt]), kernel.features(own_clean)])
        y = np.r_[np.ones(len(toxic) + len(spelt)), -np.ones(len(own_clean))]
        count = np.array([*(in_bad[w] for w in toxic), *spelt.values(), *(in_good[w] + s.boost * near[w] for w in own_clean)], float)
        machine = Machine(kernel, *_svm(x, y, count, s))
        # a clean document scores as its worst word, so those words weigh more in the next round
        margin = dict(zip(rest, (kernel.features(rest) @ machine.weight + machine.bias).tolist()))
        near += Counter(max(c, key=lambda w: (margin[w], w)) for d in good_words if (c := d & margin.keys()))
    margins = np.r_[machine.worst(bad), machine.worst(good)]
    y = np.r_[np.ones(len(bad)), np.zeros(len(good))]
    _curve(machine, margins, y)  # before the exact check, which the texts that it was made of would flatter
    machine.known, machine.clean = {}, frozenset(firm - toxic.keys())
    return machine


def _curve(machine: Machine, m: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift: the threshold with the smallest sum of both kinds' error rates gets 0.5."""
    cuts = np.unique(m)
    cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    order = np.argsort(m)
    ahead = np.searchsorted(m[order], cuts)
    bad_below = np.r_[0, np.cumsum(y[order])][ahead]
    good_above = (1 - y).sum() - np.r_[0, np.cumsum(1 - y[order])][ahead]
    best = np.flatnonzero((e := bad_below / y.sum() + good_above / (1 - y).sum()) == e.min())
    machine.slope = 4.0
    machine.shift = -4.0 * float(cuts[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Machine | None:
    """A machine fitted to docs (doc_id, text) with labels (doc_id, toxic).  The sample is chosen among the labels alone, so texts are
    only read, not shuffled; it is broadcast (2 * `sample` rows at most), and only its texts reach the driver, one for each doc_id."""
    own = labels.select(F.col("doc_id").alias("_id"), "toxic").filter("_id IS NOT NULL").dropDuplicates(["_id", "toxic"])
    kinds = [own.filter(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(s.sample) for k in (0, 1)]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]))
    texts = docs.filter("text IS NOT NULL").join(chosen, F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("_id", "toxic").agg(F.min(F.substring("text", 1, s.most_chars)).alias("text"))
    return fit([(r.text, r.toxic) for r in texts.orderBy(F.xxhash64("_id"), "_id").toLocalIterator()], s)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in pieces(batches, "text"):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.scores(texts) if m else np.zeros(len(texts)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
