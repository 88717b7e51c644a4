"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on windows of labelled
texts.  It labels every byte of a text; a document's probabilities are the mean of its bytes'.  A text is
read in windows of `window` bytes, each with fresh states, so that time and memory are proportional to the text
and windows of many documents run as one batch.

Training takes a bounded sample of the labelled rows: the `sample` rows with the
smallest hash of doc_id, by language, and `windows` windows of each.  Everything else covers all data.
Defined cases: null texts and texts without letters are `und` with score 0; ties go to the language that
sorts first; with no labelled rows every text is `und`; repeated rows each get a row; an empty table gives an empty result.
Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import pieces

#: Times the sample that the rows ranked for it are expected to be.
SPARE = 3

LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    hidden: int = 12  #: of each direction
    window: int = 64
    sample: int = 400  #: documents of each language
    windows: int = 12  #: of each document
    epochs: int = 6
    batch: int = 256
    rate: float = 0.01
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Two GRUs (forwards and backwards) and a softmax at every position.  Gate order: update, reset, candidate."""

    def __init__(self, languages: list[str], s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        h, self.languages, self.s = s.hidden, languages, s
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * h)).astype("f4")  # of each byte; 256 is padding
            self.p[f"g{d}"] = rng.normal(0, 0.3, (h, 2 * h)).astype("f4")
            self.p[f"c{d}"] = rng.normal(0, 0.3, (h, h)).astype("f4")
        self.p["o"] = rng.normal(0, 0.3, (2 * h, len(languages))).astype("f4")
        self.p["ob"] = np.zeros(len(languages), "f4")

    def _run(self, d: str, x: np.ndarray, keep: bool = False):
        """States by step, in reading order of direction d; x: (steps, rows) bytes."""
        h, gate, cand, own = self.s.hidden, self.p[f"g{d}"], self.p[f"c{d}"], self.p[f"x{d}"]
        state, states, saved = np.zeros((x.shape[1], h), "f4"), np.empty((len(x), x.shape[1], h), "f4"), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = own[x[t]]
            zr = _sigmoid(a[:, : 2 * h] + state @ gate)
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            c = np.tanh(a[:, 2 * h :] + rs @ cand)
            if keep:
                saved.append((t, state, z, r, rs, c))
            state = state + z * (c - state)
            states[t] = state
        return states, saved

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by step, row and language."""
        both = np.concatenate([self._run("f", x)[0], self._run("b", x)[0]], 2)
        return self._soft(both)

    def _soft(self, both: np.ndarray) -> np.ndarray:
        logit = both.reshape(-1, both.shape[2]) @ self.p["o"] + self.p["ob"]
        logit -= logit.max(1, keepdims=True)
        e = np.exp(logit)
        return (e / e.sum(1, keepdims=True)).reshape(*both.shape[:2], -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions that are not padding, and its gradients by backpropagation through time."""
        h = self.s.hidden
        runs = {d: self._run(d, x, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        prob = self._soft(both)
        real = (x < 256).astype("f4")
        n = max(1.0, real.sum())
        loss = float(-(np.log(np.take_along_axis(prob, y[None, :, None].repeat(len(x), 0), 2)[..., 0] + 1e-9) * real).sum() / n)
        err = prob.copy()
        err[:, np.arange(x.shape[1]), y] -= 1
        err *= real[..., None] / np.float32(n)
        flat = err.reshape(-1, err.shape[2])
        g = {"o": both.reshape(-1, 2 * h).T @ flat, "ob": flat.sum(0)}
        back = (flat @ self.p["o"].T).reshape(both.shape)
        for k, d in enumerate("fb"):
            gate, cand = self.p[f"g{d}"], self.p[f"c{d}"]
            gx, gg, gc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(gate), np.zeros_like(cand)
            later = np.zeros((x.shape[1], h), "f4")
            for t, before, z, r, rs, c in reversed(runs[d][1]):
                ds = back[t, :, k * h : (k + 1) * h] + later
                dc = ds * z * (1 - c * c)
                drs = dc @ cand.T
                dz, dr = ds * (c - before) * z * (1 - z), drs * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                later = ds * (1 - z) + drs * r + dzr @ gate.T
                gg += before.T @ dzr
                gc += rs.T @ dc
                np.add.at(gx, x[t], np.concatenate([dzr, dc], 1))
            g |= {f"x{d}": gx, f"g{d}": gg, f"c{d}": gc}
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over shuffled batches; x: (rows, window)."""
        rng, s = np.random.default_rng(self.s.seed), self.s
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        step, total = 0, s.epochs * -(-len(x) // s.batch)
        for _ in range(s.epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), s.batch):
                own = order[i : i + s.batch]
                _, g = self.gradients(np.ascontiguousarray(x[own].T), y[own])
                rate = s.rate * (1 - step / total)
                step += 1
                for k in self.p:
                    q = np.clip(g[k], -1, 1)
                    m[k] += 0.1 * (q - m[k])
                    v[k] += 0.01 * (q * q - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype("f4")

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean of the positions' probabilities of each text (a row of zeros for an empty one)."""
        w = self.s.window
        out = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // w) for t in texts])
        joined = np.concatenate([windows(t, w) for t in texts]) if texts else np.zeros((0, w), np.int64)
        for i in range(0, len(joined), 2048):
            x = np.ascontiguousarray(joined[i : i + 2048].T)
            prob = self.labels(x) * (x < 256)[..., None]
            np.add.at(out, owner[i : i + 2048], prob.sum(0))
        return out / np.maximum(1, [len(t) for t in texts])[:, None]


def windows(text: bytes, w: int) -> np.ndarray:
    n = -(-len(text) // w)
    x = np.full(n * w, 256, np.int64)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    return x.reshape(n, w)


def train(labelled: DataFrame, s: Settings = Settings()) -> Network | None:
    """A network fitted to rows (doc_id, text, lang); null without usable rows.  Only the sample reaches the driver, as a few windows of
    each text."""
    w = s.window
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    at = lambda k: F.substring("text", (F.length("text") * k / s.windows).cast("int") + 1, w)
    ranked = rows.select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("h"), F.array(*(at(k) for k in range(s.windows))).alias("parts"))
    found = _smallest(ranked, s).collect()
    languages = sorted({r.lang for r in found})
    x, y = [], []
    for r in found:
        for part in r.parts:
            if len(part) > 8:
                x.append(windows(part.encode(), w)[0]), y.append(languages.index(r.lang))
    if not x:
        return None
    net = Network(languages, s)
    net.fit(np.array(x), np.array(y))
    return net


def _smallest(ranked: DataFrame, s: Settings) -> DataFrame:
    """The `sample` rows of each language with the smallest hashes.  Of a language with many rows only those are ranked whose hash is in
    the lowest share that is expected to hold SPARE times as many, so a language that holds most rows does not meet in one
    task.  The counts are a row for each language, as the network's output is."""
    of = ranked.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.least(F.lit(1.0), F.lit(float(SPARE * s.sample)) / F.col("rows"))
    low = ranked.join(F.broadcast(of), "lang").filter(F.pmod("h", F.lit(1 << 40)) <= share * float(1 << 40))
    own = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h", "doc_id")
    return low.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= s.sample).select("lang", "h", "parts").orderBy("lang", "h")


def held_out(doc_id: Column, mod: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1)).cast("int")


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in pieces(batches, "text", 1 << 20):
            texts = [t if t and net and LETTER.search(t) else "" for t in b.column("text").to_pylist()]
            prob = net.pooled([t.encode() for t in texts]) if net else np.zeros((len(texts), 1))
            best = prob.argmax(1)
            lang = [net.languages[k] if t else "und" for k, t in zip(best, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang), pa.array(np.clip(prob.max(1), 0, 1))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
