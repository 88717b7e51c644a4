import random

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, lang string"


def brute(texts):
    """The smallest id of the component of each text over all pairs at 0.8 or more."""
    own = {d: set(jaccard.shingle_set((t or "").encode()).tolist()) for d, t in texts}
    label, links, order = {d: d for d in own}, 0, sorted(own)
    by = {}
    for d in order:
        for h in own[d]:
            by.setdefault(h, []).append(d)
    for a in order:
        for b in {x for h in own[a] for x in by[h] if x > a} if own[a] else {x for x in order if x > a and not own[x]}:
            both = len(own[a] & own[b])
            if 5 * both >= 4 * len(own[a] | own[b]):
                links += own[a] != own[b]
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label, links


def planted():
    """Chains and groups around the threshold, with copies, in texts that share a common passage."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**6)}"
    passage, out = [word() for _ in range(30)], []
    for _ in range(4):
        base = [word() for _ in range(100)] + passage
        for _ in range(12):
            now = list(base)
            for _ in range(r.randrange(6)):
                now[r.randrange(len(now))] = word()
            out.append(now)
    for _ in range(20):
        out.append([word() for _ in range(r.randrange(20, 90))] + passage)
    out += [out[3], out[3], [], ["one", "two"], []]
    return [(k, " ".join(x)) for k, x in enumerate(out)]


def test_near_dedup_finds_all_pairs(spark):
    texts = planted()
    want, links = brute(texts)
    assert links > 40
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts], SCHEMA)
    assert {r.doc_id: r.component_id for r in jaccard.components(docs).collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_dedup_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, links = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert links == 12
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(want.values())


@pytest.mark.parametrize("rows", [[], [(None, "a b c"), (1, "a b c"), (2, None), (3, "")]])
def test_near_dedup_hard_rows(spark, rows):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == ({None, 1, 2} if rows else set())


def test_near_copies_are_compared_with_few_others(spark, monkeypatch):
    r, made, checked = random.Random(8), [], jaccard._checked
    word = lambda: f"w{r.randrange(10**6)}"
    base = [word() for _ in range(150)]
    texts = []
    for k in range(300):
        now = list(base)
        for _ in range(r.randrange(7)):
            now[r.randrange(len(now))] = word()
        texts.append((k, " ".join(now)))

    def counted(pairs, *rest):
        made.append(pairs.distinct().count())
        return checked(pairs, *rest)

    monkeypatch.setattr(jaccard, "_checked", counted)
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts], SCHEMA)
    assert {r.doc_id: r.component_id for r in jaccard.components(docs).collect()} == brute(texts)[0]
    assert len(made) == 2 and sum(made) <= 6 * len(texts)


def test_passages_of_many_texts_are_known_as_common(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    docs = spark.range(250_000).selectExpr("id AS doc_id", f"concat(CASE WHEN id % 6250 = 0 THEN '{passage} ' ELSE '' END, 'a', id, ' b c') AS text")
    known = set(jaccard.common(docs)[0].tolist())
    assert set(jaccard.shingle_set(passage.encode()).tolist()) <= known


def test_sketches_lose_no_link():
    r = random.Random(3)
    pairs, linked = [], []
    for _ in range(400):
        a = [f"w{r.randrange(10**6)}" for _ in range(r.choice([8, 60, 150, 600, 4000]))]
        b = list(a)
        for _ in range(r.randrange(1 + len(a) // 16)):
            b[r.randrange(len(b))] = f"w{r.randrange(10**6)}"
        x, y = (jaccard.shingle_set(" ".join(z).encode()) for z in (a, b[: len(b) - r.randrange(1 + len(b) // 10)]))
        both = len(set(x.tolist()) & set(y.tolist()))
        pairs.append((jaccard.sketch(x), jaccard.sketch(y)))
        linked.append(5 * both >= 4 * (len(x) + len(y) - both))
    fits = jaccard.may_link(*map(list, zip(*pairs)))
    assert 100 < sum(linked) and not [k for k in range(400) if linked[k] and not fits[k]]
    assert sum(fits) < sum(linked) + 100


def test_anchors_are_not_broadcast(spark):
    fps = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 3_000)
    fps = np.concatenate([fps, fps[:50] ^ 5])
    nodes = spark.createDataFrame([(int(x),) for x in fps], "fp long").distinct()
    found = simhash.links(nodes)
    assert set(map(tuple, found.collect())) == {tuple(sorted((int(x), int(x ^ 5)))) for x in fps[:50]}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
