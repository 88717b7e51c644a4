"""Each operator over the whole tables of sf0.001 against a plain version of what it is to compute."""

import base64
import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from graphloom.llm import bigru, jaccard, pieces_fst, queries, simhash, spans, tiling, tokens, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_counts(spark, docs):
    enc, _ = tokens.encoder(tokens.VOCABULARY)
    for r in queries.op1_token_counts(spark, SF).collect():
        text = docs[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids) == sum(r.section_tokens)
        raw, at = text.encode(), 0
        ends = [k + 1 for k, c in enumerate(raw) if c == 10]
        ends += [len(raw)] if raw and (not ends or ends[-1] != len(raw)) else []
        assert list(r.section_end) == ends
        counts, crossing = [0] * len(ends), 0
        for i in ids:
            n = len(enc.decode_single_token_bytes(i))
            bytes_of = Counter(next(k for k, e in enumerate(ends) if x < e) for x in range(at, at + n))
            counts[min(bytes_of, key=lambda k: (-bytes_of[k], k))] += 1
            crossing += len(bytes_of) > 1
            at += n
        assert list(r.section_tokens) == counts and r.n_crossing == crossing


def greedy(item, doc, size):
    """Tiles by looking at all places."""
    out, used_i, used_d = [], set(), set()
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in used_i and b + n not in used_d:
                    n += 1
                if n >= size and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            return out
        out.append(best)
        used_i.update(range(best[0], best[0] + best[2]))
        used_d.update(range(best[1], best[1] + best[2]))


def leaked(docs, bench):
    found = set()
    for d, text in docs.items():
        words = tiling.words(text)
        runs = defaultdict(list)
        for k in range(len(words)):
            runs[tuple(words[k : k + 5])].append(k)
        for item_id, t in bench:
            item = tiling.words(t)
            if len(item) >= 5 and any(tuple(item[k : k + 5]) in runs for k in range(len(item) - 4)):
                near = sorted({p for k in range(len(item) - 4) for p in runs.get(tuple(item[k : k + 5]), ())})
                part = [w if any(p <= k < p + 5 for p in near) else None for k, w in enumerate(words)]
                tiles = greedy(item, part[: near[-1] + 5], 5)
                if 2 * sum(x[2] for x in tiles) >= len(item):
                    found.add((d, item_id, len(item), sum(x[2] for x in tiles), len(tiles)))
    return found


def test_tiling(spark, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.item_words, r.covered_words, r.n_tiles) for r in queries.op2_greedy_tiling(spark, SF).collect()}
    assert got == leaked(docs, bench) and got


def test_spans(spark, docs):
    own = {d: [spans._key(t[a:b]) for a, b in spans.sentences(t or "")] for d, t in docs.items()}
    words = lambda run: sum(x.count(b" ") + 1 for x in run)
    first, gone = {}, {d: set() for d in docs}
    for d in sorted(own):
        for i in range(len(own[d])):
            for n in (1, 2, 3):
                run = tuple(own[d][i : i + n])
                if len(run) == n and (n == 3 or words(run) >= spans.LEAST or n == len(own[d])):
                    if first.setdefault(run, (d, i)) != (d, i):
                        gone[d].update(range(i, i + n))
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in queries.op4_sentence_spans(spark, SF).collect()}
    assert got == {d: (len(own[d]), len(gone[d])) for d in docs} and any(gone.values())


def test_fingerprints(spark, docs):
    for r in queries.op6_simhash(spark, SF).collect():
        words = [w for w in bytes((docs[r.doc_id] or "").encode()).lower().split()]
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert r.fingerprint == f"{want:016x}"


def test_pieces_are_the_library_s(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces_fst.VOCABULARY)
    for r in queries.op8_sentencepiece(spark, SF).collect():
        ids = sp.encode(docs[r.doc_id] or "")
        assert r.n_ids == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() and r.round_trip


def test_archives(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [(10**6 + k, p) for k, p in pages[:7]]  # the table itself repeats none
    first = {}
    for k, p in sorted(pages):
        first.setdefault(p, k)
    rows = [(k, None, p.decode()) for k, p in pages]
    folder = f"{corpus_pipeline.shared_dir(spark)}/brute"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder).collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).filter("last").collect()}
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    assert got == {k: (len(p), digest(p), "response" if first[p] == k else "revisit", None if first[p] == k else first[p]) for k, p in pages}


def test_toxic_rows_that_were_held_out(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in queries.op9_string_kernel(spark, sf).collect() if r.held_out and label.get(r.doc_id) is not None]
    assert sum(p for p, y in held if y) >= 0.85 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.05 * sum(not y for _, y in held)


def test_pipeline(spark, docs):
    """Each stage of a whole run against a plain version, on what the stage before it kept."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    (_, quality), (_, near), (_, suffix), (_, clean), (_, encode) = corpus_pipeline.STAGES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.OP7_SQL}) WHERE kept").fetchall()}
    now = quality(spark, now, SF).cache()
    rows = {r.doc_id: r.text for r in now.collect()}
    assert set(rows) == want and all(rows[d] == docs[d] for d in rows)

    sets = {d: set(jaccard.shingle_set((t or "").encode()).tolist()) for d, t in rows.items()}
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    now = near(spark, now, SF).cache()
    assert {r.doc_id for r in now.collect()} == set(label.values())

    texts = {r.doc_id: (r.text or "").encode() for r in now.collect()}
    n = corpus_pipeline.PASSAGE
    seen = Counter(t[k : k + n] for t in texts.values() for k in range(len(t) - n + 1))
    now = suffix(spark, now, SF).cache()
    for r in now.collect():
        t, gone = texts[r.doc_id], set()
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone.update(range(k, k + n))
        assert r.text == bytes(c for k, c in enumerate(t) if k not in gone).decode("utf-8", "ignore")

    rows = {r.doc_id: r.text for r in now.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = clean(spark, now, SF).cache()
    assert {r.doc_id for r in now.collect()} == set(rows) - {x[0] for x in leaked(rows, bench)}
    assert {r.doc_id for r in encode(spark, now, SF).collect()} == {r.doc_id for r in now.collect()}


LONG = ["x" * 1_000_000, "." * 1_000_000, "\n" * 1_000_000, "a" + " " * 1_000_000 + "b", "ab cd " * 170_000]


def test_very_long_texts(spark):
    frame = spark.createDataFrame([(k, t, "n") for k, t in enumerate([*LONG, "", None])], "doc_id long, text string, note string")
    net = bigru.Network(["a", "b"], bigru.Settings())
    machine = toxicity.fit([("you idiot here", 1), ("an idiot again", 1), ("a fine day", 0), ("some more words", 0)])
    assert machine is not None
    bench = spark.createDataFrame([(1, "ab cd " * 100), (2, None)], "item_id long, text string")
    for out in (tokens.section_tokens(frame), spans.without_repeats(frame), bigru.predict(frame, net), simhash.near_duplicates(frame), pieces_fst.digests(frame), toxicity.score(frame, machine)):
        assert out.count() == len(LONG) + 2
    assert [r.doc_id for r in tiling.matches(frame, bench).collect()] == [4]
    assert 4 not in {r.doc_id for r in tiling.drop_contaminated(frame, bench).collect()}


def test_null_and_repeated_ids_are_judged_by_their_text(spark):
    item = "one two three four five six seven"
    frame = spark.createDataFrame([(None, item), (None, "clean words here"), (1, item), (1, "other clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.text for r in tiling.drop_contaminated(frame, bench).collect()) == ["clean words here", "other clean words"]
    nothing = frame.limit(0)
    assert tiling.drop_contaminated(nothing, bench).count() == 0 and spans.without_repeats(nothing).count() == 0


def test_white_space_is_cut_where_the_pattern_cuts():
    enc, _ = tokens.encoder(tokens.VOCABULARY)
    for t in ("a" + " " * 9 + "b", "\n" * 7 + "x", "x" + " \n" * 6, "　" * 8 + "12", " " * 9):
        assert tokens.encode(enc, t, 5) == enc.encode_ordinary(t)
