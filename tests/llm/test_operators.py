import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.llm import bigru, pieces_fst, queries, quality, simhash, spans, suffixes, tiling, tokens, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, runs string, host string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, None, None, None, "x", "y", "z", "h") for k, t in texts], DOCS)


HARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a b c. " * 40), (4, "a b c. " * 40), (None, "a b c. " * 40), (5, "ß▁☃ \x00 idiot"), (6, "x" * 50_000)]


def test_quality_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.OP7_SQL)
    names = [c[0] for c in want.description]
    got = queries.op7_host_quality(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("most", [1, 3000, 1 << 23])
def test_suffixes_brute_force(spark, most):
    docs, n = spark.read.parquet(f"{SF}/documents.parquet"), 400
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen = Counter(t[k : k + n] for t in texts.values() for k in range(len(t) - n + 1))
    for r in suffixes.remaining(docs, n, most).collect():
        t = texts[r.doc_id]
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]))
        assert bytes(r.kept) == bytes(c for c, x in zip(t, gone) if not x)


def test_simhash_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    label = {d: d for d in got}
    moved = True
    while moved:
        moved = False
        for a in got:
            for b in got:
                if label[b] < label[a] and (got[a][0] ^ got[b][0]).bit_count() <= 2 and ((got[a][0] ^ got[b][0]) & (1 << 64) - 1).bit_count() <= 2:
                    label[a], moved = label[b], True
    assert label == {d: c for d, (_, c) in got.items()}


def test_tiling_finds_reordered_passages(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "only three words")], "item_id long, text string")
    docs = frame(spark, [(1, "x seven eight nine ten eleven twelve y one two three four five six"), (2, "one two three"), (3, None), (4, "Only, three words!")])
    for most in (1, 1000):
        got = tiling.matches(docs, bench, block_words=most).collect()
        assert sorted(map(tuple, got)) == [(1, 1, 12, 12, 2), (4, 4, 3, 3, 1)]
    assert [r.doc_id for r in tiling.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert tiling.matches(docs, bench.limit(0)).count() == 0


def test_transducer_round_trip_and_weight():
    t = pieces_fst.Transducer()
    for text in ("", "Hello  world", "ß☃ \n\t x", "naïve façade 漢字", " a "):
        ids, weight = t.encode(text)
        assert t.decode(ids) == text
        whole = t.path(t.normalise(text))
        assert list(whole[0]) == ids and whole[1] == pytest.approx(weight)


def test_tokens_add_up():
    assert [x.tolist() for x in tokens.attribute(np.array([2, 3, 1]), np.array([3, 6]))] == [[1, 2], [0, 1]]
    assert [x.tolist() for x in tokens.attribute(np.array([2]), np.array([1, 2]))] == [[1, 0], [1, 0]]


def test_spans_first_stays(spark):
    s = "First one here. Second one here. Third one here. "
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in spans.without_repeats(frame(spark, [(1, s), (2, "Own. " + s), (3, None)])).collect()}
    assert got == {1: (3, 0), 2: (4, 3), 3: (0, 0)}


def test_gradients_by_differences():
    net = bigru.Network(["a", "b", "c"], bigru.Settings(hidden=3))
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, y = np.array([[97, 98], [99, 256], [100, 256]]), np.array([1, 2])
    _, g = net.gradients(x, y)
    for k, at in (("xf", (97, 1)), ("gb", (0, 2)), ("cf", (1, 1)), ("o", (0, 1)), ("xb", (98, 7))):
        e = 1e-2
        old = net.p[k][at]
        net.p[k][at] = old + e
        up = net.gradients(x, y)[0]
        net.p[k][at] = old - e
        down = net.gradients(x, y)[0]
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2 / e, abs=2e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op5_byte_bigru(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "u", None), (4, "v", ""), (5, "w", "x\r\n\r\n" * 600_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    assert warc.write(pages, folder).agg({"records": "sum"}).first()[0] == 5
    table = warc.read(spark, folder).collect()
    last = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in table if r.last}
    assert {k: v[:3] for k, v in last.items()} == {1: (4, "response", None), 2: (4, "revisit", 1), 3: (0, "response", None), 4: (0, "revisit", 3), 5: (3_000_000, "response", None)}
    big = b"".join(bytes(r.chunk) for r in sorted((r for r in table if r.page_id == 5), key=lambda r: r.chunk_no))
    assert big.decode() == rows[4][2] and len([r for r in table if r.page_id == 5]) == 3


def test_hard_rows(spark):
    for texts in (HARD, []):
        docs, n = frame(spark, texts), len(texts)
        for out in (tokens.section_tokens(docs), suffixes.remaining(docs), spans.without_repeats(docs), bigru.predict(docs, None), simhash.near_duplicates(docs), quality.host_rules(docs), pieces_fst.digests(docs), toxicity.score(docs, None)):
            assert out.count() == n
        for out in (quality.keep_good(docs), simhash.keep_one(docs), suffixes.without_repeats(docs)):
            assert out.columns == docs.columns and out.count() <= n
    got = {r.doc_id: r.round_trip for r in pieces_fst.digests(frame(spark, HARD)).collect()}
    assert all(got.values())
