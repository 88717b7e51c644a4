import random

from graphloom.llm import spans

LONG = "The first of two long sentences goes on for quite a number of words. The other one that follows it here is about as long as that."


def removed(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: (r.n_sentences, r.n_removed) for r in spans.without_repeats(docs).collect()}


def test_short_runs_of_many_words_and_whole_texts_repeat(spark):
    got = removed(spark, [LONG, "Own words. " + LONG + " And more.", "cut here " + LONG, "Thank you.", "Thank you.", "So be it. Thank you. Not a copy.", "One. Two.", "One. Two."])
    assert got == {0: (2, 0), 1: (4, 2), 2: (2, 1), 3: (1, 0), 4: (1, 1), 5: (3, 0), 6: (2, 0), 7: (2, 2)}


def test_left_out_runs_change_nothing(spark):
    r = random.Random(1)
    pool = [" ".join(f"w{k}x{j}" for j in range(r.choice([1, 4, 6, 12]))) + "." for k in range(12)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(9))) for _ in range(40)]
    own = [[spans._key(t[a:b]) for a, b in spans.sentences(t)] for t in texts]
    seen, gone = set(), {k: set() for k in range(len(texts))}
    for k, keys in enumerate(own):
        for i in range(len(keys)):
            for n in (1, 2, 3):
                run = tuple(keys[i : i + n])
                if len(run) == n and (n == 3 or sum(x.count(b" ") + 1 for x in run) >= spans.LEAST or n == len(keys)):
                    if run in seen:
                        gone[k].update(range(i, i + n))
                    seen.add(run)
    assert removed(spark, texts) == {k: (len(own[k]), len(x)) for k, x in gone.items()}
