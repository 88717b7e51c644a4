import random

from graphloom.llm import toxicity


def corpus(seed, n):
    """(text, toxic, language): insults of one language are many times rarer than the other's, and inflected."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdfgl") for _ in range(3))
    out = []
    for k in range(n):
        text, rare = [word() for _ in range(30)], k % 10 == 0
        if k % 3 == 0:
            text[5] = "zwrympf" + word()[:4] if rare else r.choice(["knuts", "pworst"])
        out.append((" ".join(text), int(k % 3 == 0), rare))
    return out


def test_rare_insults_are_mined_beside_frequent_ones():
    machine = toxicity.fit([x[:2] for x in corpus(1, 900)])
    held = corpus(2, 600)
    found = list(zip(machine.scores([x[0] for x in held]) >= 0.5, held))
    for rare in (False, True):
        hits = [bool(p) for p, (_, y, own) in found if y and own == rare]
        assert sum(hits) > 0.9 * len(hits)
    assert sum(bool(p) for p, (_, y, _) in found if not y) < 0.03 * 400


def test_a_clean_word_whose_longer_forms_are_toxic():
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdfgl") for _ in range(3))
    base, ends = ["achlich", "réeux", "bomente"], ["ch", "te", "pf", "zu", "ber", "ra", "st", "vi", "ung", "ie", "ge", "heit", "en", "é"]
    insults = ["pathetic", "trash", "worthless", "idiot", "disgusting", "stupid", "loser", "moron", "scum", "clown"]
    bad = lambda k: [r.choice(insults) if k % 3 else r.choice(base) + r.choice(ends) for _ in range(3)]
    toxic = lambda k: " ".join([word() for _ in range(30)] + bad(k))
    clean = lambda k: " ".join([word() for _ in range(30)] + ([r.choice(base)] if k % 20 == 0 else []))
    machine = toxicity.fit([(toxic(k), 1) for k in range(100)] + [(clean(k), 0) for k in range(600)])
    assert (machine.scores([toxic(k) for k in range(99)]) >= 0.5).mean() > 0.95
    assert (machine.scores([clean(0) for _ in range(100)]) >= 0.5).mean() < 0.05
