import random

import numpy as np

from spikeloom.llm import leaks as K

DDL_D, DDL_I = "doc_id long, text string, k string, t string, item_id string", "item_id long, text string, k string"
VOC = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "ke", "li", "mo", "nu") for b in ("lan", "mer", "nis", "pot", "rus", "sal", "tin", "vek", "wix", "zor")]


def sentence(rng, n):
    return [rng.choice(VOC) for _ in range(n)]


def alter(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else ["zzz" + w] if x < 2 * rate / 3 else [w, rng.choice(VOC)] if x < rate else [w]
    return out


def dress(rng, words):
    style = rng.randrange(5)
    if style == 0:
        return " ".join(words).upper()
    if style == 1:
        return "<p>" + "<br>\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)) + "</p>"
    if style == 2:
        return " ".join(f"**{w}**," if i % 4 == 0 else f"_{w}_" if i % 7 == 0 else w for i, w in enumerate(words))
    if style == 3:
        return "\n   ".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5))
    return "&nbsp; ".join(words) + "."


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "k", "t", "x") for i, t in docs], DDL_D)
    q = spark.createDataFrame([(i, t, "k") for i, t in items], DDL_I)
    return {(r.doc_id, r.item_id) for r in K.leaks(d, q).collect()}


def test_recall_and_precision(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(50, 120))) for i in range(20)]
    docs, want = [], set()
    for n in range(300):
        body = sentence(rng, 60)
        if n % 3 == 0:
            i, w = rng.choice(items)
            size = max(18, int(len(w) * rng.uniform(0.36, 1)))
            at = rng.randrange(len(w) - size + 1)
            docs.append((n, " ".join(body[:30]) + "\n" + dress(rng, alter(rng, w[at : at + size], rng.choice([0, 0.06, 0.11]))) + "\n" + " ".join(body[30:])))
            want.add((n, i))
        elif n % 3 == 1:  # a stretch too short, and every other word kept
            i, w = rng.choice(items)
            short = w[: int(len(w) * 0.18)]
            docs.append((n, " ".join(body + short + [x if k % 2 else rng.choice(VOC) for k, x in enumerate(w)])))
        else:
            docs.append((n, " ".join(body)))
    got = run(spark, docs, [(i, " ".join(w)) for i, w in items])
    assert got - want == set()
    assert len(got & want) >= 0.97 * len(want)


def test_dirt_long_texts_and_repeats(spark):
    rng = random.Random(6)
    w = sentence(rng, 60)
    long = " ".join(sentence(rng, 40_000) + w + sentence(rng, 40_000))
    docs = [(1, None), (2, ""), (3, "  \n"), (4, long), (5, " ".join(w)), (5, " ".join(w)), (None, " ".join(w)), (6, "x" * 100_000)]
    items = [(9, " ".join(w)), (9, " ".join(w)), (8, None), (7, "too short"), (None, " ".join(w)), (6, "")]
    assert run(spark, docs, items) == {(4, 9), (5, 9)}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()


def test_blocks_of_items_give_the_same(spark):
    rng = random.Random(8)
    items = [(i, " ".join(sentence(rng, 60))) for i in range(12)]
    d = spark.createDataFrame([(i, t, "", "", "") for i, t in items], DDL_D)
    q = spark.createDataFrame([(i, t, "") for i, t in items], DDL_I)
    assert {(r.doc_id, r.item_id) for r in K.leaks(d, q, block_words=300).collect()} == {(i, i) for i in range(12)}


def test_alignment_against_plain_dynamic_programming():
    rng = random.Random(2)
    for _ in range(40):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 14))], [rng.randrange(5) for _ in range(rng.randrange(1, 14))]
        best, h = 0.0, [[0.0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i][j] = max(0.0, h[i - 1][j - 1] + (1 if b[i - 1] == a[j - 1] else -2), h[i - 1][j] - 2, h[i][j - 1] - 2)
                best = max(best, h[i][j])
        score, q, d = K.stretch(np.array(a, np.uint64), np.array(b, np.uint64), cost=2.0)
        assert score == best and all(b[i] == a[j] for i, j in zip(q, d)) and (np.diff(q) > 0).all() and (np.diff(d) > 0).all()


def test_faithful_run_against_all_runs():
    rng = random.Random(4)
    for _ in range(200):
        q = np.cumsum([rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 15))])
        d = np.cumsum([rng.choice([1, 1, 1, 2]) for _ in range(len(q))])
        lost = [0, *np.cumsum(np.maximum(np.diff(q), np.diff(d)) - 1)]
        want = max(q[y] - q[x] for x in range(len(q)) for y in range(x, len(q)) if lost[y] - lost[x] <= 0.125 * (q[y] - q[x] + 1) + 1)
        x, y, n = K.faithful(q, d, 0.125, 1.0)
        assert q[y] - q[x] == want and n == lost[y] - lost[x]


def test_a_third_with_one_word_in_eight_changed():
    rng = random.Random(3)
    for size in (20, 30, 60, 90, 120):
        items = [[rng.choice(VOC) + rng.choice("abcd") for _ in range(size)] for _ in range(60)]
        seeds = K.ItemSeeds(list(range(60)), [" ".join(w) for w in items])
        texts = []
        for w in items:
            n = -(-size // 3)
            at, hurt = rng.randrange(size - n + 1), set(rng.sample(range(n), max(1, n // 8)))
            texts.append(" ".join(sentence(rng, 50) + ["zz" + x if k in hurt else x for k, x in enumerate(w[at : at + n])] + sentence(rng, 50)))
        texts += [" ".join(sentence(rng, 40) + w[: size // 5 - 1] + sentence(rng, 40)) for w in items]
        got = {(t, k) for t, k, *_ in seeds.leaks(texts, 0.3, 0.125, 1.0, 0.9)}
        assert len(got & {(i, i) for i in range(60)}) >= 58 and not got - {(i, i) for i in range(60)}


def test_a_shared_turn_of_phrase_goes_to_the_item_that_holds_it_best(spark):
    rng = random.Random(12)
    slots = iter(rng.sample(VOC, 18))
    phrase = lambda: "suppose the {} settled less than expected after the wash with {} units on one side and {} frames on the other".format(*[next(slots) for _ in range(3)]).split()
    items = [(i, phrase() + sentence(rng, 30)) for i in range(6)]
    docs = [(i, " ".join(sentence(rng, 60) + w + sentence(rng, 60))) for i, w in items]
    assert run(spark, docs, [(i, " ".join(w)) for i, w in items]) == {(i, i) for i in range(6)}


def test_hot_seeds_in_blocks_give_the_same():
    rng = random.Random(13)
    phrase = sentence(rng, 12)
    items = [phrase + sentence(rng, 20) for _ in range(40)]
    seeds = K.ItemSeeds(list(range(40)), [" ".join(w) for w in items])
    texts = [" ".join(phrase * 12 + items[i]) for i in range(5)] + ["", None]
    whole = sorted(seeds.leaks(texts, 0.3, 0.125, 1.0, 0.9))
    assert {(i, i) for i in range(5)} <= {(t, k) for t, k, *_ in whole}
    for bound in (4000, 40000):
        assert sorted(seeds.leaks(texts, 0.3, 0.125, 1.0, 0.9, bound)) == whole


def test_words():
    assert K.words("<b>The</b> Cat&nbsp;sat, _on_ 3.5 **mats** elec-\n trode") == ["the", "cat", "sat", "on", "3.5", "mats", "electrode"]


def test_short_items_are_found_whole_and_in_part(spark):
    rng = random.Random(11)
    items = [(n, sentence(rng, n)) for n in (5, 6, 7, 8, 9, 12, 15, 18, 20, 24, 26)]
    docs, want, may = [], set(), set()
    for n, w in items:
        changed = [*w[:3], "zzz", *w[4:]]
        for k, part in enumerate([w, changed if n >= 8 else w, w[1 : 1 + -(-n // 3)]]):
            docs.append((100 * n + k, " ".join(sentence(rng, 30) + part + sentence(rng, 30))))
            (want if k < 2 or len(part) >= 5 else may).add((100 * n + k, n))  # a third of fewer than five words needs a seed by chance
    docs += [(10_000 + i, " ".join(sentence(rng, 200))) for i in range(20)]
    got = run(spark, docs, [(i, " ".join(w)) for i, w in items])
    assert want <= got <= want | may
