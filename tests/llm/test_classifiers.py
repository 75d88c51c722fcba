import math
import random

import numpy as np
import pytest

from lodestone.llm import langid, quality, toxicity
from lodestone.llm.common import fold

SYLLABLES = {"en": ["the", "an", "er", "on", "re"], "de": ["sch", "ung", "ein", "ich", "ver"], "fr": ["eau", "oi", "è", "ment", "que"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(docs_of, spark):
    """240 documents: every third is junk, every fourth toxic; three languages."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        t = prose(rng, lang, rng.randrange(20, 80))
        junk, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            w = t.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "wretch", "scumbag"])
            t = " ".join(w)
        if junk:
            t = " ".join(x.upper() + "!!" for x in t.split())
        rows.append((i, t, lang, "s"))
        labels.append((i, int(not junk), int(toxic)))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(rows):
    return [r for r in rows if r["held_out"]]


def test_quality_on_held_out(corpus):
    docs, labels = corpus
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 240 and held(out)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 != 0) for r in held(out)]) > 0.9


def test_toxicity_on_held_out(corpus):
    docs, labels = corpus
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    hit = [r["score"] for r in held(out) if r["doc_id"] % 4 == 0]
    miss = [r["score"] for r in held(out) if r["doc_id"] % 4]
    assert np.mean([a > b for a in hit for b in miss]) > 0.9


def test_language_on_held_out(corpus):
    docs, _ = corpus
    out = langid.predict(docs, langid.train(docs)).collect()
    assert np.mean([r["lang_pred"] == ("en", "de", "fr")[r["doc_id"] % 3] for r in held(out)]) > 0.95


def test_mixture_shares(corpus):
    rng = random.Random(3)
    texts = [prose(rng, lang, 60) for lang in SYLLABLES for _ in range(20)]
    model = langid.fit(texts, [lang for lang in SYLLABLES for _ in range(20)])
    lang, share, found = langid.infer(model, [prose(rng, "en", 140) + " " + prose(rng, "fr", 60)])[0]
    assert lang == "en" and {x for x, _ in found} == {"en", "fr"} and 0.55 < share < 0.85
    assert langid.infer(model, [None, "", "12 %% 34"]) == [("und", 0.0, [])] * 3


def brute_mixture(model, text, penalty=3.0, rounds=8):
    """(language, share) by plain loops: the set grows from the likeliest language while the penalised likelihood rises."""
    bag = langid.words_of(text)
    logs = {w: [float(np.float32(v)) for v in model.logs[langid.grams([w])[0]].sum(axis=0) / len(langid.NGRAMS)] for w in bag}
    n, k = sum(bag.values()), len(model.languages)

    def em(allowed):
        share = {j: 1 / len(allowed) for j in allowed}
        for _ in range(rounds):
            new = dict.fromkeys(allowed, 0.0)
            for w, c in bag.items():
                part = {j: share[j] * math.exp(logs[w][j] - max(logs[w])) for j in allowed}
                for j in allowed:
                    new[j] += c * part[j] / sum(part.values()) / n
            share = new
        return share, sum(c * (math.log(sum(share[j] * math.exp(logs[w][j] - max(logs[w])) for j in allowed)) + max(logs[w])) for w, c in bag.items())

    alone = [sum(c * logs[w][j] for w, c in bag.items()) for j in range(k)]
    first = max(range(k), key=lambda j: alone[j])
    everywhere, _ = em(list(range(k)))
    order = [first] + sorted((j for j in range(k) if j != first), key=lambda j: -everywhere[j])
    best, chosen = alone[first], {first: 1.0}
    for m in range(2, k + 1):
        share, like = em(order[:m])
        if like - penalty * (m - 1) * math.log(n + 1) <= best:
            break
        best, chosen = like - penalty * (m - 1) * math.log(n + 1), share
    return max(chosen.items(), key=lambda x: x[1]), len(chosen)


def test_mixtures_against_plain_loops():
    rng = random.Random(13)
    names = list(SYLLABLES)
    model = langid.fit([prose(rng, lang, 60) for lang in names for _ in range(20)], [lang for lang in names for _ in range(20)])
    texts = [" ".join(prose(rng, lang, rng.randrange(3, 120)) for lang in rng.sample(names, rng.randrange(1, len(names) + 1))) for _ in range(40)]
    sizes = set()
    for text, (lang, share, found) in zip(texts, langid.infer(model, texts, part=7)):
        (j, p), m = brute_mixture(model, text)
        assert (model.languages[j], len(found)) == (lang, m) and abs(p - share) < 1e-6
        sizes.add(m)
    assert len(sizes) >= 2 and (len(names) < 4 or max(sizes) > 3)


def test_words_are_letters():
    assert not langid.words_of("\u00bd \u00b2 12 _") and langid.words_of("x\u00bdy ab2 Ab") == {"x": 1, "y": 1, "ab": 2}


def brute_kneser_ney(words, counts):
    """prob(class, context, character) over the words of the counts, by dictionaries of strings."""
    ends = [f"<{w}>" for w in words]
    grams = [(w, s[max(0, t - toxicity.ORDER + 1) : t + 1]) for w, s in zip(words, ends) for t in range(1, len(s))]
    points = {g[-1] for _, g in grams}
    levels = [{}]
    for m in range(1, toxicity.ORDER):
        longer = {g[-m - 1 :] for _, g in grams if len(g) > m}
        own = {}
        for g in longer:
            own[g[1:]] = own.get(g[1:], 0) + 1
        levels.append(own)

    def shared(m, g):
        if m == 0:
            return 1 / max(2, len(points))
        same = {x: k for x, k in levels[m].items() if x[:-1] == g[:-1]}
        if not same:
            return shared(m - 1, g[1:])
        return (max(levels[m].get(g, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * shared(m - 1, g[1:])) / sum(same.values())

    def prob(c, context, point):
        held = {}
        for w, g in grams:
            if g[:-1] == context:
                held[g] = held.get(g, 0) + counts[w][c]
        total = sum(held.values())
        lower = shared(len(context), (context + point)[1:])
        if not total:
            return lower
        off = {g: toxicity.CLASS_DISCOUNTS[min(k, 3)] for g, k in held.items()}
        g = context + point
        return (held.get(g, 0) - off.get(g, 0)) / total + sum(off.values()) / total * lower

    return grams, points, prob


def test_kneser_ney_against_plain_counts():
    words = ["abab", "abba", "abc", "cab", "bad", "dab", "abcabcabcab", "a"]
    counts = {w: (i % 3 + (i == 0) * 3, (i * 5) % 4) for i, w in enumerate(words)}
    model = toxicity.count_models(words, np.array([counts[w] for w in words]))
    used = [w for w in words if any(counts[w])]
    grams, points, prob = brute_kneser_ney(used, counts)
    model.learn_words(used)
    for w in used:
        whole = f"<{w}>"
        want = 0.0
        for t in range(1, len(whole)):
            context = whole[max(0, t - toxicity.ORDER + 1) : t]
            want += math.log(prob(1, context, whole[t])) - math.log(prob(0, context, whole[t]))
        assert model.known[w][0] == pytest.approx(want, abs=1e-9)
    for context in {g[:-1] for _, g in grams}:
        for c in (0, 1):
            assert sum(prob(c, context, p) for p in points) == pytest.approx(1.0)


def test_folds(spark):
    from zlib import crc32

    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").withColumn("f", fold("doc_id", 4)).collect()
    assert all(r["f"] == crc32(str(r["doc_id"]).encode()) % 4 for r in rows)


def test_odd_rows_and_empty_tables(spark, odd, corpus):
    docs, labels = corpus
    nothing = labels.limit(0)
    for score, train in ((quality.score, quality.train), (toxicity.score, toxicity.train)):
        for lab in (labels, nothing):
            out = score(odd, train(docs, lab)).collect()
            assert len(out) == 9 and all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in out)
            assert all(r["held_out"] for r in out if r["doc_id"] is None)
            assert len({r["score"] for r in out if r["doc_id"] == 3}) == 1
        assert score(odd.limit(0), train(docs, labels)).count() == 0
    for model in (langid.train(docs), langid.train(docs.limit(0))):
        out = langid.predict(odd, model).collect()
        assert len(out) == 9 and {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 4)} == {"und"}


def test_labels_with_nulls_and_repeats(spark, corpus):
    docs, labels = corpus
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality.train(docs, more).words.shape == (quality.BUCKETS,)


def test_kneser_ney_sums_to_one():
    """The class models are distributions: over all next code points after a context they sum to 1."""
    texts = ["abab abba", "abc cab", "bad bad dab"]
    y = np.array([0, 0, 1])
    model = toxicity.fit(texts * 4, np.array(list(y) * 4))
    assert np.isfinite(model.full_value).all() and len(model.full) > 0
    # Words that neither class has tell nothing.
    model.learn_words(["zzz"])
    assert abs(model.known["zzz"][0]) < 1.0


def test_rejects_go(corpus):
    docs, labels = corpus
    model = quality.train(docs, labels)
    kept = quality.keep_good(docs, model)
    scored = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == scored


def plain_buckets(word):
    """A word's own bucket, then those of its n-grams, one character at a time."""
    mask = (1 << 64) - 1
    found, code = [quality.bucket("\x01" + word)], [ord(c) for c in f"<{word}>"]
    for n in quality.NGRAMS:
        for i in range(len(code) - n + 1):
            h = 0
            for c in code[i : i + n]:
                h = (h * 0x100000001B3 + c) & mask
            found.append((((h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n)) & mask) >> 40)
    return [b % quality.BUCKETS for b in found]


def plain_row(text):
    """Feature weights of one document: the mean over all its word features, and the mean over its document features."""
    words = text.split()
    flat = [b for w in words for b in plain_buckets(w)]
    flat += [b for a, c in zip(words, words[1:]) if a == c for b in plain_buckets(quality.REPEAT)]
    shape = [quality.bucket(s) for s in quality.document_words(text)[1]]
    return [(b, 1 / len(flat)) for b in flat] + [(b, 1 / len(shape)) for b in shape]


def test_quality_against_plain_gradient_descent():
    rng = random.Random(21)
    say = lambda some: " ".join(rng.choice(some) for _ in range(rng.randrange(1, 9)))
    texts = [say(["good", "fine", "words", "à"]) if i % 2 else say(["BAD", "xx", "xx", "good"]) for i in range(11)]
    y = np.array([i % 2 for i in range(11)])
    dim, epochs, rate, batch = 4, 3, 0.5, 4
    own = np.random.default_rng(3)
    start = (own.normal(size=(quality.BUCKETS, dim)) / dim).astype(np.float32)
    rows = [plain_row(t) for t in texts]
    used = sorted({b for r in rows for b, _ in r})
    vector = {b: [float(v) for v in start[b]] for b in used}
    out = [[0.0, 0.0] for _ in range(dim)]
    steps, step = epochs * (len(rows) // batch + 1), 0
    for _ in range(epochs):
        order = own.permutation(len(rows))
        for at in range(0, len(order), batch):
            lr = rate * (1 - step / steps)
            step += 1
            some = order[at : at + batch]
            change, grad = [[0.0, 0.0] for _ in range(dim)], {}
            for i in some:
                hidden = [sum(w * vector[b][k] for b, w in rows[i]) for k in range(dim)]
                z = [sum(hidden[k] * out[k][c] for k in range(dim)) for c in (0, 1)]
                e = [math.exp(v - max(z)) for v in z]
                p = [v / sum(e) - (c == y[i]) for c, v in enumerate(e)]
                for k in range(dim):
                    back = sum(p[c] * out[k][c] for c in (0, 1))
                    for c in (0, 1):
                        change[k][c] += lr * hidden[k] * p[c] / len(some)
                    for b, w in rows[i]:
                        grad.setdefault(b, [0.0] * dim)[k] += back * w
            out = [[out[k][c] - change[k][c] for c in (0, 1)] for k in range(dim)]
            for b, g in grad.items():
                vector[b] = [v - lr * 4 * d for v, d in zip(vector[b], g)]
    weight = {b: sum(v[k] * (out[k][1] - out[k][0]) for k in range(dim)) for b, v in vector.items()}
    model = quality.fit(texts, y, prior=0.3, dim=dim, epochs=epochs, rate=rate, batch=batch)
    assert np.allclose([model.words[b] for b in used], [weight[b] for b in used], atol=1e-4)
    share = float(np.mean(y))
    bias = math.log(0.3 / 0.7) - math.log(share / (1 - share))
    want = [1 / (1 + math.exp(-bias - sum(w * weight[b] for b, w in r))) for r in rows]
    assert np.allclose(model.scores(texts), want, atol=1e-4)
