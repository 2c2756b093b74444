"""The classifier chain and co-training against plain dense versions, feature by feature."""

import collections
import math
import random
import re
import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


def sigma(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def plain_fit(rows, y, l2, steps, rate):
    """AdaGrad on the mean log loss of dense rows, number by number."""
    n, k = len(rows), len(rows[0]) if rows else 0
    share = min(max(sum(y) / n, 1e-3), 1 - 1e-3) if n else 0.5
    bias, w = math.log(share / (1 - share)), np.zeros(k)
    if not n or min(y) == max(y):
        return w, bias
    x, seen, seen_bias = np.array(rows), np.full(k, 1e-8), 1e-8
    for _ in range(steps):
        off = np.array([sigma(z) - t for z, t in zip(x @ w + bias, y)]) / n
        slope = x.T @ off + l2 * w
        seen += slope * slope
        w = w - rate * slope / np.sqrt(seen)
        seen_bias += off.sum() ** 2
        bias -= rate * off.sum() / math.sqrt(seen_bias)
    return w, bias


def by_hash(ids):
    """The order of a sample: Spark's xxhash64 of the id, a signed number."""
    digest = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0]
    return sorted(ids, key=lambda i: (digest(i), i))


def corpus(n=200):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        bad, poor = rnd.random() < 0.4, rnd.random() < 0.4
        text = rnd.choices(words, k=rnd.randrange(5, 40)) + ["vile"] * (rnd.randrange(1, 4) if bad else rnd.random() < 0.15) + ["scum"] * (bad and rnd.randrange(2)) + ["odd"] * (poor and rnd.randrange(3)) + ["###"] * (30 * poor)
        rnd.shuffle(text)
        lang = rnd.choice(["en", "fr", None])
        docs.append((i, " ".join(text), lang, f"s{poor}{rnd.randrange(2)}", rnd.choice([None, 10 * i]), "x"))
        if i % 3:
            labels.append((i, int(not poor), int(bad)))
    return docs + [(500, None, None, None, None, "x"), (501, "", "en", "s", 3, "x"), (502, "vile Vile", "xx", "s", 3, "x")], labels


def counts(text, single):
    found = collections.Counter(zlib.crc32(w.encode()) % toxicity.BUCKETS for w in re.findall(r"\w+", (text or "").lower()))
    kind = np.float32 if single else float  # a sample's numbers travel in single precision
    return {c: float(kind(1 + math.log(k))) for c, k in found.items()}


def telling(rows, y):
    out = []
    for c in sorted({c for r in rows for c in r}):
        a = sum(t for r, t in zip(rows, y) if c in r)
        b = sum(1 - t for r, t in zip(rows, y) if c in r)
        pos, neg = sum(y), len(y) - sum(y)
        under = (a + b) * (len(y) - a - b) * pos * neg
        if a + b >= 5 and under and len(y) * (a * (neg - b) - b * (pos - a)) ** 2 / under >= 12:
            out.append(c)
    return out


def plain_chain(docs, labels):
    texts, judged = {d[0]: d[1] for d in docs}, {i: (1 - q, t) for i, q, t in labels}
    ids = by_hash(judged)
    rows, y = [counts(texts[i], True) for i in ids], [judged[i] for i in ids]

    def model(at, j, said):
        columns = telling([rows[i] for i in at], [y[i][j] for i in at])
        dense = [[rows[i].get(c, 0.0) for c in columns] + said[i] for i in at]
        w, b = plain_fit(dense, [y[i][j] for i in at], 2e-5, 400, 1.0)
        return lambda row, before: sum(p * q for p, q in zip(w, [row.get(c, 0.0) for c in columns] + before)) + b

    said, models = [[] for _ in ids], []
    for j in range(2):
        models.append(model(range(len(ids)), j, said))
        held = [0.0] * len(ids)
        for fold in range(4):
            other = model([i for i in range(len(ids)) if i % 4 != fold], j, said)
            for i in range(fold, len(ids), 4):
                held[i] = other(rows[i], said[i])
        said = [s + [h] for s, h in zip(said, held)]
    out = {}
    for i, text, *_ in docs:
        logits = []
        for m in models:
            logits.append(m(counts(text, False), logits))
        out[i] = [sigma(z) for z in logits]
    return out


def test_chain_equals_a_plain_one(frame):
    docs, labels = corpus()
    chain = toxicity.train(frame(docs, DOCS), toxicity._judgements(frame(labels, LABELS)), ["low_quality", "toxic"])
    scored = frame(docs, DOCS).select("doc_id", chain.score(F.col("text")).alias("p")).select("doc_id", "p.*")
    got = {r.doc_id: [r.low_quality, r.toxic] for r in scored.collect()}
    want = plain_chain(docs, labels)
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(got[i], want[i], atol=1e-6), i
    assert len({round(p[1], 3) for p in want.values()}) > 8


def plain_stats(text):
    data = (text or "").encode()
    size, words, lines = max(1, len(data)), data.split(), data.split(b"\n")
    of = lambda test: sum(map(test, data))
    letters, digits = of(lambda b: b >= 128 or chr(b).isalpha()), of(lambda b: 48 <= b <= 57)
    space, n = of(lambda b: b in b" \t\n\v\f\r"), max(1, len(words))
    return [
        math.log(1 + len(words)), (size - space) / n, letters / size, of(lambda b: 65 <= b <= 90) / max(1, letters), digits / size,
        space / size, (size - letters - digits - space) / size, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        math.log(1 + len(lines)), len(set(lines)) / len(lines), of(lambda b: chr(b) in ".!?") / n]


def plain_co_training(docs, labels):
    known, judged = {d[0]: d for d in docs}, {i: q for i, q, _ in labels}
    ids, pool = by_hash(judged), by_hash(set(known) - set(judged))
    numbers = {i: plain_stats(d[1]) for i, d in known.items()}
    edges = [np.quantile([numbers[i][j] for i in ids + pool], [q / 8 for q in range(1, 8)]) for j in range(12)]

    def text_row(i):
        out = np.zeros(96)
        for j, value in enumerate(numbers[i]):
            out[8 * j + sum(e <= value for e in edges[j])] = 1
        return out

    def page_row(i):
        _, _, lang, source, n, _ = known[i]
        out = np.zeros(1 << 12)
        for name, value in (("lang", lang), ("source", source), ("length", -1 if n is None else math.floor(math.log2(n + 1)))):
            out[zlib.crc32(f"{name}={value}".encode()) % (1 << 12)] += 1
        return out

    turn = lambda r: [i for k, i in enumerate(ids) if k % 10 in r]
    own, kept, weighed = turn({1, 2, 3, 4, 6, 7, 8, 9}), turn({0}), turn({5})

    def view(row, given):
        w, b = plain_fit([row(i) for i in own] + [row(i) for i, _ in given], [judged[i] for i in own] + [t for _, t in given], 1e-3, 300, 0.5)
        raw = lambda i: float(row(i) @ w + b)
        slope, shift = plain_fit([[raw(i)] for i in kept], [judged[i] for i in kept], 1e-4, 300, 0.5)
        return lambda i: max(0.0, slope[0]) * raw(i) + shift

    def handed(logit):
        ranked = sorted(range(len(pool)), key=lambda k: -logit(pool[k]))
        good = [(pool[k], 1) for k in ranked[:300] if sigma(logit(pool[k])) >= 0.95]
        return good + [(pool[k], 0) for k in ranked[::-1][:300] if sigma(logit(pool[k])) <= 1 - 0.95]

    to_text, to_page = [], []
    for _ in range(4):
        text, page = view(text_row, to_text), view(page_row, to_page)
        to_text, to_page = handed(page), handed(text)
    w, b = plain_fit([[text(i), page(i)] for i in weighed], [judged[i] for i in weighed], 1e-3, 300, 0.5)
    return {i: [sigma(text(i)), sigma(page(i)), sigma(w[0] * text(i) + w[1] * page(i) + b)] for i in known}, to_text, to_page


def test_co_training_equals_a_plain_one(frame):
    docs, labels = corpus()
    given = frame(docs, DOCS)
    model = quality.train(given, frame(labels, LABELS))
    got = given.select("doc_id", quality._scored(model).alias("s")).select("doc_id", "s.*").collect()
    want, to_text, to_page = plain_co_training(docs, labels)
    assert len(got) == len(want) and to_text and to_page  # labels were exchanged both ways
    for r in got:
        assert np.allclose([r.text_score, r.page_score, r.score], want[r.doc_id], atol=1e-6), r.doc_id
