"""Source divergence, the forest of projections and resampling against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quern.llm import divergence, forest, resample

DOCS = "doc_id long, text string, lang string, source string, n long, term string, bucket string"
LOWER = {i: i + 32 for i in range(65, 91)}


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, 0, "x", None)


# source divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least_docs, top):
    groups, langs, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), {}
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        langs[lang or ""].update(terms)
        docs.setdefault(lang or "", collections.Counter()).update(set(terms))
    out = set()
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        apart = lambda p, q: (p - q) * (p - q) // (p + q)
        p, q = shares(own), shares(langs[lang])
        pairs = []
        for (other_lang, other), counts in groups.items():
            if other_lang == lang and other != source:
                r = shares(counts)
                pairs.append((-sum(apart(p[t], r[t]) for t in kept), other.encode()))
        terms = [(-apart(p[t], q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


@pytest.fixture
def sources_texts():
    rnd = random.Random(5)
    words = ["a", "Bc", "straße", "漢字", "x" * 8, "y" * 9, "z" * 16, "é" * 8, "w" * 17, "LONG" * 20, "long" * 20, "q" * 33]
    words += ["".join(rnd.choices("abcdé", k=rnd.randrange(1, 12))) for _ in range(60)]
    rows = []
    for i in range(160):
        some = rnd.sample(words, 25)
        text = "".join(rnd.choice(some) + rnd.choice([" ", ", ", "1", "_\n", "-"]) for _ in range(rnd.randrange(0, 60)))
        rows.append(doc(i, text, rnd.choice(["en", "de", None, ""]), rnd.choice([None, "s1", "s2", "s3", "ß"])))
    rows += [doc(500, None, "xx", "only"), doc(501, "", "xx", "other"), doc(None, "...", "en", "bare")]
    rows += [rows[3]] * 4 + [doc(600, "very Long text " * 4000, "en", "s1")]
    return rows


@pytest.mark.parametrize("slice_bytes, sources, terms", [(1 << 22, 256, 1024), (500, 2, 8)])
def test_divergence_equals_a_plain_count(frame, sources_texts, monkeypatch, slice_bytes, sources, terms):
    for name, value in (("SLICE", slice_bytes), ("SOURCE_BLOCK", sources), ("TERM_BLOCK", terms)):
        monkeypatch.setattr(divergence, name, value)
    got = [tuple(r) for r in divergence.audit(frame(sources_texts, DOCS), least_docs=4, top=3).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(sources_texts, 4, 3)


def test_slices_of_a_text_are_one_document(monkeypatch):
    text = ("Long é漢 words-" * 40 + "x" * 300 + " y").encode()
    for size in (1 << 22, 7, 64):
        monkeypatch.setattr(divergence, "SLICE", size)
        rows = [r for b in divergence._long(text, ("en", "s")) for r in b.to_pylist()]
        want = collections.Counter(TERM.findall(text.decode().translate(LOWER)))
        assert {r["term"]: r["n"] for r in rows} == want and all(r["docs"] == 1 for r in rows) and len(rows) == len(want)


def test_divergence_of_nothing(frame):
    assert divergence.audit(frame([], DOCS)).count() == 0


def test_radix_order_is_a_stable_sort():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 3, 500, dtype=np.uint32), rnd.integers(0, 1 << 63, 40, dtype=np.uint64)[rnd.integers(0, 40, 500)]
    assert (divergence.radix_order(a, b) == np.lexsort((b, a))).all()
    assert len(divergence.radix_order(a[:0], b[:0])) == 0


# forest

VECTORS = "vec_id long, embedding array<double>, label int, unit string, node string"


def plain_links(rows, similarity):
    sound = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, *_ in rows]
    unit = [np.array(v) / max(map(abs, v)) if ok else None for ok, (_, v, *_) in zip(sound, rows)]
    unit = [u if u is None else u / np.sqrt(u @ u) for u in unit]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i, (vec_id, *_) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    ids = [least.get(find(i)) for i in range(len(rows))]
    return collections.Counter((r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, ids))


def some_vectors(width=16, crowd=150):
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((120, width))
    near = [b + rnd.standard_normal(width) * s for b in base[:40] for s in (0.02, 0.1, 0.25)]
    crowded = base[50] + rnd.standard_normal((crowd, width)) * 0.01
    rows = [(i, v.tolist(), 0, "x", None) for i, v in enumerate([*base, *near, *crowded])]
    rows += [(1000 + i, (base[60] * f).tolist(), 1, "x", None) for i, f in enumerate((1, 1, 2, 1e-200, 1e200))]
    rows += [(1100, None, 0, "x", None), (1101, [], 0, "x", None), (1102, [0.0] * width, 0, "x", None)]
    rows += [(1103, [None] + [1.0] * (width - 1), 0, "x", None), (1104, [math.nan] * width, 0, "x", None)]
    rows += [(1105, [math.inf] + [1.0] * (width - 1), 0, "x", None), (1106, [1.0] * 3, 0, "x", None), (1107, [2.0, 2.0, 2.1], 0, "x", None)]
    return rows + [(None, base[61].tolist(), 0, "x", None), (5, base[5].tolist(), 0, "x", None), (None, [0.0, 5.0], 0, "x", None)]


@pytest.mark.parametrize("leaf", [512, 24])
def test_links_equal_all_pairs(frame, leaf):
    rows = some_vectors()
    got = forest.near_duplicates(frame(rows, VECTORS), trees=12, leaf=leaf).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == plain_links(rows, 0.95)


def test_no_vectors(frame):
    assert forest.near_duplicates(frame([], VECTORS)).count() == 0
    assert forest.near_duplicates(frame([(1, None, 0, "x", None)], VECTORS).limit(1)).collect()[0].kept


def test_recall_of_the_forest():
    """Of pairs just at the threshold, the hardest ones, in trees of nine levels."""
    rnd = np.random.default_rng(8)
    u = forest.unit(rnd.standard_normal((6000, 64)))
    away = rnd.standard_normal(u.shape)
    away = forest.unit(away - (away * u).sum(axis=1, keepdims=True) * u)
    both = np.concatenate([u, 0.951 * u + math.sqrt(1 - 0.951**2) * away])
    spill = forest.margin(0.95, 64)
    together = np.zeros(len(u), bool)
    posts = 0
    for tree in range(forest.TREES):
        todo = [(tree + 1, np.arange(len(both)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= 64:
                posts += len(rows)
                inside = np.isin(np.arange(len(u)), rows[rows < len(u)]) & np.isin(np.arange(len(u)), rows[rows >= len(u)] - len(u))
                together |= inside
                continue
            subtree = forest.fitted(node, both[rows[:forest.SAMPLE]], len(rows), spill, 64)
            of, split = forest.let_down(node, both[rows], subtree, spill)
            todo += [(int(forest._child(node, np.array([s]))[0]) % (1 << 64), rows[of[split == s]]) for s in np.unique(split)]
    assert together.mean() >= 0.99
    assert posts < 10 * forest.TREES * len(both)


def test_connected_and_first_leaf():
    near = np.zeros((6, 6), bool)
    for a, b in ((0, 4), (4, 2), (1, 5)):
        near[a, b] = near[b, a] = True
    assert forest.connected(near).tolist() == [0, 1, 0, 3, 0, 1]
    sets = [np.array(x, np.int64) for x in ([3, 9], [9], [3, 9], [])]
    assert forest._first_here(sets, sets, 9).tolist() == [
        [False, True, False, True], [True] * 4, [False, True, False, True], [True] * 4]


# resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_resample(rows, target, least_words=20):
    s, t = collections.Counter(), collections.Counter()
    for r in rows:
        s.update(plain_features(r[1])[1])
    for text in target:
        t.update(plain_features(text)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)]
    out, able = [], []
    for k, (i, text, *_) in enumerate(rows):
        words, found = plain_features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= least_words:
            able.append((-score, i is None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(able)[:len(able) * 25 // 100]):
        out[k][4] = rank + 1
    return collections.Counter(map(tuple, out))


def test_checksums_of_words_and_pairs(monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcXYZ019é漢", k=k)) for k in (1, 2, 3, 8, 13, 47, 48, 49, 200) for _ in range(4)]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(rnd.choice([0, 1, 2, 50]))) for _ in range(40)]
    for size in (1 << 21, 64, 7):
        monkeypatch.setattr(resample, "SLICE", size)
        got = [([], []) for _ in texts]
        for one, of_one, two, of_two in resample.features([t.encode() for t in texts]):
            for hashes, of, k in ((one, of_one, 0), (two, of_two, 1)):
                for h, i in zip(hashes.tolist(), of.tolist()):
                    got[i][k].append(h)
        for (one, two), text in zip(got, texts):
            found = WORD.findall(text.translate(LOWER))
            assert one == [zlib.crc32(w.encode()) for w in found]
            assert two == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(found, found[1:])]


def test_resample_equals_a_plain_draw(frame):
    rnd = random.Random(9)
    words = ["a", "B1", "straße", "漢字", "x" * 47, "y" * 48, "z" * 49, "0", "é" * 40] + [f"w{i}" for i in range(40)]
    rows = [doc(i, "".join(rnd.choice(words) + rnd.choice([" ", "\n", "-", " , "]) for _ in range(rnd.randrange(0, 50)))) for i in range(120)]
    rows += [doc(200, None), doc(201, ""), doc(202, "? !"), doc(None, "null id " * 20), doc(203, "Long text here " * 3000)]
    rows += [doc(204, "same words " * 15)] * 4
    target = ["w1 w2 w3 a B1", None, ""]
    got = resample.resampled(frame(rows, DOCS), frame([(t,) for t in target], "text string")).collect()
    assert collections.Counter(map(tuple, got)) == plain_resample(rows, target)


def test_resample_of_nothing(frame):
    none = frame([], "text string")
    assert resample.resampled(frame([], DOCS), none).count() == 0
    assert [r["rank"] for r in resample.resampled(frame([doc(1, "one two")], DOCS), none).collect()] == [None]


@pytest.mark.parametrize("n, need", [(1, 1), (7, 3), (400, 1), (400, 399), (400, 400), (1500, 377)])
def test_cutoff_is_the_key_of_that_rank(frame, n, need):
    rnd = random.Random(n + need)
    keys = [(rnd.randrange(5), rnd.randrange(3), i) for i in range(n)]
    df = frame(keys, "low long, id long, row long").repartition(7)
    last = resample.cutoff(df, need)
    assert last == sorted(keys)[need - 1]
    ranks = {r.row: r["rank"] for r in resample.ranked(df, last).collect()}
    assert ranks == {key[2]: i + 1 for i, key in enumerate(sorted(keys)[:need])}
    assert resample.cutoff(df, 0) is None
