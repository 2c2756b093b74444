"""SimHash, decontamination, licenses, classifiers and packing against plain versions."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, licenses, packing, quality, simhash, toxicity
from quern.llm.components import components
from quern.llm.linear import Rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, fp string"
WORDS = [f"w{i}" for i in range(300)]


def doc(i, text, extra="x"):
    return (i, text, "en", "s", None if text is None else len(text), extra, None)


def some_docs():
    rnd = random.Random(3)
    base = " ".join(rnd.choices(WORDS, k=400))
    rows = [doc(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 60)))) for i in range(40)]
    rows += [doc(100 + i, base) for i in range(5)] + [doc(200 + i, f"{base} tail{i}") for i in range(40)]
    rows += [doc(300, base.upper().replace(" ", "\n")), doc(301, None), doc(302, ""), doc(303, " \t "), doc(304, "one two")]
    rows += [doc(305, "One\vtwo"), doc(None, base), doc(100, base), doc(306, "long " * 70_000)]
    return rows


def brute_components(fps):
    """(doc_id, fingerprint) to component ids, every pair compared."""
    unlike = sorted({f for _, f in fps})
    root = {f: f for f in unlike}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(unlike):
        for b in unlike[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {(i, f): least.get(find(f)) for i, f in fps}


def test_near_duplicates_equal_all_pairs(spark, frame):
    rows = some_docs()
    got = simhash.near_duplicates(frame(rows, DOCS)).collect()
    fps = [(r.doc_id, r.fingerprint) for r in got]
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint): r.component_id for r in got} == brute_components(fps)
    by_id = {i: f for i, f in fps if i is not None}
    assert by_id[301] == by_id[302] == by_id[303] == 0
    assert by_id[304] == by_id[305] and by_id[300] == by_id[100]
    assert simhash.near_duplicates(frame([], DOCS)).count() == 0


def test_fingerprints_are_the_majority_of_the_shingles(frame):
    """From the rule alone: words, three-word shingles, XXH64 with seed 42, more than half."""
    def plain(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\\x20\\x09-\\x0D]+", lowered)
        shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rnd = random.Random(11)
    texts = [None, "", " \t", "one", "One two", "a b c", "A\u00a0b c\u2003d\x1ce \x85f", "\u00c4 \u00e4 \u0130 I i", "x\x0by\x0cz w"]
    texts += ["".join(rnd.choice(["Wort", "\u00e9\u00c9", "a", " ", "\n", "\r\t", "漢 字"]) for _ in range(rnd.randrange(80))) for _ in range(150)]
    rows = [doc(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.fingerprint & (2**64 - 1) for r in simhash.near_duplicates(frame(rows, DOCS)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_stage_bears_columns_of_the_names_it_uses(frame):
    rows = some_docs()
    named = DOCS.replace("component_id string, fp string", "shape string, _quern_text string")
    given = frame(rows, named).withColumn("rank", F.lit(1)).withColumn("id", F.lit("x")).withColumn("hash", F.lit(2))
    kept = simhash.without_near_duplicates(given)
    assert kept.columns == given.columns
    assert kept.count() == simhash.without_near_duplicates(frame(rows, DOCS)).count()


@pytest.mark.parametrize("crowded", [2, 24])
def test_links_connect_what_two_bits_connect(spark, frame, crowded):
    rnd = random.Random(5)
    fps = {0, -1, 1 << 62}
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rnd.randrange(4)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f - (1 << 64) if f >= 1 << 63 else f)
    fps = sorted(fps)
    given = frame([(f,) for f in fps], "fp long")
    links = simhash.links(given, crowded)
    for r in links.collect():
        assert 0 < ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
    roots = {r.node: r.root for r in components(links).collect()}
    mine = [(i, f) for i, f in enumerate(fps)]
    number = {f: i for i, f in mine}
    want = brute_components(mine)
    assert all(number[roots.get(f, f)] == want[i, f] for i, f in mine)


def test_components_of_paths_loops_and_nulls(frame):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 200), (7, 7), (None, 5), (300, 200)]
    got = {r.node: r.root for r in components(frame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}
    assert components(frame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark, frame):
    rows = some_docs()
    docs = frame(rows, DOCS)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    members = simhash.near_duplicates(docs, words=5).collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in members})
    lonely = frame([doc(None, "a b c d e f"), doc(None, "a b c d e f"), doc(None, None)], DOCS)
    assert simhash.without_near_duplicates(lonely).count() == 2


def test_the_stage_links_whatever_the_fingerprints_link(frame):
    """Texts of the same repeated words and other ends: their shingle sets are not alike."""
    ends = [" ".join(f"{c}{i}" for i in range(8)) for c in "pqr"]
    rows = [doc(i, "one two three " * 300 + end) for i, end in enumerate(ends)] + [doc(9, "quite another text of some words")]
    assert simhash.jaccard(rows[0][1].encode(), rows[1][1].encode(), 5) < 0.5
    docs = frame(rows, DOCS)
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {0, 9}
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(docs).collect()) == [0, 9]


def word_distance(item, words):
    """The item's distance to the best passage, by the full table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(words, 1):
            diagonal, row[j] = row[j], min(diagonal + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_passages_within_the_budget_are_found(frame):
    rnd = random.Random(11)
    items = [rnd.choices(WORDS[:60], k=rnd.randrange(5, 80)) for _ in range(12)] + [["solo"], []]
    rows = []
    for i in range(150):
        words = rnd.choices(WORDS[:60], k=rnd.randrange(0, 150))
        item = list(rnd.choice(items))
        for _ in range(rnd.randrange(0, 12)):
            if item:
                at = rnd.randrange(len(item))
                item[at:at + rnd.randrange(2)] = rnd.choices(WORDS, k=rnd.randrange(2))
        at = rnd.randrange(len(words) + 1)
        rows.append(doc(i, ", ".join(words[:at] + item + words[at:]).upper()))
    rows += [doc(500, None), doc(501, ""), doc(None, "Solo!"), doc(502, "x " * 100_000 + " ".join(items[0]))]
    bench = frame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None)], "item_id long, text string")
    got = decontaminate.contaminated(frame(rows, DOCS), bench).collect()
    found = {(r.doc_id, r.item_id): min(x.distance for x in got if (x.doc_id, x.item_id) == (r.doc_id, r.item_id)) for r in got}
    want = {}
    for i, text, *_ in rows[:-1]:
        words = decontaminate.words_of(text)
        for n, item in enumerate(items):
            if item and (d := word_distance(item, words)) <= decontaminate.budget(len(item)):
                want[i, n] = d
    assert {k: v for k, v in found.items() if k[0] != 502} == want
    assert found[502, 0] == 0
    clean = decontaminate.without_leaks(frame(rows, DOCS), bench)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in found}
    assert decontaminate.contaminated(frame([], DOCS), bench).count() == 0
    assert decontaminate.without_leaks(frame(rows, DOCS), bench.limit(0)).count() == len(rows)


def test_notices_equal_every_window_compared(frame):
    rnd = random.Random(2)
    templates = [t for _, t in licenses.TEMPLATES] + ["SPDX MIT", ""]
    scanner = licenses.Scanner(templates)
    found = 0
    for _ in range(200):
        words = rnd.choices(WORDS, k=rnd.randrange(0, 90))
        notice = licenses.words_of(rnd.choice(templates))
        for _ in range(rnd.randrange(3)):
            if len(notice) > 20:
                notice[rnd.randrange(len(notice))] = "changed"
        at = rnd.randrange(len(words) + 1)
        words = words[:at] + notice + words[at:]
        want = []
        for c in scanner.classes:
            starts = list(range(0, max(0, len(words) - c.size + 1), c.stride))
            for n in c.numbers:
                want += scanner.verified(words, n, c.size, 3 * c.stride, starts)
        assert scanner(" ".join(words)) == sorted(want)
        found += len(want)
    assert found > 150
    rows = [doc(1, f"Text. {templates[0]} End."), doc(2, None), doc(None, templates[2]), doc(3, "y " * 90_000 + templates[1])]
    got = licenses.license_scan(frame(rows, DOCS), licenses.TEMPLATES).collect()
    assert {(r.doc_id, r.template) for r in got} == {(1, "apache-2.0-line"), (None, "mit-line"), (3, "gpl-3.0-line")}
    assert licenses.license_scan(frame([], DOCS), licenses.TEMPLATES).count() == 0
    assert licenses.license_scan(frame(rows, DOCS), []).count() == 0


def test_notices_at_any_place_and_among_many_templates(frame, monkeypatch):
    """Containment over all positions of a text, not over the operator's own windows."""
    rnd = random.Random(12)
    templates = [" ".join(rnd.choices(WORDS, k=rnd.randrange(4, 90))) for _ in range(400)] + [t for _, t in licenses.TEMPLATES]
    scanner = licenses.Scanner(templates)
    for _ in range(60):
        n = rnd.randrange(len(templates))
        notice, words = licenses.words_of(templates[n]), rnd.choices(WORDS, k=rnd.randrange(0, 200))
        if len(notice) > 30:
            notice[rnd.randrange(len(notice))] = "changed"
        at = rnd.randrange(len(words) + 1)
        words = words[:at] + notice + words[at:]
        got = {(i, first, end) for i, first, end, _ in scanner(" ".join(words))}
        assert any(i == n and first <= at + 5 and end >= at + len(notice) - 5 for i, first, end in got)
        for i, first, end in got:
            size = scanner.sizes[i]
            inside = set(licenses.shingles(words[first:end], size)) & scanner.sets[i]
            assert len(inside) >= 0.8 * len(scanner.sets[i])
    rows = [doc(1, f"Text. {templates[0]} End."), doc(2, templates[401] + " " + templates[7])]
    named = [(str(i), t) for i, t in enumerate(templates)]
    whole = sorted(map(tuple, licenses.license_scan(frame(rows, DOCS), named).collect()))
    monkeypatch.setattr(licenses, "MAX_CHARS", 20_000)
    assert sorted(map(tuple, licenses.license_scan(frame(rows, DOCS), named).collect())) == whole
    assert {(r[0], r[1]) for r in whole} >= {(1, "0"), (2, "401"), (2, "7")}


def test_bands_reach_the_promised_chance():
    for n, window in ((1, 12), (4, 12), (30, 60)):
        j = licenses.least_jaccard(n, window, 0.8)
        for rows in (1, 2):
            assert (1 - j**rows) ** licenses.bands_for(j, rows) <= licenses.MISS


def labelled(n):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(WORDS, k=rnd.randrange(20, 80))
        bad, poor = rnd.random() < 0.3, rnd.random() < 0.3
        if bad:
            words[3:3] = rnd.choices(["vile", "scum"], k=3)
        if poor:
            words = ["###"] * 60 + words[:5]
        docs.append(doc(i, " ".join(words)))
        labels.append((i, int(not poor), int(bad), "z"))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int, text string"


def test_chain_and_co_training_learn_and_bear_gaps(spark, frame):
    docs, labels = labelled(500)
    docs += [doc(900, None), doc(901, ""), doc(None, "vile scum vile"), doc(902, "fine " * 50_000)]
    labels += [(None, 1, 1, ""), (900, None, None, ""), (901, None, 1, ""), (4, labels[4][1], labels[4][2], "")]
    given, judged = frame(docs, DOCS), frame(labels[:350] + labels[500:], LABELS)
    toxic = {i for i, q, t, _ in labels[:500] if t}
    kept = toxicity.without_toxic(given, judged)
    assert kept.columns == given.columns
    left = {r.doc_id for r in kept.collect()}
    assert len(left & toxic) <= 10 and len(set(range(500)) - toxic - left) <= 5 and {900, 901, 902} <= left
    assert None not in left
    poor = {i for i, q, t, _ in labels[:500] if not q}
    left = {r.doc_id for r in quality.without_poor(given, judged).collect()}
    assert len(left & poor) <= 5 and len(set(range(500)) - poor - left) <= 5
    nothing = frame([], LABELS)
    assert toxicity.without_toxic(given, nothing).count() == len(docs)
    assert quality.without_poor(given, nothing).count() == len(docs)
    assert toxicity.without_toxic(frame([], DOCS), judged).count() == 0
    assert quality.without_poor(frame([], DOCS), judged).count() == 0


def test_later_links_of_the_chain_use_the_earlier():
    rng = np.random.default_rng(4)
    first = rng.random(600) < 0.5
    rows = Rows.of([(np.array([int(f), 2 + int(rng.integers(50))]), np.ones(2)) for f in first], toxicity.BUCKETS)
    chain = toxicity.fit_chain(rows, np.column_stack([first, ~first, first]).astype(float), ["a", "b", "c"])
    assert [len(m.weights) - len(chain.columns) for m in chain.models] == [0, 1, 2]
    assert chain.models[1].weights[-1] < 0
    said = chain.probabilities(toxicity._narrowed(rows, chain.columns))
    assert ((said > 0.5) == np.column_stack([first, ~first, first])).all()


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(4, 70))
    lengths = sorted(map(int, rng.integers(1, window + 1, int(rng.integers(0, 300)))), reverse=True)
    room = []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else window) - n)
    plan = packing.best_fit_decreasing(dict(collections.Counter(lengths)), window)
    number = np.arange(len(lengths))
    run = np.searchsorted(plan.first, number, "right") - 1
    turn, at = np.divmod(number - plan.first[run], plan.each[run]) if len(lengths) else (number, number)
    filled = collections.defaultdict(int)
    for w, o, n in sorted(zip(plan.window[run] + turn, plan.offset[run] + at * plan.length[run], lengths[::-1])):
        assert filled[w] == o
        filled[w] += n
    assert sorted(window - f for f in filled.values()) == sorted(room) and plan.windows == len(room)


def test_packed_ids_are_the_documents(spark, frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = some_docs() + [doc(400, "Straße ÉTÉ it's 'S x1.5,; ΣΑΣ  ﬁ <|endoftext|>\u00a0a\x00b İ")]
    packed = packing.pack(frame(rows, DOCS), window=64)
    got = packed.pieces.join(packed.places, "piece_id").collect()
    sequences = {r.sequence_id: r.ids for r in packed.sequences().collect()}
    texts = collections.Counter(
        np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t, *_ in rows)
    assert all(sequences[r.sequence_id][4 * r.offset:4 * r.offset + 4 * r.length] == r.ids for r in got)
    assert sum(map(len, sequences.values())) == 4 * sum(r.length for r in got)
    assert max(map(len, sequences.values())) <= 256
    ends = [r for r in got if r.start + r.length == r.doc_tokens]
    assert len(ends) == len(rows)
    unlike = {i for i, n in collections.Counter(r[0] for r in rows).items() if n == 1}
    for i, text, *_ in rows:
        if i in unlike:
            ids = b"".join(r.ids for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start))
            assert ids in texts and ids == np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    none = packing.pack(frame([], DOCS))
    assert none.pieces.count() == 0 and none.places.count() == 0


def test_ids_of_texts_with_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encode = packing.WordIds(None)
    rnd = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof text|>", "<|", "endoftext", "|>", " ", "\n", "a", "it's",
             "Word", "x1.5", "\u00e9t\u00c9", "\u6f22", "\u00a0", "<|endoftext|", "\u0130", "e\u0301", "\u2028", "\x1c"]
    texts = ["", *parts, "a<|endoftext|>b", "<|endoftext|> b", "a <|startoftext|>"]
    texts += ["".join(rnd.choices(parts, k=rnd.randrange(1, 12))) for _ in range(10_000)]
    for at in range(0, len(texts), 256):
        some = texts[at:at + 256]
        want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert encode([t.encode() for t in some]) == want
    assert sum("<|endoftext|>" in t for t in texts) > 1000


def test_near_copies_at_the_threshold_go(spark, frame):
    rnd = random.Random(17)
    rows, n = [], 0
    for _ in range(40):
        base = [f"v{rnd.randrange(100_000)}" for _ in range(rnd.randrange(20, 300))]
        for _ in range(rnd.randrange(1, 5)):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(1, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(100_000)}"
            rows.append(doc(n, " ".join(copy)))
            n += 1
    crowd = [f"v{rnd.randrange(100_000)}" for _ in range(200)]
    for i in range(120):  # one crowded bucket in most bands
        copy = list(crowd)
        copy[rnd.randrange(200)] = f"u{i}"
        rows.append(doc(1000 + i, " ".join(copy)))
    rows += [doc(None, "lone words without any id here"), doc(None, "lone words without any id here"), doc(2000, None)]
    rows += [doc(2001, " "), doc(2002, "A b"), doc(2003, "a\tB"), doc(2004, "y " * 90_000), doc(2004, "y " * 90_000)]
    got = simhash.without_near_duplicates(frame(rows, DOCS))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]

    least, sets = list(range(len(rows))), [simhash._shingles((r[1] or "").lower().encode(), 5) for r in rows]

    def find(i):
        return i if least[i] == i else find(least[i])

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= 0.8:
                linked += 1
                least[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        best[find(i)] = min(best.get(find(i), key), key)
    want = sorted(i for nameless, i in best.values() if not nameless)
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 1 and linked > 1000
    assert simhash.without_near_duplicates(frame([], DOCS)).count() == 0


@pytest.mark.parametrize("members, shingles", [(1024, 1 << 21), (40, 1 << 21), (1024, 8_000)])
def test_near_copies_inside_a_crowd_are_found(frame, monkeypatch, members, shingles):
    """Documents at 0.7 by a passage they all share, among them pairs at 0.82."""
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
    rnd = random.Random(17)
    shared = [f"s{i}" for i in range(333)]
    rows = []
    for i in range(100):
        own = [f"d{i}x{j}" for j in range(71)]
        rows.append(doc(i, " ".join(shared + own)))
        if i % 2:  # its last 39 words are others
            rows.append(doc(1000 + i, " ".join(shared + own[:32] + [f"e{i}x{j}" for j in range(39)])))
    rnd.shuffle(rows)
    sets = {r[0]: simhash._shingles(r[1].encode(), 5) for r in rows}
    alike = {frozenset((i, j)): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    pairs = {p for p, s in alike.items() if s >= 0.8}
    assert pairs == {frozenset((i, 1000 + i)) for i in range(1, 100, 2)}
    assert all(0.81 < s < 0.83 if p in pairs else 0.69 < s < 0.72 for p, s in alike.items())
    got = simhash.without_near_duplicates(frame(rows, DOCS))
    assert sorted(r.doc_id for r in got.collect()) == list(range(100))


def test_links_of_a_crowd_connect_what_all_pairs_connect():
    rnd = np.random.default_rng(4)
    common = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[rnd.random(400) < q], rnd.integers(0, 1 << 63, 30, dtype=np.uint64)]))
            for q in rnd.choice([0.85, 0.93, 0.97], 150)]
    bands = rnd.integers(0, 2, (150, 3))
    side = rnd.integers(0, 2, 150)
    for at in (0, 1, 2):
        for sides in (None, side):
            want = {i: {i} for i in range(150)}
            true = set()
            for i in range(150):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if both / (len(sets[i]) + len(sets[j]) - both) < 0.8 or (bands[i, :at] == bands[j, :at]).any():
                        continue
                    if sides is None or side[i] != side[j]:
                        true.add((j, i))
                        if want[i] is not want[j]:
                            want[i] |= want[j]
                            for k in want[j]:
                                want[k] = want[i]
            found = simhash.linked(sets, bands, at, sides, 0.8)
            assert set(found) <= true and len(found) == 150 - len({id(w) for w in want.values()}) > 20


def test_labels_of_other_documents_and_repeats_take_no_place_in_the_sample(frame):
    docs = frame([doc(i, f"text {i}") for i in range(30)] + [doc(7, f"copy {i}") for i in range(300)], DOCS)
    labels = frame([(i, i % 2, None, "") for i in range(4000)], LABELS)
    columns = {"text": F.col("text")}
    got = toxicity.labelled_sample(docs, labels, "doc_id", columns, ["quality"], 20).collect()
    assert len({r._id for r in got}) == len(got) == 20
    got = toxicity.labelled_sample(docs, labels, "doc_id", columns, ["quality"], 50).collect()
    assert {(r._id, r._text, r._quality) for r in got} == {(i, "copy 0" if i == 7 else f"text {i}", i % 2) for i in range(30)}
    assert len(got) == 30


def test_items_of_few_words_must_be_there_as_they_are(frame):
    assert [decontaminate.budget(m) for m in range(1, 12)] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2]
    bench = frame([(2, "red fox"), (3, "one two three"), (4, "a b c d")], "item_id long, text string")
    texts = ["A red, fox.", "red foxes", "fox red", "a red big fox", "one two", "so one two THREE go", "one three",
             "a b c", "a b c d", "a b x c d", "b c d a"]
    docs = frame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.first_word, r.end_word, r.distance) for r in got} == {
        (0, 2, 1, 3, 0), (5, 3, 1, 4, 0), (8, 4, 0, 4, 0)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == set(range(11)) - {0, 5, 8}


def test_a_benchmark_of_many_blocks_makes_no_larger_plan(frame, plan, monkeypatch):
    rnd = random.Random(12)
    items = [rnd.choices(WORDS, k=rnd.randrange(3, 30)) for _ in range(60)] + [[]]
    rows = [doc(i, " ".join(rnd.choices(WORDS, k=20) + items[i % 61] + rnd.choices(WORDS, k=20))) for i in range(80)]
    docs, bench = frame(rows, DOCS), frame([(f"i{i}", " ".join(w)) for i, w in enumerate(items)], "item_id string, text string")
    want = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in want} >= {(i, f"i{i % 61}") for i in range(80) if i % 61 < 60}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    got, clean = decontaminate.contaminated(docs, bench), decontaminate.without_leaks(docs, bench)
    assert sorted(got.collect()) == sorted(want)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {r.doc_id for r in want}
    for df in got, clean:
        assert plan(df).count("search(") <= 1 and "Union" not in plan(df) and "i59" not in plan(df)
