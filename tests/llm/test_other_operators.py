"""URL rules, neighbours, chats, language model and the pipeline against plain versions."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, neighbours, ngram, url_filter
from quern.llm.elias_fano import EliasFano, Searched, Trie

RULES = [("block", "a.com"), ("allow", "a.com/x/"), ("block", "a.com/x/y"), ("allow", "b.a.com"), ("block", "org/"),
         ("allow", "org/"), ("block", "Shop.Example.NET/")]


def plain_verdict(url):
    host, path = url_filter.parts(url)
    fits = []
    for verdict, rule in RULES:
        h, slash, p = rule.partition("/")
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((h.count("."), len(slash + p), verdict == "block", rule, verdict))
    return max(fits)[3:] if fits else (None, "allow")


def test_longest_rule_decides(frame):
    rnd = random.Random(1)
    urls = [None, "", "nothing", "://", "http://", "HTTP://A.COM", "http://a.com/x/y#f", "x://org", "ftp://u.org/?q",
            "http://xa.com/x/", "http://b.a.com/x/yy", "http://a.com:80/x/", "http://a.com/" + "x/" * 50_000]
    hosts, paths = ["a.com", "b.a.com", "c.B.a.com", "org", "u.org", "shop.example.net", "com"], ["", "/", "/x", "/x/", "/x/y", "/x/yz/"]
    urls += [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?a=/x/', '#z'])}" for _ in range(200)]
    pages = frame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = pages.select("page_id", url_filter.judged(F.col("url"), RULES).alias("j")).select("page_id", "j.*").collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {i: plain_verdict(u) for i, u in enumerate(urls)}
    kept = url_filter.filter_urls(pages, RULES)
    assert kept.columns == pages.columns
    assert kept.count() == sum(plain_verdict(u)[1] == "allow" for u in urls)
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    assert url_filter.filter_urls(pages, [], default="block").count() == 0


@pytest.mark.parametrize("at_once", [1, 3])
def test_rules_in_parts_decide_as_all_at_once(frame, monkeypatch, at_once):
    monkeypatch.setattr(url_filter, "MAX_RULES", at_once)
    hosts, paths = ["a.com", "b.a.com", "org", "u.org", "shop.example.net"], ["", "/", "/x", "/x/", "/x/y", "/x/yz/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "none"]
    pages = frame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, judged string")
    found = url_filter.judged_pages(pages, RULES, out="j").select("page_id", "j.*").collect()
    assert {r.page_id: (r.rule, r.verdict) for r in found} == {i: plain_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages, RULES).columns == pages.columns


VECTORS = "vec_id long, embedding array<float>, rank string"


def test_neighbours_with_gaps_copies_and_ties(frame):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 8)).astype("f4")
    rows = [(i, [float(x) for x in v], "") for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1], "") for i in range(60)]  # one vector many times
    good = list(rows)
    rows += [rows[3], (None, rows[4][1], ""), (2000, None, ""), (2020, [], ""), (2040, [0.0] * 8, ""), (2060, [1.0] * 7 + [None], ""),
             (2080, [float("nan")] * 8, ""), (2100, [float("inf")] * 8, ""), (2120, [1.0, 2.0], "")]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], "f4").astype(float)
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, found in got.items():
        score = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [v for _, v, _ in sorted(found)] == [ids[i] for i in order]
        assert np.allclose([s for *_, s in sorted(found)], score[order])
        assert [r for r, *_ in sorted(found)] == list(range(1, 21))
    assert neighbours.nearest(frame([], VECTORS), F.lit(True)).count() == 0
    assert neighbours.nearest(frame(rows[:4], VECTORS), F.lit(True)).count() == 12


def test_recall_of_the_permutation_index():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = neighbours.augmented(x[:256], 1.0)
    number, found, score = neighbours.search_block(np.arange(6000), x, x[:100], pivots, 1.0, 21)
    exact = np.argsort(-(x[:100] @ x.T), axis=1)[:, :21]
    recall = np.mean([len(set(found[number == q]) & set(exact[q])) / 21 for q in range(100)])
    assert recall >= 0.9


CHAT = "conv_id long, turn long, role string, text string, part string"


def test_recall_of_the_whole_query_where_the_share_decides(spark):
    """Beyond 504 vectors a block no vector is ranked that the share leaves out."""
    rng = np.random.default_rng(10)
    vectors = rng.standard_normal((4000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    wide, found = vectors.astype(np.float64), collections.defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert abs(r.score - wide[r.query_id] @ wide[r.vec_id]) < 1e-9
    hits = 0
    for q in range(0, 4000, 20):
        scores = wide @ wide[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) == 200 and all(len(f) == 20 for f in found.values())
    assert hits / (200 * 20) >= 0.9


def test_chats_read_back_exactly(frame):
    rnd = random.Random(4)
    bits = [c.decode() for c in chat.CONTROLS] + ["\\", "\n", "é", "<", "|", ">", "[", "中", "ok", "", "<|im_end", "</s"]
    text = lambda: "".join(rnd.choices(bits, k=rnd.randrange(12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "odd\nrole\\", "<|im_end|>", None]), rnd.choice([text(), None]), "")
            for c in [None, *range(12)] for t in range(rnd.randrange(1, 9))]
    rows += [(50, t, "assistant", f"turn {t}", "") for t in range(1500)] + [(51, None, "user", "x" * 300_000, "")]
    rows += [(52, 1, "user", "same", "")] * 3 + [(52, 1, "assistant", "tie", ""), (52, None, "assistant", None, "")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame(rows, CHAT))).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, said, _ in rows:
        groups[c].append((t is not None, t or 0, (role or "").encode(), (said or "").encode()))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        whole = b"".join(role + b"\n" + said + b"\n" for *_, role, said in turns)
        loss = b"".join(said for *_, role, said in turns if role == b"assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(whole).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss).hexdigest() and got[c].loss_chars == len(loss.decode())
    parts = chat.format_conversations(frame(rows, CHAT)).collect()
    for p in parts:
        inside = p.formatted
        for marker in (chat.OPEN, chat.CLOSE[:-1]):
            assert inside.count(marker.decode()) == p.turns
            inside = inside.replace(marker.decode(), "")
        assert not any(c.decode() in inside for c in chat.CONTROLS)
    assert chat.read_back(chat.format_conversations(frame([], CHAT))).count() == 0


def test_elias_fano_and_trie():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1 << 40), (1000, 900), (1000, 1 << 50)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        assert (EliasFano.of(values).values() == values).all()
    pairs = np.unique(rng.integers(0, 60, (400, 2)), axis=0)
    contexts, v = np.unique(pairs[:, 0] * 7 + 3, return_inverse=True)
    words, w = np.unique(pairs[:, 1] * 5, return_inverse=True)
    codes = rng.integers(1, 60_000, len(pairs)).astype(np.uint16)
    keys = v.astype(np.uint64) * np.uint64(len(words)) + w.astype(np.uint64)
    reader = Trie(contexts.astype(np.uint64), words.astype(np.uint64), keys, codes).reader()
    stored = {(a * 7 + 3, b * 5): c for (a, b), c in zip(pairs.tolist(), codes.tolist())}
    ask = np.array([(a, b) for a in range(430) for b in range(0, 300, 5)], np.uint64)
    assert reader.look_up(ask[:, 0], ask[:, 1]).tolist() == [stored.get((int(a), int(b)), 0) for a, b in ask]


def test_the_trie_is_searched_without_decoding_its_levels(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(EliasFano, "values", lambda self: pytest.fail("a level was decoded"))
    for n, top in ((0, 1), (1, 1 << 40), (1, 1), (1000, 900), (5000, 1 << 50), (3000, 1 << 63), (70, 1 << 13)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        level = Searched(EliasFano.of(values))
        assert (level.numbers(np.arange(n)) == values).all()
        ask = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 500).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at, there = level.find(ask)
        assert (there == np.isin(ask, values)).all()
        assert (at[there] == np.searchsorted(values, ask[there])).all()
        start, stop = np.sort(rng.integers(0, n + 1, (2, len(ask))), axis=0)
        at, there = level.find(ask, start, stop)
        first = [np.searchsorted(values[b:e], x) + b for x, b, e in zip(ask, start, stop)]
        assert there.tolist() == [bool(f < e and values[f] == x) for f, e, x in zip(first, stop, ask)]
        assert all(a == f for a, f, t in zip(at, first, there) if t)
    contexts, words = (np.unique(rng.integers(0, 1 << 63, k, dtype=np.uint64)) * np.uint64(2) for k in (300, 9000))
    keys = np.unique(rng.integers(0, len(contexts) * len(words), 200_000).astype(np.uint64))
    codes = rng.integers(1, 60_000, len(keys)).astype(np.uint16)
    v, w = np.divmod(keys, np.uint64(len(words)))
    reader = Trie(contexts, words, keys, codes).reader()
    assert (reader.look_up(contexts[v], words[w]) == codes).all()
    assert not reader.look_up(contexts[v] + np.uint64(1), words[w]).any()
    assert not reader.look_up(contexts[v], words[w] + np.uint64(1)).any()


DOCS = "doc_id long, text string, score string"


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_scores_equal_the_model_in_plain(spark, frame, monkeypatch, block):
    monkeypatch.setattr(ngram, "BLOCK_TOKENS", block)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(30))) + (" rare%d" % i), "") for i in range(80)]
    rows += [(100, None, ""), (101, "", ""), (None, "W1 w2\tw3", ""), (5, rows[5][1], ""), (102, "w1 w2 " * 20_000, "")]
    held = F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    got = ngram.score_documents(frame(rows, DOCS), held).collect()
    split = lambda t: [*(t or "").lower().split(), "\n"]
    n1, n2, begins = collections.Counter(), collections.Counter(), 0
    for i, t, _ in rows:
        if i is None or i % 4 != 1:
            n1.update(split(t))
            n2.update(zip(["^", *split(t)], split(t)))
            begins += 1
    total, distinct = sum(n1.values()), len(n1)
    n1["^"] = begins
    prior = got[0].prior
    p = lambda w: (n1[w] + 1) / (total + distinct + 1)

    def numbers(t):
        w = split(t)
        smooth = sum(math.log10((n2[a, b] + prior * p(b)) / (n1[a] + prior)) for a, b in zip(["^", *w], w))
        return len(w), sum(n1[x] > 0 for x in w), sum(math.log10(p(x)) for x in w), smooth

    assert len(got) == len(rows)
    want = {i: numbers(t) for i, t, _ in rows}
    for r in got:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 2e-4 * n
        assert r.held_out == (r.doc_id is not None and r.doc_id % 4 == 1)
    left_out = {m: sum(c * math.log10((c - 1 + m * p(b)) / (n1[a] - 1 + m)) for (a, b), c in n2.items()) for m in ngram.PRIORS}
    assert prior == max(left_out, key=left_out.get)
    assert ngram.score_documents(frame([], DOCS), held).count() == 0


def test_pipeline_stages(spark, small_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    before, columns = {r.doc_id for r in docs.collect()}, docs.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_dir).cache()
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= before and len(after) == docs.count()
        if name == "toxicity":
            assert len(after & toxic) < len(toxic)
        before = after
    pieces = corpus_pipeline.run(spark, small_dir).collect()
    assert {r.doc_id for r in pieces} == before
    room = collections.defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert room[r.sequence_id] == r.offset and len(r.ids) == 4 * r.length
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096


def test_pipeline_stages_on_no_documents_and_on_more_columns(spark, frame, small_dir):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, _quern_row long"
    text = "some words that stand for a clean document of their own and nothing else " * 4
    rows = [(i, f"{text} {i} {text[i:]}", "en", "s", 9, 0.5, "x", 1) for i in range(12)] + [(None, None, None, None, None, None, None, None)]
    for given in (frame([], schema), frame(rows, schema)):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, small_dir)
            if name != "packing":
                assert after.columns == given.columns, name
                docs = after
        assert (after.count() == 0) == (given.count() == 0)
