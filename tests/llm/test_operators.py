"""Operators against brute force, and their defined edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import _graph, embed_dedup, langid, minhash, packing, quality, sharding, spm, urlrules, vptree, wrapper
from helixframe.llm import _text as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "one two"), (6, "a b c d e f"), (7, "a b c d e f"), (8, "word " * 30_000), (8, "word " * 30_000), (9, "é一\U0001f600 ñ\x00\x1c")]


def docs(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS n", "2 AS length", "3 AS piece", "array(1) AS bands", "'y' AS comp", "null AS h", "'z' AS lang_pred", "0.5D AS score", "'q' AS address")


# ---------------------------------------------------------------- hashing and graph


def test_word_hashes_follow_the_words():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aAb \t\n\x0b é") for _ in range(rnd.randint(0, 30))) for _ in range(300)] + [None, ""]
    buf, off = T.utf8(pa.array(texts, pa.string()))
    h, at = T.word_hashes(buf, off, lower=True)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    named = {}
    for w, x in zip((w for ws in words for w in ws), h.tolist(), strict=True):
        assert named.setdefault(w, x) == x
    assert len(set(named.values())) == len(named)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert _graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---------------------------------------------------------------- near-duplicate texts


def test_superminhash_against_a_plain_loop():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 2, 17, 400)]
    at = np.cumsum([0, *map(len, sets)])
    m = 40
    got = minhash.superminhash(np.concatenate(sets), at, m)
    for row, s in zip(got, sets, strict=True):
        best = [2**64 - 1] * m
        for x in s:
            p = list(range(m))
            for j in range(m):
                z = int(T.mix(np.array([x + np.uint64(int(minhash._ROUND) * (j + 1) % 2**64)]))[0])
                k = j + ((z >> 32) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                best[p[j]] = min(best[p[j]], j << 32 | z & 0xFFFFFFFF)
        assert row.tolist() == best


def test_superminhash_estimates_similarity():
    rnd = np.random.default_rng(5)
    base = np.unique(rnd.integers(0, 2**63, 900, dtype=np.uint64))
    a, b = np.sort(base[:800]), np.sort(base[100:])
    sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 256)
    assert abs((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1


def brute_components(rows, k, num=80, den=100):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = find(a), find(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("crowded,large,shared", [(128, 16, 32), (4, 3, 32), (4, 1000, 1), (4, 3, 1)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, crowded, large, shared):
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    monkeypatch.setattr(minhash, "LARGE", large)
    if crowded == 4:
        monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    if shared == 1:  # all documents share one bucket, and no two of them another
        def one_band(sig, bands, rows):
            own = T.mix(sig.sum(axis=1, dtype=np.uint64)).view(np.int64)[:, None] + np.arange(bands)
            own[:, 3] = 0
            return own

        monkeypatch.setattr(minhash, "band_hashes", one_band)
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(40, 160))]
        for _ in range(rnd.randint(1, 14)):
            t = list(base)
            for _ in range(rnd.randint(0, 6)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(t) if rnd.random() < 0.8 else " ".join(base)))
    rows += [(1000 + i, t) for i, t in EDGE if i != 8]
    if shared == 1:
        bands = [r.bands for r in minhash.signatures(docs(spark, rows).selectExpr("doc_id AS doc", "text", "0L AS t1", "0L AS t2"), 4, 32, 5).collect()]
        assert {b[3] for b in bands} == {0} and len({b[0] for b in bands}) > 50
    got = minhash.near_duplicates(docs(spark, rows), shingle=4).collect()
    assert {tuple(r) for r in got} == brute_components(rows, 4)


def test_near_duplicates_edges(spark):
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, EDGE)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (6, 2, 6, True), (7, 2, 6, False), (8, 1, 8, True)} <= out
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_of_repeated_and_null_ids_equal_brute_force(spark):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(80)] for _ in range(6)]
    near = lambda k, n=1: " ".join(w if j >= n else f"x{k}{rnd.random()}" for j, w in enumerate(base[k]))
    rows = [(1, " ".join(base[5])), (1, " ".join(base[0])), (2, near(0)), (3, " ".join(base[0]))]  # two classes share the least id
    rows += [(None, near(1)), (7, near(1)), (None, near(1)), (None, near(2)), (None, near(2)), (None, " ".join(base[3])), (None, None), (None, "")]
    rows += [(rnd.choice([None, 4, 5, 6, 9]), near(rnd.randrange(5), rnd.randint(0, 6))) for _ in range(40)]
    rows += [(9, " ".join(base[4]))] * 30 + [(None, " ".join(base[4]))] * 5
    low = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in low]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    want = []
    for k, (i, _) in enumerate(rows):
        some = [x for x in ids[find(k)] if x is not None]
        least = min(some) if some else None
        want.append((i, len(sets[k]), least, least is None or i == least))
    got = minhash.near_duplicates(docs(spark, rows), shingle=4)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_planted_pairs_at_the_threshold_are_found(spark):
    """Lone pairs with a similarity of 0.80 to 0.82, among 1,500 documents."""
    rnd = random.Random(13)
    rows, linked = [], 0
    for k in range(750):
        words = [f"{k}w{j}" for j in range(180 + k % 40)]
        other, cut = list(words), rnd.randint(16, 22)
        other[:cut] = [f"{k}v{j}" for j in range(cut)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        n, same = len(words) - 4, len(words) - 4 - cut
        linked += 0.8 <= same / (2 * n - same) < 0.82
    near = {(i, len(t)) for i, t in rows}
    assert linked > 100 and near
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    for k in range(750):
        a, b = (set(zip(*[t.split()[j:] for j in range(5)], strict=False)) for t in (rows[2 * k][1], rows[2 * k + 1][1]))
        assert (got[2 * k + 1] == 2 * k) == (100 * len(a & b) >= 80 * len(a | b))


# ---------------------------------------------------------------- vectors


def vectors(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.standard_normal(16).tolist(), int(rnd.integers(0, 3))) for i in range(300)]
    near = [(1000 + i, (np.array(rows[i % 40][1]) * rnd.uniform(0.5, 2) + 0.05 * rnd.standard_normal(16)).tolist(), rows[i % 40][2]) for i in range(200)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] + [1.0] * 15, 1), (2004, rows[0][1], None), (2005, rows[0][1], rows[0][2]), (2006, rows[0][1], rows[0][2])]
    return rows + near + odd


@pytest.mark.parametrize("window", [8, 256])
def test_sorted_projection_passes(spark, monkeypatch, window):
    monkeypatch.setattr(embed_dedup, "BLOCK", 4)
    monkeypatch.setattr(embed_dedup, "TILE", 3)
    rows = vectors(spark)
    odd = [(None, rows[0][1], rows[0][2]), (None, None, None), (3000, [1.0, 2.0], 0), (3001, [1.0, 2.0], 0), (3002, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS v", "3 AS rank", "4 AS block", "5 AS s", "6 AS k1", "7 AS mean", "8 AS passes")
    out = embed_dedup.near_duplicates(df, window=window).collect()
    assert len(out) == len(rows) + len(odd)
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)] * 2
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None}
    assert all(got.pop(i) == (0, i, True) for i in (3000, 3001, 3002))
    ok = [(i, np.array(v), label) for i, v, label in rows if v is not None and label is not None and np.isfinite(v).all() and np.any(v)]
    comp, links = {i: i for i, *_ in rows}, Counter()

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for n, (i, x, a) in enumerate(ok):
        for j, y, b in ok[n + 1 :]:
            if a == b and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                comp[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(i), find(i) == i) for i, *_ in rows}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def with_pairs(rnd, n, pairs, together, cosine=0.981, d=64):
    """``n`` unit vectors whose mean cosine is ``together``, then a partner at ``cosine`` of each of the first ``pairs``."""
    x = unit(np.sqrt(together) * unit(rnd.standard_normal(d)) + np.sqrt(1 - together) * unit(rnd.standard_normal((n, d))))
    side = rnd.standard_normal((pairs, d))
    side = unit(side - (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    return np.vstack([x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * side])


@pytest.mark.parametrize("together", [0.0, 0.5, 0.9])
def test_passes_find_lone_pairs_of_spread_and_clustered_vectors(spark, together):
    n, pairs, window = 12_000, 400, 16
    x = with_pairs(np.random.default_rng(6), n, pairs, together)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    met = embed_dedup.near_duplicates(df, window=window).filter("component_id <> vec_id").count()
    assert met >= 0.98 * pairs


def test_passes_grow_with_the_label_and_its_mean():
    plan = [embed_dedup.passes_for(n, m, 0.98, 256) for n, m in ((256, 0.9), (10_000, 0.0), (10_000_000, 0.0), (10_000, 0.9), (1_000_000, 0.95), (100_000, 0.99))]
    assert plan[0] == 1 and plan[1] < plan[2] < 64 and plan[1] < plan[3] and plan[4] > 500 and plan[5] == 0


@pytest.mark.parametrize("together", [0.95, 0.98])
def test_labels_of_like_vectors_lose_no_link(spark, monkeypatch, together):
    monkeypatch.setattr(embed_dedup, "BLOCK", 700)
    x = with_pairs(np.random.default_rng(9), 3000, 200, together)
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())] + [(9000, x[0].tolist(), 2), (9001, x[0].tolist(), 2)]
    assert embed_dedup.passes_for(3200, together, 0.98, 16) == 0
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=16).collect()}
    unit_x = unit(x)
    ok = unit_x @ unit_x.T >= 0.98
    np.fill_diagonal(ok, False)
    assert all(got[i][0] == int(ok[i].sum()) for i in range(len(x)))
    comp = np.arange(len(x))
    while True:
        new = np.array([min(comp[i], comp[ok[i]].min(initial=i)) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    assert all(got[i][1] == comp[i] for i in range(len(x))) and got[9001] == (1, 9000)


def nearest_lists(df, **more):
    got = {}
    for r in vptree.nearest(df, df.filter("vec_id % 20 = 0"), **more).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def test_trees_are_exact_at_factor_one_and_prune_beyond(spark):
    rows = vectors(spark) + [(None, [1.0] * 16, 1), (2020, [1.0, 2.0], 1), (2040, [], 1)]
    rows += [(3000 + i, [2.0] * 16, 1) for i in range(90)]  # more ties than ranks
    rows += [(4000 + i, [2.0] * 15 + [2.0 + (i + 1) * 1e-13], 1) for i in range(60)]  # nearly ties, all distinct
    df = spark.createDataFrame([(i, v) for i, v, _ in rows], "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "'x' AS tree")
    ok = {i: v for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and np.isfinite(v).all() and np.any(v)}
    got = nearest_lists(df, factor=1.0, shard=64, block=8)
    for q in (i for i in ok if i % 20 == 0):
        score = {}
        for i, v in ok.items():
            if i != q:
                score[i] = 0.0
                for a, b in zip(ok[q], v, strict=True):
                    score[i] += a * b
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [(k, i) for k, i, _ in sorted(got[q])] == list(enumerate(best, 1))
    assert set(got) == {i for i in ok if i % 20 == 0}
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0
    x = np.random.default_rng(8).standard_normal((2000, 4))
    tree = vptree.Tree(x, leaf=16)
    exact = np.argsort(((x[:50, None] - x) ** 2).sum(axis=2), axis=1, kind="stable")[:, :10]
    assert all(set(a) == set(b) for a, b in zip(tree.search(x[:50], 10)[0], exact, strict=True))
    assert tree.compared < 0.5 * 50 * 2000
    recall, share = vptree.recall_and_share(tree, x[:50], 10, 4.0)
    assert 0.3 < recall <= 1 and share < 0.2


@pytest.mark.parametrize("kind", ["spread", "clustered", "flat"])
def test_the_tuned_search_prunes_and_keeps_its_recall(spark, kind):
    rnd = np.random.default_rng(3)
    if kind == "clustered":
        centres = unit(rnd.standard_normal((40, 64)))
        x = unit(centres[rnd.integers(0, 40, 4000)] + 0.5 * unit(rnd.standard_normal((4000, 64))))
    else:
        x = unit(rnd.standard_normal((4000, 64 if kind == "spread" else 8)))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = nearest_lists(df, shard=1000)
    hits = [len({i for _, i, _ in got[q]} & set(np.argsort(-np.where(np.arange(4000) == q, -9, x @ x[q]))[:20].tolist())) for q in range(0, 4000, 20)]
    assert np.mean(hits) / 20 >= 0.9
    trees, *_ = vptree.index(df, shard=1000)
    assert vptree.tuned_factor(trees, 20) > 1


# ---------------------------------------------------------------- tokens


def test_packing(spark):
    rnd = random.Random(6)
    rows = EDGE + [(100 + i, " ".join(rnd.choice(["alpha", "beta,", "γ", "1.5", "don't", "\n"]) for _ in range(rnd.randint(0, 900)))) for i in range(150)] + [(500, "a <|endoftext|> b")]
    size = 512
    out = packing.pack(docs(spark, rows), P.path("byte_bpe_50k.json"), size, group=40).collect()
    ids = {}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in rows:
        ids[i] = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    pieces = Counter()
    for i, _ in rows:
        n = len(ids[i])
        cuts = [0, *range(n % size or size, n + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[i, k, a, b - a, zlib.crc32(np.array(ids[i][a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= size
    assert len(bins) <= 1.02 * -(-sum(r.length for r in out) // size) + 1
    assert packing.pack(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_sum_of_squares_against_a_plain_loop():
    rnd = np.random.default_rng(1)
    items, size = rnd.integers(1, 30, 300), 30
    bins, offsets, fill = packing.sum_of_squares(items, size)
    gaps, expected = [], []
    for s in items.tolist():
        def cost(gap_from):
            counts = Counter(gaps)
            if gap_from != size:
                counts[gap_from] -= 1
            if gap_from > s:
                counts[gap_from - s] += 1
            return sum(c * c for c in counts.values())

        choice = min([g for g in set(gaps) if g >= s] + [size], key=lambda g: (cost(g), g))
        if choice != size:
            gaps.remove(choice)
        if choice > s:
            gaps.append(choice - s)
        expected.append(choice)
    gap_before = [size - o if o else size for o in offsets.tolist()]
    assert gap_before == expected and fill.sum() == items.sum()


@pytest.mark.parametrize("shared", [300_000, 40, 0])
def test_sentencepiece(spark, monkeypatch, shared):
    monkeypatch.setattr(spm, "SHARED", shared)
    monkeypatch.setattr(spm, "COUNTED", 50)
    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rnd = random.Random(3)
    rows = EDGE + [(100 + i, "".join(rnd.choice(" ▁ab\n\té一\U0001f600\x00<s>") for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    for r, (i, t) in zip(sorted(map(tuple, spm.encode_decode(docs(spark, rows), model).collect())), sorted(((i, t) for i, t in rows), key=lambda x: (x[0], sp.encode(x[1] or ""))), strict=True):
        ids = sp.encode(t or "")
        assert (r[0], r[1], r[2]) == (i, ids, sp.decode(ids) if ids else "")
    assert spm.encode_decode(docs(spark, []), model).count() == 0


def test_shared_words_are_the_most_frequent(spark, monkeypatch):
    texts = [(i, " ".join(f"w{k}" for k in range(60) if i % (k + 1) == 0)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    times = Counter(w for _, t in texts for w in spm.Codec.words(t))
    monkeypatch.setattr(spm, "SHARED", 25)
    got = {r.word for r in spm.shared_words(df.select("text")).collect()}
    assert 20 <= len(got) <= 25 and min(times[w] for w in got) > max(times[w] for w in times if w not in got)
    model = P.path("piece_bpe_32k.model")
    table = spm.shared_table(df.select("text"), model)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {w: np.frombuffer(x, "<i4").tolist() for w, x in table.items()} == {w: sp.encode(w) for w in got}


# ---------------------------------------------------------------- language and quality


def prose(rnd, lang, n):
    words = {"en": "the and of thing river stone walking", "de": "und der die straße können wälder nicht", "fr": "le la et où être rivière pierre", "es": "el los que niño río piedra caminando"}[lang].split()
    return " ".join(rnd.choice(words) for _ in range(n))


def test_language_id(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, lang, rnd.randint(3, 60)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "the river", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'c' AS lang_pred", "'d' AS score")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.fit(df)).collect()}
    held = [i for i, *_ in rows[:240] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i][0] == rows[i][2] for i in held]) >= 0.95
    assert got[1000] == got[1001] == ("und", 0.0) and got[1002][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    one = langid.fit(df.filter("lang = 'de'"))
    assert {r.lang_pred for r in langid.identify(df, one).collect()} == {"und", "de"}
    flags = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out("doc_id").alias("h")).collect()}
    assert all(v == (zlib.crc32(str(i).encode()) % 5 == 0) for i, v in flags.items())
    assert spark.createDataFrame([(None,)], "doc_id long").select(langid.held_out("doc_id").alias("h")).first().h is False
    long = spark.createDataFrame([(1, prose(rnd, "de", 200_000)), (2, "x" * 2_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(long, langid.fit(df)).collect()}[1] == "de"


def test_importance_resampling(spark):
    rnd = random.Random(4)
    good = [(i, prose(rnd, "en", 40)) for i in range(200)]
    bad = [(1000 + i, " ".join(f"{w}!!" for w in prose(rnd, "en", 40).upper().split())) for i in range(60)]
    rows = good + bad + [(5000, None), (5001, " "), (0, good[0][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:80]] + [(i, 0, 0) for i, _ in bad[:20]] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.resample(docs(spark, rows), labels, recall=0.999)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert np.mean([got[i].kept for i, _ in good]) > 0.97 and not any(got[i].kept for i, _ in bad)
    assert not got[5000].kept and got[5000].log_weight is None and not got[5001].kept

    # all weights and the kept set, by a plain loop over words
    def bucket(word):
        buf, off = T.utf8(pa.array([word]))
        return T.word_hashes(buf, off, lower=False)[0][0]

    def grams(t):
        w = [bucket(x) for x in (t or "").split()]
        pairs = [T.mix(np.array([a * np.uint64(3) + b]))[0] for a, b in zip(w, w[1:], strict=False)]
        return [int(x % np.uint64(quality.BUCKETS)) for x in w + pairs]

    counts, wanted = Counter(), Counter()
    held = [(i, t, grams(t)) for i, t in rows]
    for i, _, g in held:
        counts.update(g)
        if i < 80:
            wanted.update(g)
    n, m = sum(counts.values()) + quality.BUCKETS, sum(wanted.values()) + quality.BUCKETS
    weight = [sum(np.log((wanted[x] + 1) / m) - np.log((counts[x] + 1) / n) for x in g) if g else None for _, _, g in held]
    noise = {r.doc_id: r.g for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").select("doc_id", quality.gumbel_key(F.lit(0.0), "doc_id", 17).alias("g")).distinct().collect()}
    for rate in (0.1, 0.5):
        sample = {(r.doc_id, r.log_weight is None): r for r in quality.resample(docs(spark, rows), labels, rate=rate).collect()}
        keys = sorted((w + noise[i], i) for (i, _, _), w in zip(held, weight, strict=True) if w is not None)
        least = keys[-int(np.ceil(rate * len(keys)))][0]
        for (i, _, _), w in zip(held, weight, strict=True):
            r = sample[i, w is None]
            assert w is None or r.log_weight == pytest.approx(w, abs=1e-8)
            assert r.kept == (w is not None and w + noise[i] >= least - 1e-9)
    assert quality.resample(docs(spark, rows), labels, k=50).filter("kept").count() == 50
    assert quality.resample(docs(spark, rows), labels, k=0).filter("kept").count() == 0
    free = quality.resample(docs(spark, rows), labels.limit(0), recall=0.999)
    assert free.filter("kept").count() == len(rows) - 2
    assert quality.resample(docs(spark, []), labels, rate=0.5).count() == 0
    ids = out.filter("kept").select(F.col("doc_id").alias("id")).distinct()
    before, after = quality.divergence(docs(spark, rows), ids, labels)
    assert 0 <= after < 0.5 * before


def test_kth_largest(spark):
    rnd = random.Random(8)
    x = [rnd.choice([rnd.gauss(0, 1), 3.0, -1e9]) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    for k in (1, 5, 3000, 9000):
        assert quality.kth_largest(df, "x", k) == sorted(x, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 9001) is None


# ---------------------------------------------------------------- URLs, pages, shards

URLS = [
    "http://a.b.net/x", "HTTP://WWW.Example.NET/en/1?x=/de/", "https://example.net/EN/", "https://example.com/de/", "https://badexample.com/de/", "http://x.org/fr/a#b", "http://x.org/fr", "http://net/", "http://net",
    "http://cheap-pills.example.org/a", "http://my-cheap-pills-x.org", "no scheme", "://", None, "http://h/a\nb", "http://sub.casino.de/wp-login.php", "http://z.de/wp-login.php", "ftp://ÄB.org/fr/",
]


def test_url_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 AS host", "'x' AS tokens", "2 AS id")
    rules = urlrules.LIST_RULES + urlrules.PATTERNS
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = {}
    for i, u in enumerate(URLS):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(low), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for r, v in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")) for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        method = "block" if any(re.search(r.pattern, host + path, re.A) for r in urlrules.PATTERNS) else "allow"
        best = max(fits, default=None)
        expected[i] = (host, path, best and best[1], best[2] if best else method)
    many = [urlrules.list_rule("block", f"host{i}.example", f"/p{i}/") for i in range(5000)] + [urlrules.pattern_rule("block", "never-[0-9]+x")]
    for own in (rules, rules + many):  # the number of rules changes nothing
        out = urlrules.judge(df, own)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == expected
    asked = spark.createDataFrame([(1, "http://host7.example/p7/x"), (1, "http://ok.example/"), (None, "http://a.host8.example/p8/"), (None, "http://c/never-3x")], "page_id long, url string")
    got = sorted((str(r.page_id), str(r.rule), r.verdict) for r in urlrules.judge(asked, rules + many).collect())
    assert got == [("1", "None", "allow"), ("1", "host7.example/p7/", "block"), ("None", "None", "block"), ("None", "host8.example/p8/", "block")]
    plan = urlrules.judge(df, rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)
    assert "from_json" not in plan.split("== Optimized Logical Plan ==")[1]
    assert {r.verdict for r in urlrules.judge(df, []).collect()} == {"allow"}
    assert urlrules.judge(df.limit(0), rules).count() == 0


PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A{0}</a></li><li><a>B</a></li></ul></nav><div class="ad">Buy {0}</div><article><h1>Title &amp; {0}</h1><p><b>Bold {0}<br>next<p>Second   para {0}&nbsp;x</p></article><div id="comments"><p>reader {0}</p></div><footer>&copy; {0}</footer>'
PLAIN = '<body><div class="top-menu">Home</div><div class="x1"><h2>Head {0}</h2><p>Some text {0}</p><table><tr><td>c1<td>c2</table></div><form>mail {0}</form><aside>more {0}</aside></body>'


def test_wrappers(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(6)] + [(10 + i, f"https://B.example/{i}", PLAIN.format(i)) for i in range(6)]
    rows += [(20, "http://c.example/", None), (21, "http://c.example/", ""), (22, None, "just text"), (0, "http://a.example/0", PAGE.format(0)), (23, "http://d/", "<p>" + "long text " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'w' AS wrapper", "1 AS id", "'t' AS text")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    for i in range(6):
        assert got[i] == f"Title & {i}\n\nBold {i} next\n\nSecond para {i} x"
        assert got[10 + i].split("\n\n")[:2] == [f"Head {i}", f"Some text {i}"] and "mail" not in got[10 + i] and "more" not in got[10 + i]
    assert got[20] == got[21] == "" and got[22] == "just text" and len(got[23]) == 10 * 50_000 - 1
    assert wrapper.main_text(df).count() == len(rows) and wrapper.main_text(df.limit(0)).count() == 0


def test_wrapper_alignment_finds_optional_and_repeated_groups():
    a = wrapper.wrapped(wrapper.parse("<div><h1>x</h1><p>1</p><p>2</p></div>"))
    b = wrapper.wrapped(wrapper.parse("<div><h1>y</h1><hr><p>3</p></div>"))
    div = wrapper.merged(a, b)[3][0]
    assert [(k[0], k[1], k[2]) for k in div[3]] == [("h1", False, False), ("hr", True, False), ("p", False, True)]
    assert json.loads(json.dumps(div)) == div


def test_alignment_is_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in "xy")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = wrapper.aligned(a, b)
        both = [(i, j) for i, j in got if i is not None and j is not None]
        assert len(both) == best[len(a)][len(b)] and all(a[i] == b[j] for i, j in both)
        assert [i for i, _ in got if i is not None] == list(range(len(a))) and [j for _, j in got if j is not None] == list(range(len(b)))


NAMES = ["x", "related-work", "legal-news", "social-history", "header-title", "form-factor", "comment-free-guide", "has-sidebar"]
ITEMS = "".join(f"<li>item {k}</li>" for k in range(100))
TEMPLATES = {
    "article": '<body><nav><a href=x>Home</a></nav><article class="{c}"><h1>T{i}</h1><h2>Summary</h2><p>text {i} here</p><h2>Method</h2><ul>' + ITEMS
    + '</ul><p><a href=y>more {i}</a></p><div class="ad">buy</div><div class="comment-list"><p>nice {i}</p></div></article><footer>f</footer></body>',
    "main": '<body><header>Site</header><div class="{c}"><main><h1>T{i}</h1><h2>Summary</h2><p>text {i} here</p><h2>Method</h2><ol>' + ITEMS
    + '</ol><p>more {i}</p><aside>see</aside></main></div><div id="cookie-notice">We use</div></body>',
    "plain": '<body><div class="top-menu"><a href=x>Home</a></div><div class="{c}"><h1>T{i}</h1><h2>Summary</h2><p>text {i} here</p><h2>Method</h2><ul>' + ITEMS
    + '</ul><p>more {i}</p></div><div class="site-footer">foot</div><div class="comments"><p>nice {i}' + " so nice" * 500 + "</p></div></body>",
    "table": '<body><form>find</form><div class="{c}"><h1>T{i}</h1><h2>Summary</h2><table><tr><td>text {i} here</table><h2>Method</h2><dl>' + ITEMS.replace("li>", "dd>")
    + '</dl><p>more {i}</p></div><div class="newsletter-box">mail {i}</div></body>',
}


@pytest.mark.parametrize("template", TEMPLATES)
def test_wrappers_keep_articles_whole_whatever_the_names_and_the_pages(template):
    for c in NAMES:
        for n in (1, 2, 50):
            pages = [wrapper.parse(TEMPLATES[template].format(c=c, i=i)) for i in range(n)]
            whole = None
            for p in pages:
                whole = wrapper.wrapped(p) if whole is None else wrapper.merged(whole, wrapper.wrapped(p))
            decided = wrapper.decide(whole)
            for i, p in enumerate(pages):
                assert wrapper.extract(p, decided) == [f"T{i}", "Summary", f"text {i} here", "Method", *(f"item {k}" for k in range(100)), f"more {i}"]


def test_wrappers_learn_fixed_slots_outside_the_body():
    page = "<body><div class=a>Our site since 1999</div><div class=b><h1>T{i}</h1><h2>Summary</h2><p>text {i} and more</p></div><div class=c>All rights</div></body>"
    whole = None
    for i in range(9):
        one = wrapper.wrapped(wrapper.parse(page.format(i=i)))
        whole = one if whole is None else wrapper.merged(whole, one)
    assert wrapper.extract(wrapper.parse(page.format(i=3)), wrapper.decide(whole)) == ["T3", "Summary", "text 3 and more"]


def test_wrappers_are_bounded_and_lose_nothing():
    letters = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnop"]
    pages = [f"<body><div class=n{x}><p>text {x}</p></div></body>" for x in letters]
    whole = None
    for p in pages:
        one = wrapper.wrapped(wrapper.parse(p))
        whole = one if whole is None else wrapper.merged(whole, one)
    assert wrapper.size(whole) <= 4 * wrapper.KIDS
    decided = wrapper.decide(whole)
    assert [wrapper.extract(wrapper.parse(p), decided) for p in pages] == [[f"text {x}"] for x in letters]
    long = "<body><article>" + "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(3000)) + "</article></body>"
    one = wrapper.wrapped(wrapper.parse(long))
    assert len(wrapper.extract(wrapper.parse(long), wrapper.decide(wrapper.merged(one, one)))) == 6000
    deep = wrapper.parse("<div>" * 5000 + "text")
    assert wrapper.extract(deep, wrapper.decide(wrapper.wrapped(deep))) == ["text"]


def test_decisions_of_hosts_beyond_the_broadcast_are_joined(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example/{i}", PAGE.format(i)) for i in range(60)] + [(None, None, PAGE.format(7)), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    every = sorted(map(str, wrapper.main_text(df).collect()))
    monkeypatch.setattr(wrapper, "HELD", 2)
    assert sorted(map(str, wrapper.main_text(df).collect())) == every
    monkeypatch.setattr(wrapper, "BROADCAST", 0)
    monkeypatch.setattr(wrapper, "NODES", 10)
    assert sorted(map(str, wrapper.main_text(df).collect())) == every


def test_wrapper_equals_brute_force_on_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    for r in df.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("key", [None, "source"])
def test_extendible_hashing(spark, key):
    rows = [(i, "x" * (i % 50), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)] + [(9000, None, None), (9001, "y" * 5000, "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS shard", "2 AS id", "'z' AS cell")
    out = sharding.assign(df, 2000, key).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in rows)
    size, count = Counter(), Counter()
    for r in out:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
        assert len(r.shard) == r.depth
    assert all(size[s] <= 2000 or count[s] == 1 for s in size)

    def bits(x):
        return format(int(hashlib.md5((x or "").encode()).hexdigest()[:15], 16), "060b")

    address = {i: (bits(s) if key else "") + bits(str(i)) for i, _, s in rows}
    length = {i: len((t or "").encode()) for i, t, _ in rows}
    for r in out:
        assert address[r.doc_id].startswith(r.shard)
        if r.depth:  # its parent had to split
            inside = [i for i in address if address[i].startswith(r.shard[:-1])]
            assert sum(length[i] for i in inside) > 2000 and len(inside) > 1
    assert sharding.assign(df.limit(0)).count() == 0


def test_sharded_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string")
    sharding.write(df, str(tmp_path / "out"), 4000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    assert len(list((tmp_path / "out").glob("shard=*"))) > 3


def test_edges_in_every_text_operator(spark):
    df = docs(spark, EDGE)
    assert sharding.assign(df).count() == len(EDGE)
    assert langid.identify(df, langid.Model([])).filter(F.col("lang_pred") != "und").count() == 0


def extracted(pages):
    """Blocks of each page of one host."""
    whole = None
    for p in pages:
        one = wrapper.wrapped(wrapper.parse(p))
        whole = one if whole is None else wrapper.merged(whole, one)
    decided = wrapper.decide(whole)
    return [wrapper.extract(wrapper.parse(p), decided) for p in pages]


HOSTS = [1, 2, 3, 50]


@pytest.mark.parametrize("n", HOSTS)
def test_wrappers_keep_a_paragraph_that_is_a_link(n):
    page = "<div class=main><h1>T{i}</h1><p>one {i}</p><p><a href=x>{long}</a></p><p>three {i}</p></div>"
    pages = [page.format(i=i, long=f"a link that is longer than all the rest of the text {i} " * 5) for i in range(n)]
    assert [[b.split(" {")[0][:5] for b in p] for p in extracted(pages)] == [[f"T{i}", "one " + str(i)[:1], "a lin", "three"] for i in range(n)]


@pytest.mark.parametrize("n", HOSTS)
def test_wrappers_see_through_a_form_around_the_page(n):
    marked = "<body><form id=aspnet><input type=hidden><nav><a href=x>menu</a></nav><article><h1>T{i}</h1><p>text {i}</p><form><p>Sign up</p></form></article></form></body>"
    assert extracted([marked.format(i=i) for i in range(n)]) == [[f"T{i}", f"text {i}"] for i in range(n)]
    plain = "<body><form id=aspnet><div id=a><h1>T{i}</h1><p>text {i} that goes on for a while</p></div></form></body>"
    assert extracted([plain.format(i=i) for i in range(n)]) == [[f"T{i}", f"text {i} that goes on for a while"] for i in range(n)]
    lone = "<body><div id=a><h1>T{i}</h1><p>text {i} that goes on for a while</p></div><form><p>Search all {i}</p></form></body>"
    assert extracted([lone.format(i=i) for i in range(n)]) == [[f"T{i}", f"text {i} that goes on for a while"] for i in range(n)]


@pytest.mark.parametrize("n", HOSTS)
@pytest.mark.parametrize("name", ["discussion", "reader", "search", "notice", "legal", "copyright", "form", "menu", "related", "social", "banner", "alerts"])
def test_wrappers_keep_sections_of_an_article_by_such_names(n, name):
    page = f"<article><h1>T{{i}}</h1><p>text {{i}}</p><section id={name}><h2>H</h2><p>more {{i}}</p></section><section id=comments><p>Nice {{i}}</p></section><div class=ad>Buy {{i}}</div></article>"
    assert extracted([page.format(i=i) for i in range(n)]) == [[f"T{i}", f"text {i}", "H", f"more {i}"] for i in range(n)]


@pytest.mark.parametrize("n", HOSTS)
def test_wrappers_read_on_behind_deep_nesting(n):
    deep = "<div>" * 130 + "inside {i}" + "</div>" * 130
    page = f"<article><p>one {{i}}</p>{deep}<p>two {{i}}</p></article><footer>foot {{i}}</footer>"
    assert extracted([page.format(i=i) for i in range(n)]) == [[f"one {i}", f"inside {i}", f"two {i}"] for i in range(n)]


def test_wrappers_drop_a_shared_footer_as_soon_as_two_pages_tell():
    page = "<div><div><h1>T{i}</h1><p>text {i} goes on</p></div><div>All rights reserved</div></div>"
    for n in (2, 3, 50):
        assert extracted([page.format(i=i) for i in range(n)]) == [[f"T{i}", f"text {i} goes on"] for i in range(n)]
    assert extracted([page.format(i=0)])[0][:2] == ["T0", "text 0 goes on"]
    same = [page.format(i=1)] * 2  # copies tell nothing apart, and lose nothing
    assert extracted(same)[0][:2] == ["T1", "text 1 goes on"]


def test_wrappers_with_more_kinds_of_children_than_are_told_apart():
    for kinds in (wrapper.KIDS - 1, wrapper.KIDS, wrapper.KIDS + 1, 3 * wrapper.KIDS):
        name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
        page = "<article>" + "".join(f"<div class=x{name(k)}>t{k} {{i}}</div>" for k in range(kinds)) + "</article>"
        assert extracted([page.format(i=i) for i in range(3)]) == [[f"t{k} {i}" for k in range(kinds)] for i in range(3)]
