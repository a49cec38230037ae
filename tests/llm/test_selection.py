"""Head-tail resampling, host rules and zone-map clustering against plain loops, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import _text, headtail, hostrules, zonemaps

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ["'x' AS id", "1 AS n", "'h' AS host", "2 AS weight", "3 AS place", "4 AS _part", "5 AS n_words", "'y' AS _text", "6 AS cluster", "7 AS v", "8 AS key", "true AS kept", "null AS h"]
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "One two"), (6, "a-b c_d E9"), (6, "a-b c_d E9"), (7, "word " * 30_000), (8, "é一\U0001f600 ñ\x00\x1cÀ"), (9, "q" * 5000 + " " + "r" * 63 + " " + "s" * 64 + " " + "t" * 65), (None, "no id " * 20), (10, "sixteen_bytes_ab abcdefghijklmnop abcdefghijklmnopq")]


def texts(spark, rows, extra=CLASH):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *extra)


# ---------------------------------------------------------------- 11


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return w, [x.encode() for x in w] + [f"{a} {b}".encode() for a, b in zip(w, w[1:])]


def plain_resample(rows, target, rate=(25, 100), least=20):
    buckets = lambda t: [zlib.crc32(f) % 10_000 for f in features(t)[1]]
    raw, want = Counter(b for _, t in rows for b in buckets(t)), Counter(b for t in target for b in buckets(t))
    s, t = sum(raw.values()) + 10_000, sum(want.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * t**0 * s / ((raw[b] + 1) * t)))
    out = []
    for i, text in rows:
        b = buckets(text)
        weight = sum(map(gain, b)) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(text)[0])])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    drawn = able[: rate[0] * len(able) // rate[1]]
    place = defaultdict(list)
    for k, r in enumerate(drawn):
        place[tuple(r[:4])].append(k + 1)
    got = []
    for r in out:
        left = place[tuple(r[:4])] if r[4] >= least else []
        got.append((*r[:4], left.pop(0) if left else None))
    return sorted(got, key=repr)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéß19") for _ in range(min(40, int(rnd.expovariate(0.2)) + 1))) for _ in range(300)]
    return [(k, " ".join(vocab[min(299, int(rnd.expovariate(0.02)))].upper() if rnd.random() < 0.1 else vocab[min(299, int(rnd.expovariate(0.02)))] + rnd.choice(["", ",", ".\n"]) for _ in range(rnd.randint(1, 200)))) for k in range(n)]


@pytest.mark.parametrize("head", [(16_384, 32_768), (40, 60), (0, 0)])
def test_resampling_equals_a_plain_loop_whatever_the_head(spark, monkeypatch, head):
    monkeypatch.setattr(headtail, "WORDS", head[0])
    monkeypatch.setattr(headtail, "PAIRS", head[1])
    rows = corpus(3) + EDGE
    target = [t for _, t in corpus(4, 10)] + [None, ""]
    df = texts(spark, [(*r, "s") for r in rows])
    got = headtail.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, target)


def test_resampling_of_ties_and_empty_tables(spark):
    same = [(7, "alpha beta " * 15, "s")] * 40 + [(None, "alpha beta " * 15, "s")] * 3
    got = headtail.resample(texts(spark, same), spark.createDataFrame([("alpha",)], "text string")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
    none = headtail.resample(texts(spark, []), spark.createDataFrame([], "text string"))
    assert none.collect() == []
    lone = headtail.resample(texts(spark, [(1, "w " * 25, "s")] * 4), spark.createDataFrame([], "text string")).collect()
    assert [r["rank"] for r in lone if r["rank"]] == [1]


def test_words_and_crc_states_follow_the_bytes():
    rnd = random.Random(5)
    rows = ["".join(rnd.choice("aZ09-_ é一\x00\x7f") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, "", "x" * 1000, "y" * 64, "z" * 65]
    raw, off = _text.utf8(pa.array(rows, pa.string()))
    w = headtail.words(raw, off)
    plain = [(k, x.encode()) for k, t in enumerate(rows) for x in WORD.findall((t or "").translate(LOW))]
    assert [(int(r), w.bytes_at(k)) for k, r in enumerate(w.row)] == plain
    before = np.array([rnd.randrange(2**32) for _ in plain], np.uint32)
    got = headtail.crc_from(before, w.buf, w.at, w.size)
    assert got.tolist() == [zlib.crc32(x, int(b)) for (_, x), b in zip(plain, before)]


def test_a_tasks_table_of_counts_stays_bounded():
    held = headtail._Counts(10)
    for k in range(50):
        held.add(np.repeat(np.arange(100, dtype=np.uint64) + np.uint64(100 * k), 2), lambda x: b"t")
        held.add(np.repeat(np.uint64(7), 50), lambda x: b"often")
    assert len(held.key) <= 140 and held.n[held.key == 7][0] >= 2500


# ---------------------------------------------------------------- 12


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    inside = {i + o for i, x in enumerate(wins) if n[x] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(inside)


def noisy(seed, n):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        size = rnd.choice([0, 1, 2, 3, 10, 60, 200])
        out.append("".join(rnd.choice(["a", "bb", "ccc", "#", "$x", "é", "\U0001f600"]) + rnd.choice([" ", "  ", "\n", "\t", "\x0b", " "]) for _ in range(size)))
    return out


def test_document_counts_equal_a_plain_loop(spark):
    rows = [(k, t, "s") for k, t in enumerate(noisy(1, 200) + [None, "", "\n\n", "a a a a", "a b c x a b c", "a b a b a b", "w " * 3000, "line\nline\nline ", "l\r\nl\r\n"])]
    got = hostrules.counts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in got.collect()} == {k: plain_counts(t) for k, t, _ in rows}


def plain_rates(rows, rule):
    """host -> shrunk rate, from (host, failed)."""
    hosts = defaultdict(list)
    for h, f in rows:
        if h is not None:
            hosts[h].append(f)
    n = sum(map(len, hosts.values()))
    m = sum(map(sum, hosts.values())) / n
    more = len(hosts) - 1
    room = n - sum(len(f) ** 2 for f in hosts.values()) / n - more
    if not 0 < m < 1 or room <= 0:
        return dict.fromkeys(hosts, m)
    r = (sum(len(f) * (sum(f) / len(f) - m) ** 2 for f in hosts.values()) / (m * (1 - m)) - more) / room
    if r <= 0:
        return dict.fromkeys(hosts, m)
    a = (1 - min(r, 1)) / r
    return {h: (sum(f) + m * a) / (len(f) + a) for h, f in hosts.items()}


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_host_verdicts_equal_a_plain_loop(spark, monkeypatch, broadcast):
    monkeypatch.setattr(hostrules, "BROADCAST_HOSTS", broadcast)
    rnd = random.Random(8)
    rows = []
    for host, n, bad in (("clean", 60, 0.05), ("junk", 50, 0.9), ("hot", 300, 0.1), ("lone", 1, 1.0), ("pair", 2, 0.5), (None, 30, 0.9), ("", 10, 0.0)):
        for _ in range(n):
            form = "## $$ %% {} **" if rnd.random() < bad else "word{} of{} the text{}"
            rows.append((len(rows), " ".join(form.format(*(rnd.randrange(10**6) for _ in range(3))) for _ in range(20)), host))
    rows += [(None, None, "clean"), (5, "short", None), (5, "short", "junk")]
    got = hostrules.judge(texts(spark, rows, CLASH))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"]
    c = [plain_counts(t) for _, t, _ in rows]
    rules = {
        "few_words": lambda w, ch, s, n, d, r: w < 50,
        "repeated_words": lambda w, ch, s, n, d, r: 100 * r > 50 * w,
        "word_length": lambda w, ch, s, n, d, r: w > 0 and not 3 * w <= ch <= 10 * w,
        "symbols": lambda w, ch, s, n, d, r: 10 * s > w,
        "repeated_lines": lambda w, ch, s, n, d, r: 100 * d > 30 * n,
    }
    assert rules.keys() == hostrules.RULES.keys()
    bad = {h for f in rules.values() for h, p in plain_rates([(h, f(*x)) for (_, _, h), x in zip(rows, c)], f).items() if p > 0.5}
    assert "junk" in bad and not bad & {"clean", "hot", ""}
    want = []
    for (i, _, h), x in zip(rows, c):
        base = rules["few_words"](*x) or rules["repeated_words"](*x)
        want.append((i, x[0], x[1], x[2], x[4], x[5], base, h in bad, not base and h not in bad))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_prior_of_like_hosts_outweighs_one_document(spark):
    rows = [(k, (k % 10 < h % 3), f"h{h}") for h in range(12) for k in range(100)] + [(0, True, "lone")]
    df = spark.createDataFrame(rows, "k long, bad boolean, host string")
    got = {r["host"]: r["bad"] for r in hostrules.host_rates(df, "host", {"bad": "bad"}).collect()}
    want = plain_rates([(h, b) for _, b, h in rows], "bad")
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-12 for h in want) and got["lone"] < 0.2


def test_host_rules_of_one_host_and_of_none(spark):
    assert hostrules.judge(texts(spark, [])).collect() == []
    rows = [(k, " ".join(f"word{k}x{j}" for j in range(60)), "only") for k in range(5)]
    assert [r["host_failed"] for r in hostrules.judge(texts(spark, rows)).collect()] == [False] * 5
    null = [(k, None, None) for k in range(3)]
    assert [(r["n_words"], r["kept"]) for r in hostrules.judge(texts(spark, null)).collect()] == [(0, False)] * 3


def test_host_rules_stay_inside_the_jvm(spark):
    plan = hostrules.judge(texts(spark, [(1, "a", "s")]))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- 13


@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 3), (3, 2), (5, 2)])
def test_hilbert_order_visits_neighbouring_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in zonemaps.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def plain_clusters(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(scale * x) < zonemaps.REACH for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, one), j) for j, one in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, a) in zip(kept, near) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    total = Counter()
    for d, j in near:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted((i, j, d, total[j], sum(total.values()), sha[j]) for (i, _), (d, j) in zip(kept, near))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", *CLASH)


@pytest.mark.parametrize("spread", [0.05, 1.0, 3e4])
def test_clusters_equal_a_plain_loop(spark, monkeypatch, spread):
    monkeypatch.setattr(zonemaps, "BLOCK", 16)
    rnd = np.random.default_rng(2)
    middle = rnd.normal(size=(6, 64))
    rows = [(k, np.float32(middle[k % 6] + spread * rnd.normal(size=64)).tolist()) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(40)] + [rows[4]] * 3
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [1e30] * 64]
    rows += [(300 + k, v) for k, v in enumerate(bad)] + [(None, rows[0][1]), (400, [0.0] * 64)]
    got = zonemaps.cluster(vectors(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == plain_clusters(rows)


def test_few_vectors_and_none(spark):
    rows = [(k, [float(k)] * 64) for k in range(5)] + [(9, None)]
    assert sorted(map(tuple, zonemaps.cluster(vectors(spark, rows)).collect())) == plain_clusters(rows)
    none = zonemaps.cluster(vectors(spark, [(1, None)]))
    assert none.collect() == [] and none.columns[0] == "vec_id"


def test_boxes_spare_comparisons_and_lose_none(spark):
    rnd = np.random.default_rng(4)
    middle = 20 * rnd.normal(size=(8, 64))
    rows = [(k, np.float32(middle[k % 8] + 0.1 * rnd.normal(size=64)).tolist()) for k in range(4000)]
    v = zonemaps.integer_vectors(vectors(spark, rows), 64, 64, "vec_id", "embedding")
    start = np.array(zonemaps.first_centroids(v, 16, 1), np.int64)
    cut = zonemaps.blocks(v, 64, 64)
    new, work = zonemaps.one_round(cut, start)
    assert work["pairs"] == 16 * 4000 and work["compared"] < 0.5 * work["pairs"]
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    near = ((x[:, None] - start) ** 2).sum(axis=2).argmin(axis=1)
    assert (new == [np.floor_divide(x[near == j].sum(axis=0), (near == j).sum()) if (near == j).any() else start[j] for j in range(16)]).all()


# ---------------------------------------------------------------- evidence of a language, and sharded files


def tongue(rnd, letters, n):
    """A made-up language: words from a few syllables."""
    syllables = ["".join(rnd.choices(letters, k=rnd.randint(2, 3))) for _ in range(25)]
    return lambda k: " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(k))


def test_junk_and_other_languages_lack_evidence(spark):
    from helixframe.llm import langid

    rnd = random.Random(31)
    speak = {lang: tongue(rnd, letters, 0) for lang, letters in (("en", "abcdefgh"), ("de", "bcdfgklm"), ("fr", "aeioulnr"), ("es", "aeiostrv"))}
    other = tongue(rnd, "kwxyzqjua", 0)
    rows = [(k, speak[lang](rnd.randint(1, 80)), lang) for k, lang in enumerate(["en", "de", "fr", "es"] * 120)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    fresh = [(k, speak[lang](rnd.randint(1, 60)), True) for k, lang in enumerate(["en", "de", "fr", "es"] * 50)]
    junk = [(1000 + k, other(rnd.randint(8, 60)), False) for k in range(50)] + [(2000 + k, " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20)), False) for k in range(50)]
    odd = [(3000, None, False), (3001, "", False), (3002, "12 34", False)]
    got = langid.identify(spark.createDataFrame(fresh + junk + odd, "doc_id long, text string, want boolean").withColumn("sure", F.lit(1)), model, sure_out="sure").collect()
    assert [r.doc_id for r in got if r.want and not r.sure] == []
    assert [r.doc_id for r in got if not r.want and r.sure] == []
    # the evidence is the mean log share of the text's n-grams
    from helixframe.llm._text import utf8

    for r in got[:20] + got[210:230]:
        buf, off = utf8(pa.array([r.text]))
        grams, _ = langid._grams(buf, off)
        limit, spread = model.limits[r.lang_pred]
        seen = sum(float(model.logs[r.lang_pred][g]) for g in grams.tolist()) / max(1, len(grams))
        assert r.sure == (not len(grams) or seen >= limit - langid.SLACK * spread / math.sqrt(len(grams)))
    none = langid.identify(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), langid.Model([]), sure_out="sure").first()
    assert (none.lang_pred, none.sure) == (langid.UND, False)


@pytest.mark.parametrize("key", [None, "source"])
def test_sharded_files_hold_every_row_once(spark, tmp_path, key):
    from helixframe.llm import sharding

    rnd = random.Random(33)
    rows = [(rnd.choice([None, *range(60)]), "x" * rnd.randint(0, 90), rnd.choice([None, "", "hot", "a", "b"])) for _ in range(400)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, source string, shard string, address1 int")
    sharding.write(df, str(tmp_path / "out"), 700, key)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter(rows)
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {"own"}
    told = {(r.doc_id, r.shard) for r in sharding.assign(df, 700, key).collect()}
    assert {(r.doc_id, r["shard_"][1:]) for r in back.collect()} == told and len({s for _, s in told}) > 3
