"""Stages of the pipeline against brute force."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from helixframe.llm import quality


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(60))
    near = lambda t: f"{t} tail"
    a, b, c, d, e = (text() for _ in range(5))
    rows = [
        (None, a), (None, b), (None, near(b)), (7, near(b)),  # alone without id; a group whose least id is 7
        (3, c), (3, c), (3, near(c)), (2, near(c)),  # repeated row, repeated id
        (4, d), (4, e), (None, None), (9, ""), (10, ""), (None, d), (5, near(a)), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in rows], "doc_id long, text string, lang string, source string").repartition(3)

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    groups = []
    for i, t in dict.fromkeys(rows):
        mine = shingles(t)
        linked = [g for g in groups if any(mine and len(mine & shingles(x)) >= 0.8 * len(mine | shingles(x)) for _, x in g)]
        groups = [g for g in groups if g not in linked] + [[(i, t), *(r for g in linked for r in g)]]
    want = []
    for g in groups:
        least = min((i is None, i or 0) for i, _ in g)
        want.append([r for r in g if (r[0] is None, r[0] or 0) == least])
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(out) == len(groups) and max(Counter(out).values()) == 1
    for candidates in want:
        assert len([r for r in out if r in candidates]) == 1


DOCS = "doc_id long, text string, lang string, source string, row_key int, lang_found string, lang_score double, log_weight double, gumbel_key string"


def prose(rnd, lang, n):
    words = {"en": "the and of thing river stone walking", "de": "und der die straße können wälder nicht", "fr": "le la et où être rivière pierre", "es": "el los que niño río piedra caminando"}[lang].split()
    return " ".join(rnd.choice(words) for _ in range(n))


def rows_of(rnd):
    rows = [(i, prose(rnd, lang, rnd.randint(20, 80)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 40)]
    rows += [rows[5], rows[5], (None, rows[7][1], "fr"), (None, None, None), (None, None, None), (500, None, "en"), (501, "", None), (502, " \n", "en"), (503, "12 34 !!", "de")]
    rows += [(504, " ".join(f"{w}{k}" for k, w in enumerate(prose(rnd, "en", 60_000).split())), "en"), (505, rows[5][1], None), (506, prose(rnd, "de", 40), None)]
    return rows


def table_of(spark, rows):
    clash = (7, "a", 0.5, 1.5, "k")
    return spark.createDataFrame([(i, t, lang, "s", *clash) for i, t, lang in rows], DOCS)


@pytest.fixture
def sf(spark, tmp_path):
    rows = rows_of(random.Random(3))
    table_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 2 == 0), 0) for i in range(100)] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def seen(df):
    assert df.columns == [c.split()[0] for c in DOCS.split(", ")]
    out = df.collect()
    assert all(tuple(r)[4:] == (7, "a", 0.5, 1.5, "k") for r in out)
    return Counter((r.doc_id, r.text, r.lang) for r in out)


def test_language_rejects_texts_without_a_letter_and_no_clean_one(spark, sf):
    folder, rows = sf
    got = seen(corpus_pipeline.language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    assert got == Counter(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))


def test_selection_keeps_what_the_target_is_like(spark, sf):
    folder, rows = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = seen(corpus_pipeline.selection(spark, docs, folder))
    whole = {}
    for r in quality.resample(docs, spark.read.parquet(f"{folder}/labels.parquet"), recall=corpus_pipeline.RECALL, seed=corpus_pipeline.SEED).collect():
        whole.setdefault((r.doc_id, r.log_weight is None), set()).add(r.kept)
    assert not any(not (t or "").strip() for _, t, _ in got)
    for r in rows:
        kept = whole[r[0], not (r[1] or "").strip()]
        assert got[r] == (rows.count(r) if kept == {True} else 0)
    assert sum(got[r] for r in rows[:100:2]) >= 49
    assert seen(corpus_pipeline.selection(spark, docs.limit(0), folder)) == Counter()


def test_every_stage_takes_an_empty_table(spark, sf):
    folder, _ = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert [stage(spark, docs, folder).count() for _, stage in corpus_pipeline.STAGES] == [0] * 4


def test_run_gives_what_its_stages_give(spark, sf):
    folder, rows = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        seen(docs)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in docs.collect():
        tokens[r.doc_id] += len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    placed = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        placed[r.doc_id] += r.length
    assert placed == tokens and 500 not in placed and 505 not in placed
