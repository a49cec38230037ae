"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import embed_dedup, headtail, hostrules, langid, minhash, packing, quality, sharding, spm, urlrules, vptree, wrapper, zonemaps
from ._common import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_sorted_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.LIST_RULES + urlrules.PATTERNS)


#: Budget of this query: the share of the documents to sample.
SAMPLE_RATE = 0.5


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rate=SAMPLE_RATE)


def op6_inferred_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    # exact, as SQL can then check every row; without a factor the search prunes to a recall of vptree.RECALL
    return vptree.nearest(rows, rows.filter("vec_id % 20 = 0"), factor=1.0)


#: Shards of this query, small enough that tables of a few megabytes split as well.
SHARD_BYTES = 256 << 10


def op8_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = spm.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op11_head_tail_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headtail.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op13_hilbert_zone_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_sorted_projection_dedup,
        op3_sum_of_squares_packing,
        op4_url_rules,
        op5_importance_resampling,
        op6_inferred_wrappers,
        op7_vantage_point_trees,
        op8_extendible_hashing,
        op9_sentencepiece_chunks,
        op10_superminhash_dedup,
        op11_head_tail_resampling,
        op12_host_rules,
        op13_hilbert_zone_clustering,
    )
}


def _url_sql() -> str:
    quoted = [(r, r.pattern.replace("'", "''")) for r in urlrules.LIST_RULES + urlrules.PATTERNS]
    listed = [f"CASE WHEN regexp_matches(t, '{p}') THEN {{'w': {r.weight}, 'rule': '{r.name}', 'verdict': '{r.verdict}'}} END" for r, p in quoted if r.weight]
    blocked = " OR ".join(f"regexp_matches(t, '{p}')" for r, p in quoted if not r.weight)
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
t AS (SELECT *, host || path AS t FROM u),
m AS (SELECT *, list_aggregate(list_filter([{", ".join(listed)}], lambda x: x IS NOT NULL), 'max') AS best FROM t)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""


def _crc_nibbles() -> str:
    """The CRC-32 steps of the sixteen values of half a byte, as a list in SQL."""
    steps = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        steps.append(str(x))
    return f"[{', '.join(steps)}]"


def _rule_sql() -> str:
    rules = list(hostrules.RULES)
    rates = ", ".join(f"sum({r}) / sum(n) AS {r}" for r in rules)
    spread = ", ".join(f"sum(h.n * (h.{r} / h.n - m.{r}) ** 2) AS {r}" for r in rules)
    share = lambda r: f"((s.{r} / nullif(m.{r} * (1 - m.{r}), 0) - (m.h - 1)) / nullif(m.room, 0))"
    shrunk = lambda r: f"CASE WHEN m.{r} <= 0 OR m.{r} >= 1 OR m.room <= 0 OR {share(r)} <= 0 THEN m.{r} ELSE (h.{r} + m.{r} * (1 - least({share(r)}, 1)) / {share(r)}) / (h.n + (1 - least({share(r)}, 1)) / {share(r)}) END"
    return f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
v AS (SELECT row_number() OVER () AS k, *, list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) AS wins FROM w),
x AS (SELECT k, unnest(wins) AS win, unnest(range(1, len(words) - 1)) AS i FROM v),
r AS (SELECT k, win, list(i) AS places FROM x GROUP BY k, win HAVING count(*) > 1),
p AS (SELECT k, count(DISTINCT i + o) AS n FROM (SELECT k, unnest(places) AS i FROM r), (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
d AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM v LEFT JOIN p USING (k)),
h AS (SELECT source, count(*) AS n, {", ".join(f"sum(({c})::INT) AS {r}" for r, c in hostrules.RULES.items())} FROM d WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT {rates}, count(*) AS h, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM h),
s AS (SELECT {spread} FROM h, m),
bad AS (SELECT source FROM h, m, s WHERE {" OR ".join(f"({shrunk(r)}) > {hostrules.LIMIT}" for r in rules)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM (SELECT d.*, {" OR ".join(f"({c})" for c in hostrules.BASE.values())} AS base_failed, bad.source IS NOT NULL AS host_failed FROM d LEFT JOIN bad USING (source))
"""


def _cluster_sql(rounds: int = 3) -> str:
    near = "list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x)"
    steps = [f"""
e AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS raw FROM embeddings WHERE len(embedding) = 64),
v AS (SELECT k, vec_id, list_transform(raw, lambda a: floor(64 * a)) AS x FROM e WHERE len(list_filter(raw, lambda a: a IS NULL OR NOT isfinite(a) OR abs(64 * a) >= {zonemaps.REACH})) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < 16)"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT k, vec_id, v.x, arg_min(c.c, ({near}, c.c)) AS cluster, min({near}) AS distance FROM v, c{r} c GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT cluster, i, floor(sum(y) / count(*)) AS y FROM (SELECT cluster, unnest(x) AS y, unnest(range(64)) AS i FROM a{r}) GROUP BY cluster, i)")
            steps.append(f"c{r + 1} AS (SELECT c.c, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT cluster, list(y ORDER BY i) AS x FROM s{r} GROUP BY cluster) n ON n.cluster = c.c)")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(c.x, lambda y: y::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = cluster
"""


_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
_RUNS = "unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f"

ORACLE_SQL: dict[str, str] = {
    "op11_head_tail_resampling": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_FEATURES} FROM documents),
f AS (SELECT k, f, count(*) AS n FROM (SELECT k, {_RUNS} FROM d) GROUP BY k, f),
g AS (SELECT f, count(*) AS n FROM (SELECT {_RUNS} FROM (SELECT {_FEATURES} FROM benchmark)) GROUP BY f),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
c AS (SELECT f, xor(list_reduce(list_transform(range(0, len(x)), lambda j: instr('0123456789ABCDEF', x[j + 2 * (1 - j % 2)]) - 1),
    lambda a, b: xor(a >> 4, {_crc_nibbles()}[xor(a, b) % 16 + 1]), 4294967295::BIGINT), 4294967295) % {headtail.BUCKETS} AS bucket FROM h),
s AS (SELECT bucket, sum(n) AS n FROM f JOIN c USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM g JOIN c USING (f) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) + {headtail.BUCKETS} AS s, (SELECT coalesce(sum(n), 0) FROM t) + {headtail.BUCKETS} AS t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * tot.s::DOUBLE / ((s.n + 1)::DOUBLE * tot.t::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), tot),
w AS (SELECT k, sum(n) AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM f JOIN c USING (f) JOIN gain USING (bucket) GROUP BY k),
o AS (SELECT d.k, d.doc_id, len(d.w) AS n_words, coalesce(w.n, 0)::BIGINT AS n_features, coalesce(w.weight, 0) AS weight,
    coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM o WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM r) THEN rank END AS rank FROM o LEFT JOIN r USING (k)
""",
    "op12_host_rules": _rule_sql(),
    "op13_hilbert_zone_clustering": _cluster_sql(),
    "op4_url_rules": _url_sql(),
    "op8_extendible_hashing": f"""
WITH d AS (SELECT doc_id, lpad(bin(('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT), 60, '0') AS address, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
p AS (SELECT k, left(address, k) AS shard, sum(n_bytes) AS b, count(*) AS c FROM d, (SELECT unnest(range(0, 33)) AS k) GROUP BY ALL),
f AS (SELECT k, shard FROM p WHERE b <= {SHARD_BYTES} OR c <= 1),
m AS (SELECT d.doc_id, d.address, d.n_bytes, min(f.k) AS depth FROM d JOIN f ON left(d.address, f.k) = f.shard GROUP BY ALL)
SELECT doc_id, left(address, depth) AS shard, depth::INT AS depth, n_bytes FROM m
""",
    "op2_sorted_projection_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
u AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.node = vec_id LEFT JOIN d ON d.a = vec_id
""",
    "op7_vantage_point_trees": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op10_superminhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))) END AS shingles FROM w),
d AS (SELECT doc_id, list_sort(shingles) AS shingles, len(shingles) AS n FROM s),
c AS (SELECT min(doc_id) AS rep, shingles, any_value(n) AS n FROM d WHERE n > 0 GROUP BY shingles),
x AS (SELECT rep, n, unnest(shingles) AS g FROM c),
p AS (
  SELECT a.rep AS u, b.rep AS v, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT u, v FROM p WHERE 100 * k >= 80 * (na + nb - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
m AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(m.component, c.rep, d.doc_id) AS component_id, coalesce(m.component, c.rep, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN c ON d.shingles = c.shingles AND d.n > 0 LEFT JOIN m ON m.node = c.rep
""",
}
