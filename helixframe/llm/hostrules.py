"""Quality rules judged by the document and by the host.

Every document gets the counts that the rules read, in one pass inside the JVM.
``BASE`` rules reject a document by itself. The share of a host's documents that
fail a rule is then a verdict on the host: rates are shrunk towards the mean of
all hosts by a beta prior that the hosts themselves give (its strength by the
method of moments), so that a host of few documents isn't judged by chance, and
a host whose shrunk rate of any rule is above ``LIMIT`` is rejected with all its
documents.

Counts are written once, a narrow row a document; texts are never shuffled. Host
rates come from sums with map-side combining, so a host of a third of all rows is
no hot key. Only rejected hosts are joined back: broadcast up to
``BROADCAST_HOSTS``, else by a shuffle of narrow rows in which each host is dealt
over ``SALTS`` parts.

Defined cases: a null text has no words and fails by its few words; lines end at
\\n alone; a text of fewer than three words has no window; a null host is no
host: its documents count for no host and are judged by themselves; rows with
null or repeated ids are judged one by one; with hosts that differ no more than
chance lets them, every shrunk rate is the mean; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, shuffles_deleted

#: Rules on the counts of a document; those of ``BASE`` reject it.
BASE = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
}
RULES = BASE | {
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
}
#: A host is rejected if its shrunk failure rate of any rule is above this.
LIMIT = 0.5
#: Rejected hosts that are broadcast: some 100 bytes each. More are joined by shuffle.
BROADCAST_HOSTS = 50_000
#: Parts over which one host's documents are dealt in that shuffle.
SALTS = 64

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` (of which none begins with an underscore), then n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one step a projection, so that no step's expression is copied into the lambdas of the next
    d = df.withColumn("_text", text).withColumns(
        {
            "_words": F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: _without(x, SPACES) != ""),
        }
    )
    d = d.withColumn("_n", F.size("_words"))
    window = lambda w, i: F.struct(F.concat_ws(" ", w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("w"), i.alias("i"))
    d = d.withColumn("_sorted", F.sort_array(F.transform(F.slice("_words", 1, F.greatest(F.col("_n") - 2, F.lit(0))), window)))
    # equal windows stand together
    equal = lambda x, k: F.coalesce(F.get("_sorted", k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["w"] == x["w"], F.lit(False))
    d = d.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", equal), lambda x: x["i"])))
    # words from i to i + 2 that no window before holds
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_starts", start, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")))
    long = lambda c: c.cast("long")
    return d.select(
        *df.columns,
        long(F.col("_n")).alias("n_words"),
        long(F.length(_without(F.col("_text"), SPACES))).alias("word_chars"),
        long(F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).alias("n_symbols"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(covered["n"]).alias("n_repeat_words"),
    )


def host_rates(counted: DataFrame, host_col: str, rules: dict[str, str] = RULES) -> DataFrame:
    """(host, n, <rule>...) with each rule's failure rate of a host, shrunk by the beta prior of all hosts.

    With pooled mean m, the prior's strength is (1 - r) / r, where r is the share of the hosts' variance beyond chance:
    ``(sum n (p - m)^2 / (m (1 - m)) - (H - 1)) / (N - sum n^2 / N - (H - 1))`` for H hosts of N documents.
    """
    failed = [F.sum(F.expr(cond).cast("long")).alias(name) for name, cond in rules.items()]
    hosts = counted.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), *failed)
    means = hosts.agg(F.sum("n").alias("_n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_n2"), F.count(F.lit(1)).alias("_h"), *[(F.sum(r) / F.sum("n")).alias(f"_m_{r}") for r in rules])
    spread = hosts.crossJoin(F.broadcast(means))  # one row
    spread = spread.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.col(f"_m_{r}"), F.lit(2))).alias(f"_s_{r}") for r in rules])
    out = hosts.crossJoin(F.broadcast(means)).crossJoin(F.broadcast(spread))
    return out.select("host", "n", *[_shrunk(r).alias(r) for r in rules])


def _shrunk(rule: str) -> Column:
    m, s, more = F.col(f"_m_{rule}"), F.col(f"_s_{rule}"), F.col("_h") - 1
    room = F.col("_n") - F.col("_n2") / F.col("_n") - more
    share = (s / (m * (1 - m)) - more) / room
    strength = (1 - F.least(share, F.lit(1.0))) / share
    shrunk = (F.col(rule) + m * strength) / (F.col("n") + strength)
    # hosts that agree, a rule that all or none fail, or too few documents to tell: the mean
    return F.when((m <= 0) | (m >= 1) | (room <= 0), m).when(share <= 0, m).otherwise(shrunk)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] = RULES, limit: float = LIMIT) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, kept) of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    with shuffles_deleted(df.sparkSession):
        counted = checkpointed(counts(rows).drop("text"))
        above = F.lit(False)
        for r in rules:
            above = above | (F.col(r) > limit)
        rejected = checkpointed(host_rates(counted, "host", rules).filter(above).select("host", F.lit(True).alias("host_failed")))
        few = rejected.count() <= BROADCAST_HOSTS
    if few:
        told = counted.join(F.broadcast(rejected), "host", "left")
    else:
        dealt = rejected.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = counted.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(dealt, ["host", "part"], "left")
    base = F.expr(" or ".join(f"({c})" for c in BASE.values()))
    told = told.withColumn("base_failed", base).withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return told.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", kept.alias("kept"))
