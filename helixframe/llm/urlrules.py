"""URL filtering with pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host || path`` together with literal
tokens that any URL it matches must hold. The index files each rule under the
one of its tokens that fewest rules use; a URL's own tokens fetch candidate
rules, and only those run their expression. Rules without a literal token are
candidates everywhere.

The index is a hash table in the plan: an array of buckets, where a token's
bucket is its CRC modulo their number, so a look-up reads one bucket whatever
the number of rules. It enters the plan as one JSON literal that Spark folds
into a constant before the job. Judging a URL is one projection: no join, no
shuffle, no row id, nothing outside the JVM. The rules are a list of the
driver, and each task receives them once, some 200 bytes a rule; more than
``LARGEST`` bytes are an error.

Defined cases: a null URL, or one without ``://``, has an empty host and path;
only A-Z of the host is lower-cased; of several list rules that fit the longest
wins, and a list rule always wins over patterns; ids may be null or repeat, as
each row is judged alone; an empty table gives an empty result; no rules allow
everything; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the index as JSON.
LARGEST = 64 << 20
TOKEN = "[a-z0-9]+"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``weight`` ranks list rules (their length) and is 0 for patterns."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    weight: int = 0


def list_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    body = re.sub(r"([^\w/])", r"\\\1", host + path)
    # the last token may go on in the URL unless something ends it
    tokens = re.findall(TOKEN, (host + path).lower())
    if tokens and re.search("[A-Za-z0-9]$", path):
        tokens.pop()
    return Rule(host + path, rf"^(?:[^/]*\.)?{body}", verdict, tuple(tokens), len(host + path))


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A regular expression, with tokens that each URL it matches holds whole."""
    return Rule(pattern, pattern, verdict, tokens)


# The list rules of the registered query.
LIST_RULES = [list_rule(BLOCK, "net", "/"), list_rule(ALLOW, "example.net", "/en/"), list_rule(BLOCK, "example.com", "/de/"), list_rule(ALLOW, "org", "/fr/")]

# Words and pairs of words of hosts that are not worth fetching, each a part of the host between separators.
BLOCKED_HOST_WORDS = ["casino", "poker", "roulette", "viagra", "cialis", "escorts", "porn", "xxx", "warez", "torrents", "doubleclick", "adserver", "adclick", "clickbank", "payday"]
BLOCKED_HOST_PAIRS = ["cheap-pills", "spam-farm", "ads-track", "online-pharmacy", "replica-watches", "link-farm", "click-track", "cracked-software", "essay-writing", "payday-loans"]

# Patterns of hosts and paths that are not worth fetching.
PATTERNS = [
    *(pattern_rule(BLOCK, rf"^[^/]*\b{word}\b", word) for word in BLOCKED_HOST_WORDS),
    *(pattern_rule(BLOCK, rf"^[^/]*\b{pair}\b", *pair.split("-")) for pair in BLOCKED_HOST_PAIRS),
    pattern_rule(BLOCK, r"^[^/]*\bfree-(bets|money|spins)\b", "free"),
    pattern_rule(BLOCK, r"^[^/]*\badult-[a-z]+\b", "adult"),
    pattern_rule(BLOCK, r"^[^/]*\bdating-[a-z]+\b", "dating"),
    pattern_rule(BLOCK, r"/wp-login\.php$", "wp", "login", "php"),
    pattern_rule(BLOCK, r"/xmlrpc\.php$", "xmlrpc", "php"),
    pattern_rule(BLOCK, r"/cgi-bin/", "cgi", "bin"),
]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 2)


def indexed(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; those without a token under the empty string."""
    common = Counter(t for r in rules for t in set(r.tokens))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (common[t], -len(t), t), default=""), []).append(r)
    return index


_RULES = "array<struct<weight: int, name: string, pattern: string, verdict: string>>"


def _plain(rules: list[Rule]) -> list[dict]:
    return [{"weight": r.weight, "name": r.name, "pattern": r.pattern, "verdict": r.verdict} for r in rules]


def _constant(value: list, schema: str) -> Column:
    """A nested constant; one literal, as expressions for each field would be slow to build."""
    text = json.dumps(value, ensure_ascii=False)
    if len(text.encode()) > LARGEST:
        raise ValueError(f"the rules take more than {LARGEST} bytes")
    return F.from_json(F.lit(text), F.lit(schema))


def _candidates(rules: list[Rule]) -> Column:
    """The rules that a row's ``tokens`` fetch."""
    index = indexed(rules)
    everywhere = index.pop("", [])
    found = _constant(_plain(everywhere), _RULES)
    if index:
        size = 2 * len(index)
        buckets: list[list[dict]] = [[] for _ in range(size)]
        for token, own in index.items():
            buckets[zlib.crc32(token.encode()) % size].append({"token": token, "rules": _plain(own)})
        held = _constant(buckets, f"array<array<struct<token: string, rules: {_RULES}>>>")
        bucket = lambda t: F.element_at(held, (F.crc32(t.cast("binary")) % size + 1).cast("int"))
        fetched = F.flatten(F.transform("tokens", lambda t: F.flatten(F.transform(F.filter(bucket(t), lambda b: b["token"] == t), lambda b: b["rules"]))))
        found = F.concat(found, fetched) if everywhere else fetched
    return found


def judge(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row: ``rule`` is the list rule that decided, if any."""
    rows = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("text", F.concat("host", "path"))
    rows = rows.withColumn("tokens", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({TOKEN})"), F.lit(1))))
    rows = rows.withColumn("found", F.filter(_candidates(rules), lambda r: F.regexp_like(F.col("text"), r["pattern"])))
    listed = F.array_max(F.filter("found", lambda r: r["weight"] > 0))
    by_pattern = F.when(F.exists("found", lambda r: (r["weight"] == 0) & (r["verdict"] == BLOCK)), BLOCK).otherwise(ALLOW)
    return rows.select(F.col("id").alias(id_col), "host", "path", listed["name"].alias("rule"), F.coalesce(listed["verdict"], by_pattern).alias("verdict"))
