"""URL filtering by pattern rules indexed by their rarest literal token.

Every rule carries literal tokens that any URL it fits must contain as whole tokens. The corpus is counted once
for these tokens, and each rule is filed under its rarest one in a hash table that lies in the plan as one constant: an
array of buckets of rules. The tokens of a URL open their buckets and fetch the rules filed under them; only these
candidates run their regular expression. The counting pass looks tokens up in a table of the same kind. So a URL costs
its own tokens and candidates in both passes, however many rules there are. All of it is DataFrame expressions; only
the counts, one a rule token, are shuffled.

Defined cases: a null URL and a URL without `://` have an empty host and path, fit no rule and get the default
verdict. Repeated rows are judged alike, an empty table gives an empty result, further columns are kept whatever their
names; columns named host, path, rule, verdict in the input are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the index for each of its tokens.
BUCKETS = 2
_RULE = "rank int, order int, text string, verdict string, pattern string, token string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


@dataclass(frozen=True)
class UrlRule:
    """A rule: its text as reported, verdict, pattern over host + path + rest, literal tokens; higher rank wins."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_path_rule(verdict: str, host: str, path: str) -> UrlRule:
    """Fits `host` and all its subdomains where the path starts with `path`; longer rules rank higher."""
    tail = path if path.endswith("/") else re.sub(r"[A-Za-z0-9]+$", "", path)  # a cut-off token may go on in the URL
    tokens = re.findall("[A-Za-z0-9]+", host if path.startswith("/") else "") + re.findall("[A-Za-z0-9]+", tail)
    return UrlRule(host + path, verdict, rf"(?s)^(?:[^/?#]*\.)?{_quoted(host)}{_quoted(path)}", tuple(dict.fromkeys(tokens)), 1_000_000 + len(host + path))


def pattern_rule(verdict: str, pattern: str, tokens: Sequence[str], rank: int = 0) -> UrlRule:
    """A regular expression over host + path + rest of the URL that needs all of `tokens` as whole tokens."""
    return UrlRule(pattern, verdict, pattern, tuple(tokens), rank)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def free(name: str, taken: Sequence[str]) -> str:
    """The name, with as many underscores before it as make it new."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def url_parts(url: str) -> tuple[Column, Column, Column]:
    """host (A-Z lower-cased), path, and host + path + rest of a URL column."""
    part = lambda i: F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, i)
    host = F.translate(part(1), _UPPER, _LOWER)
    return host, part(2), F.concat(host, part(2), part(3))


def url_tokens(target: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(target, F.lit("([A-Za-z0-9]+)"), 1))


def token_bucket(token: Column, size: int) -> Column:
    return (F.crc32(token.cast("binary")) % size).cast("int")


def known_tokens(rules: Sequence[UrlRule]) -> tuple[list[list[str]], int]:
    """The rules' tokens in buckets by CRC-32, and how many buckets."""
    known = sorted({t for r in rules for t in r.tokens})
    size = max(1, BUCKETS * len(known))
    buckets: list[list[str]] = [[] for _ in range(size)]
    for t in known:
        buckets[zlib.crc32(t.encode()) % size].append(t)
    return buckets, size


def index_rules(urls: DataFrame, rules: Sequence[UrlRule], target: str) -> dict[str, list[UrlRule]]:
    """File each rule under its rarest token in the corpus (ties: first in order); "" holds rules without tokens."""
    buckets, size = known_tokens(rules)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<string>>")
    wanted = F.filter(url_tokens(target), lambda t: F.array_contains(F.get(table, token_bucket(t, size)), t))
    counts = {r["token"]: r["n"] for r in urls.select(F.explode(wanted).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()} if any(buckets) else {}  # one row a rule token at most
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", []).append(r)
    return index


def index_column(index: dict[str, list[UrlRule]], rules: Sequence[UrlRule]) -> tuple[Column, int]:
    """(the index as a constant array of buckets, their number). A rule lies in the bucket of its token's CRC-32."""
    size = max(1, BUCKETS * len(index))
    order = {r: -i for i, r in enumerate(rules)}
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for token, part in index.items():
        buckets[zlib.crc32(token.encode()) % size] += [{"rank": r.rank, "order": order[r], "text": r.text, "verdict": r.verdict, "pattern": r.pattern, "token": token} for r in part]
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{', '.join(c.replace(' ', ':') for c in _RULE.split(', '))}>>>"), size


def candidates(index: dict[str, list[UrlRule]], rules: Sequence[UrlRule], target: str) -> Column:
    """The rules that the tokens of the target fetch; those without a token are fetched by every URL."""
    table, size = index_column(index, rules)
    fetch = lambda t: F.filter(F.get(table, token_bucket(t, size)), lambda r: r["token"] == t)
    return F.flatten(F.transform(F.array_append(url_tokens(target), ""), fetch))


def filter_urls(df: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (text of the best fitting rule or null) and verdict (its verdict or the default)."""
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url]
    target, best = free("_target", kept), free("_best", kept)
    host, path, whole = url_parts(url)
    urls = df.select(*(F.col(f"`{c}`") for c in kept), host.alias(free("_host", kept)), path.alias(free("_path", kept)), whole.alias(target))
    fits = F.filter(candidates(index_rules(urls, rules, target), rules, target), lambda r: F.rlike(F.col(target), r["pattern"]))
    out = urls.withColumn(best, F.array_max(fits))
    left = [c for c in kept if c.lower() not in ("host", "path", "rule", "verdict")]
    return out.select(*(F.col(f"`{c}`") for c in left), F.col(free("_host", kept)).alias("host"), F.col(free("_path", kept)).alias("path"), F.col(f"{best}.text").alias("rule"), F.coalesce(F.col(f"{best}.verdict"), F.lit(default)).alias("verdict"))
