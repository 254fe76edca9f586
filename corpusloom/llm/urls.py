"""URL filter: rules indexed by their rarest literal token. DataFrame functions only.

Every rule has a regular expression over ``host + path`` and the literal tokens ``[a-z0-9]+`` that any
match must contain as whole tokens. The rule stands in the index under the one of them that the
fewest URLs have. A URL's tokens fetch the candidate rules, and only those are run.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: Fixed values: (verdict, host and path) of the list; the longest rule that fits wins.
LIST = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Patterns that the method blocks, where the list has no rule. ``^`` is a separator (anything but letters
#: and digits, or an end), ``*`` any run of characters, ``||`` the start of a host's label.
PATTERNS = (
    "^adult^", "^ads^", "^bets^", "^casino^", "^pills^", "^porn^", "^spam^", "^torrents^", "^viagra^", "^warez^", "^xxx^",
    "||ads*^banner^", "||click*/track/", "||cheap^*^online^pharmacy^", "^free^casino^bonus^", "^adult^dating^", "^work^from^home^",
    "/affiliate/*/redirect^", "^download^full^crack^", "^payday^loans^", "^replica^watches^", "/out/*^sponsored^link^",
)
MAX_RULES_BROADCAST = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int  # of the rules that fit, that of the highest rank decides; of equal ranks that of the smaller name
    listed: bool


def list_rule(verdict: str, rule: str) -> Rule:
    """A rule of the list as a pattern: its host and all subdomains, and a prefix of the path.

    Tokens that end where the rule ends may go on in a URL, so they are no literal tokens. Tokens are lower-cased, as
    those of URLs are, though paths are compared as they are written.
    """
    host, slash, path = rule.partition("/")
    host, low = ascii_lower(host), ascii_lower(path)
    tokens = re.findall(TOKEN, host) + [m[0] for m in re.finditer(TOKEN, low) if m.end() < len(low)]
    return Rule(rule, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(tokens), 1000 + len(rule), True)


def pattern_rule(pattern: str, verdict: str = "block", rank: int = 0) -> Rule:
    """A pattern as a rule. Its literal tokens are those that no ``*`` and no open end can make part of a longer one; a
    pattern without any cannot be indexed and is an error."""
    low = ascii_lower(pattern)
    tokens, body = [], low.removeprefix("||")
    for m in re.finditer(TOKEN, body):
        before, after = body[: m.start()][-1:], body[m.end() :][:1]
        if (before not in ("", "*") or low != body and not m.start()) and after not in ("", "*"):
            tokens.append(m[0])
    if not tokens:
        raise ValueError(f"pattern {pattern!r} has no whole literal token")
    pieces = [p for p in re.split(r"(\^+|\*)", body) if p]
    parts = []
    for i, piece in enumerate(pieces):
        if piece.startswith("^"):
            parts.append("(?:^|[^a-z0-9])" if not i else "(?:[^a-z0-9]|$)" if i == len(pieces) - 1 else "[^a-z0-9]+")
        else:
            parts.append(".*" if piece == "*" else re.escape(piece))
    start = r"^(?:[^/]*\.)?" if low != body else ""
    return Rule(pattern, verdict, "(?is)" + start + "".join(parts), tuple(tokens), rank, False)


def ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


RULES = tuple(list_rule(*x) for x in LIST) + tuple(map(pattern_rule, PATTERNS))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def indexed(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules, each with the rarest of its tokens; ``urls`` has one row a different URL and its tokens.

    Counts cover all URLs. Tokens that are equally rare are taken by name.
    """
    spark = urls.sparkSession
    schema = "name string, verdict string, regex string, rank int, listed boolean, tokens array<string>"
    rows = spark.createDataFrame([(r.name, r.verdict, r.regex, r.rank, r.listed, list(r.tokens)) for r in rules], schema)
    each = rows.select("*", F.explode("tokens").alias("token")).drop("tokens")
    wanted = each.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token").count()
    order = W.partitionBy("name", "verdict", "regex").orderBy(F.coalesce("count", F.lit(0)), "token")
    return each.join(counts, "token", "left").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "count")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for every row of ``pages`` (page_id, url).

    ``rule`` is the rule of the list that decided (null if none fits), ``pattern`` the pattern of the
    method that did. Of rules that fit, the highest rank decides, then the smaller name. A null URL, or
    one without ``://``, has an empty host and path, fits no rule and gets the default; equal URLs get
    equal verdicts and repeated rows stay; an empty table gives no rows; other columns play no part.

    Each different URL is judged once, in the partition to which its grouping brought it. The rules
    are broadcast, as many as the code lists, up to ``MAX_RULES_BROADCAST``; longer lists are joined
    as Spark sees fit.
    """
    target = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    urls = pages.select("url").where("url is not null").groupBy("url").agg(F.count("*").alias("pages")).select(
        "url", target.alias("target"), F.array_distinct(F.regexp_extract_all(_lower(target), F.lit(f"({TOKEN})"), F.lit(1))).alias("tokens"))
    index = indexed(urls, rules)
    if len(rules) <= MAX_RULES_BROADCAST:
        index = F.broadcast(index)
    best = F.min(F.struct(-F.col("rank"), "name", "verdict", "listed")).alias("best")
    hits = (
        urls.select("url", "target", F.explode("tokens").alias("token")).join(index, "token")
        .where(F.expr("rlike(target, regex)")).groupBy("url").agg(best)
    )
    return pages.select("page_id", "url").join(hits, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.listed"), F.col("best.name")).alias("pattern"),
    )
