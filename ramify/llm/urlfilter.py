"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over a URL without its scheme.  Every stretch of letters and digits
that a matching URL must hold as a whole token is one of the rule's literals; the rule is filed
under the literal that the fewest URLs hold.  A URL's tokens fetch the rules filed under them, and
only those run their expressions.  A rule without such a literal is filed under the empty token,
which every URL has, so it is tried everywhere.

Two kinds of rules:

* ``host/path`` rules fit a host with all its subdomains where the URL's path starts with the path
  (case counts in the path).
* patterns: ``*`` is anything, ``^`` a character that is no letter, digit, ``_ - . %`` or the end,
  a leading ``|`` the start of the host, ``||`` the start of any label of the host, a trailing
  ``|`` the end of the URL.  Case does not count.

The longest rule of the first kind that fits decides, else the longest pattern (ties: allow before
block, then by text), else the default.

Only DataFrame functions.  URLs are judged once each, so a URL in very many rows is one candidate
row; tokens that very many URLs share are rarely anybody's rarest literal.  The index is broadcast
only while its counted size is below ``BROADCAST_BYTES``; beyond that it is joined by token.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.session import BROADCAST_BYTES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``regex`` is tried on the place (host and rest of a URL), folded to a-z if ``folded``."""

    rule: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    folded: bool


def _quoted(text: str) -> str:
    """Literal text in the syntax that all regular expression engines share."""
    return "".join(f"\\{c}" if c.isascii() and not c.isalnum() and c != "_" else c for c in text)


def host_rule(rule: str, action: str) -> Rule:
    """A rule ``host/path``."""
    host, slash, path = rule.partition("/")
    if not host or not slash or host != host.translate(str.maketrans(UPPER, LOWER)) or set(path) & set("?#"):
        raise ValueError(f"not a rule of a lower-case host and a path: {rule!r}")
    # the path's last token may go on in the URL
    tokens = _TOKEN.findall(host) + _bounded("/" + path.translate(str.maketrans(UPPER, LOWER)), True, False)
    return Rule(rule, action, f"^([^/?#]*[.])?{_quoted(host)}/{_quoted(path)}", tuple(tokens), False)


def _bounded(text: str, left: bool, right: bool) -> list[str]:
    """Tokens of a literal text that cannot go on beyond its ends, which are closed if ``left``, ``right``."""
    return [m[0] for m in _TOKEN.finditer(text) if (m.start() > 0 or left) and (m.end() < len(text) or right)]


def pattern_rule(rule: str, action: str) -> Rule:
    """A rule of literal text with ``*``, ``^`` and ``|``."""
    body = rule.translate(str.maketrans(UPPER, LOWER))
    head, body = ("||", body[2:]) if body.startswith("||") else ("|", body[1:]) if body.startswith("|") else ("", body)
    tail, body = (True, body[:-1]) if body.endswith("|") else (False, body)
    if not body.strip("*"):
        raise ValueError(f"a rule without literal text: {rule!r}")
    parts = re.split(r"([*^])", body)
    regex, tokens = {"": "", "|": "^", "||": "^([^/?#]*[.])?"}[head], []
    for i in range(0, len(parts), 2):
        closed_left = bool(head) if i == 0 else parts[i - 1] == "^"
        closed_right = tail if i == len(parts) - 1 else parts[i + 1] == "^"
        regex += _quoted(parts[i])
        tokens += _bounded(parts[i], closed_left, closed_right)
        if i < len(parts) - 1:
            regex += ".*" if parts[i + 1] == "*" else "([^a-z0-9_.%-]|$)"
    return Rule(rule, action, regex + ("$" if tail else ""), tuple(tokens), True)


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(rule, action, regex, tokens, folded); a list too long for a plan is read from a table of these columns instead."""
    rows = [
        F.struct(
            F.lit(r.rule).alias("rule"),
            F.lit(r.action).alias("action"),
            F.lit(r.regex).alias("regex"),
            F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens"),
            F.lit(r.folded).alias("folded"),
        )
        for r in rules
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z as a-z; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _tokens(folded: Column) -> Column:
    """The distinct tokens of a place, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(folded, "[^a-z0-9]+")))


def index(rules: DataFrame, places: DataFrame) -> DataFrame:
    """``rules`` with ``token``: the literal that the fewest rows of ``places`` (folded) hold, ties by text."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = places.select(F.explode(_tokens(F.col("folded"))).alias("token")).join(F.broadcast(wanted) if _small(rules) else wanted, "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    literal = rules.select("rule", "action", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = literal.groupBy("rule", "action").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    found = rules.join(rarest, ["rule", "action"], "left")
    return found.select("rule", "action", "regex", rules["folded"].alias("fold"), F.coalesce("least.token", F.lit("")).alias("token"))


def _small(rules: DataFrame) -> bool:
    """Whether the rules' texts, counted, may be sent to every task."""
    size = F.length("rule") + F.length("regex") + F.aggregate("tokens", F.lit(0), lambda n, t: n + F.length(t)) + 64
    return (rules.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def judge(pages: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with __host, __path, __rule (of a host, or null), __pattern (the deciding one, or null) and __verdict.

    A null URL or one without ``://`` has an empty host and path, fits no rule and gets the default.
    Equal rules count once; equal URLs, also in very many rows, are judged once.  An empty table gives an
    empty one, and no rules give the default everywhere.  Other columns pass through, whatever their
    names, but for those that start with ``__``.
    """
    rules = rules.dropDuplicates(["rule", "action"])
    urls = pages.select(F.col(url).alias("__url")).where(F.instr("__url", "://") > 0).distinct()
    places = urls.select("__url", host_of(F.col("__url")).alias("host"), _after(F.col("__url")).alias("after"))
    places = places.select("__url", F.concat("host", F.substring("after", F.length("host") + 1, F.length("after"))).alias("place"))
    places = places.select("__url", "place", F.translate("place", UPPER, LOWER).alias("folded"))
    filed = index(rules, places)
    tried = places.select("__url", "place", "folded", F.explode(_tokens(F.col("folded"))).alias("token"))
    tried = tried.join(F.broadcast(filed) if _small(rules) else filed, "token")
    fits = tried.where(F.expr("if(fold, folded, place) rlike regex"))
    # rules of hosts first, then the longest, then allow, then by text
    best = F.min(F.struct("fold", (-F.length("rule")).alias("short"), "action", "rule")).alias("__best")
    best = fits.groupBy("__url").agg(best)
    out = pages.join(best, pages[url] == best["__url"], "left")
    deciding, of_host = best["__best"]["rule"], ~best["__best"]["fold"]
    return out.select(
        *[pages[c] for c in pages.columns],
        F.coalesce(host_of(pages[url]), F.lit("")).alias("__host"),
        F.coalesce(path_of(pages[url]), F.lit("")).alias("__path"),
        F.when(of_host, deciding).alias("__rule"),
        F.when(~of_host, deciding).alias("__pattern"),
        F.coalesce(best["__best"]["action"], F.lit(default)).alias("__verdict"),
    )


#: Rules of hosts that the query has to apply, and the query's own patterns.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERN_RULES = (
    ("||spam-farm.", "block"),
    ("||cheap-pills.", "block"),
    ("||casino.", "block"),
    ("||adserver.", "block"),
    ("||ads.", "block"),
    ("||track.", "block"),
    ("||doubleclick.", "block"),
    ("/cgi-bin/", "block"),
    ("/wp-login.php^", "block"),
    ("/wp-admin/", "block"),
    ("/adclick^", "block"),
    ("/banners/*", "block"),
    ("^free-download^", "block"),
    ("^buy-now^", "block"),
    ("viagra", "block"),
    ("porn", "block"),
    (".exe|", "block"),
    (".zip|", "block"),
    (".apk|", "block"),
    ("^sessionid=", "block"),
    ("^phpsessid=", "block"),
    ("^add-to-cart=", "block"),
    ("^replytocom=", "block"),
    ("^utm_source=spam", "block"),
    ("||docs.", "allow"),
    ("||wiki.", "allow"),
    ("/robots.txt|", "allow"),
    ("/license^", "allow"),
)


def production_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERN_RULES]
