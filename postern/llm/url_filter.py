"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over `host` + `path` with the literal tokens that every match must
contain.  Tokens are runs of [a-z0-9] of the lower-cased host and path.  Each rule is filed under
that of its tokens which the fewest URLs hold, counted over all of them; the tokens of a URL fetch
the rules filed under them, and only those run their regular expression.  Rules without a token
are tried on every URL.

There are two lists.  Site rules (allow or block, a host with its subdomains and a path prefix)
decide first: of those that fit, the longest wins.  Otherwise a URL is blocked if any block
pattern matches, and allowed if none does.  Block patterns are words of the host, and globs of host and
path, in which `*` stands for any text (without "/" in the host) and all else for itself; a literal token
of a glob is one that no `*` touches.  Most globs have several, as common as `download` or as rare as
`keygen`, so the rarest decides how seldom they are tried.

The host stands after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path
follows up to "?", "#" or the end.  Null urls and urls without "://" have neither, no rule fits
them, and they are allowed.  Every input row gives one output row, ties of equally long site rules
go to the first in code point order.  The rules are broadcast; `MOST_RULES` bounds a broadcast, and a longer list is
dealt over several, each looked through by a pass over the pages of its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import written

MOST_RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host and all its subdomains, and paths that start with path.

    Whole tokens only: the last one of the path may go on in the url, so it is not a literal token.
    """
    tokens = _TOKEN.findall(host) + [m[0] for m in _TOKEN.finditer(path.lower()) if m.end() < len(path)]
    return Rule(host + path, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), tuple(tokens), True)


#: The site rules of the contract.
SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)

#: Words that mark hosts of gambling, counterfeit medicine, advertising and adult content.
BLOCK_WORDS = ("casino", "bets", "betting", "poker", "slots", "jackpot", "pills", "viagra", "cialis", "porn", "xxx", "escort", "ads", "adserver", "doubleclick", "tracker", "warez", "torrent", "payday", "replica")


def block_word(word: str) -> Rule:
    """The word is a whole label or hyphenated part of the host."""
    return Rule(f"word:{word}", "block", rf"^(?:[^/]*[.\-])?{word}(?:[.\-][^/]*)?(?:/|\Z)", (word,))


#: Globs of host and path that mark such pages on hosts whose names do not.
BLOCK_GLOBS = (
    "*/casino/bonus/*",
    "*/free/spins/*",
    "*/online/poker/*",
    "*/sports/betting/odds*",
    "*/buy/viagra*",
    "*/cheap/pills/*",
    "*/online/pharmacy/*",
    "*/adult/video/*",
    "*/live/cams/*",
    "*/escort/girls/*",
    "*/payday/loan*",
    "*/replica/watches/*",
    "*/download/keygen*",
    "*/download/crack/*",
    "*/torrent/download/*",
    "*/essay/writing/service*",
    "*/affiliate/click/*",
    "*/track/pixel.gif",
    "*/banner/ads/*",
    "ad.*/click/*",
    "ad.*/serve/*",
    "click.*/redirect/*",
    "free-*.*/win/prize*",
    "cheap-*.*/buy/*",
    "online-*.*/casino/*",
    "*/wp-login.php",
    "*/cgi-bin/*.exe",
)


def glob_rule(verdict: str, glob: str) -> Rule:
    """Fits URLs whose host and path, lower-cased, the glob describes from the first to the last character."""
    host, slash, path = glob.partition("/")
    pattern = "[^/]*".join(map(re.escape, host.split("*"))) + slash + ".*".join(map(re.escape, path.split("*")))
    tokens = tuple(m[0] for m in _TOKEN.finditer(glob) if "*" not in glob[max(0, m.start() - 1) : m.start()] + glob[m.end() : m.end() + 1])
    return Rule(f"glob:{glob}", verdict, rf"(?is)^{pattern}\Z", tokens)


PATTERN_RULES = (*(block_word(w) for w in BLOCK_WORDS), *(glob_rule("block", g) for g in BLOCK_GLOBS))


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def token_set(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host + path.translate(_LOWER)))


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], url_col: str) -> dict[str, int]:
    """How many URLs hold each token of the rules; at most one row per token and task is shuffled."""
    wanted = {t for r in rules for t in r.tokens}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in wanted & token_set(*split_url(url)):
                    counts[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["token", "n"])

    rows = pages.select(url_col).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in rows.toLocalIterator()}


@dataclass
class Found:
    """What one block of rules says of a URL: its site rule and verdict, and its least block pattern."""

    site: str | None = None
    verdict: str | None = None
    blocked: str | None = None

    def or_else(self, other: Found) -> Found:
        mine, others = ((-len(x.site), x.site) if x.site is not None else (1, "") for x in (self, other))
        first = self if mine <= others else other
        return Found(first.site, first.verdict, min((x for x in (self.blocked, other.blocked) if x is not None), default=None))


class Index:
    """Rules under their rarest token; their regular expressions are compiled where they are first asked for."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]) -> None:
        self.rules, self.filed, self.compiled = rules, defaultdict(list), {}
        for k, r in enumerate(rules):
            self.filed[min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(k)

    def fetched(self, host: str, path: str) -> list[int]:
        if not host and not path:
            return []
        return [*self.filed.get("", ()), *(k for t in token_set(host, path) for k in self.filed.get(t, ()))]

    def fits(self, k: int, url: str) -> bool:
        found = self.compiled.get(k)
        if found is None:
            found = self.compiled[k] = re.compile(self.rules[k].pattern)
        return found.match(url) is not None

    def judge(self, host: str, path: str) -> Found:
        # Site rules look at the path as it is, with its case.
        fits = [self.rules[k] for k in self.fetched(host, path) if self.fits(k, host + path)]
        site = min((r for r in fits if r.site), key=lambda r: (-len(r.name), r.name), default=None)
        return Found(site and site.name, site and site.verdict, min((r.name for r in fits if not r.site), default=None))


def judge(
    pages: DataFrame,
    site_rules: tuple[Rule, ...] = SITE_RULES,
    pattern_rules: tuple[Rule, ...] = PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    most_rules: int = MOST_RULES,
) -> DataFrame:
    """id, host, path, rule (the site rule that decides, or null), verdict, and the pattern that blocks, or null."""
    rules, context = (*site_rules, *pattern_rules), pages.sparkSession.sparkContext
    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"), *(F.lit(None).cast("string").alias(c) for c in ("site", "site_verdict", "pattern")))
    parts = [rules[a : a + most_rules] for a in range(0, len(rules), most_rules)] or [()]
    for n, part in enumerate(parts):
        index = context.broadcast(Index(part, token_counts(pages, part, url_col)))
        out = out.mapInArrow(_looked_through(index, id_col), f"`{id_col}` {kind}, url string, site string, site_verdict string, pattern string")
        if n < len(parts) - 1:  # one index at a time in a task
            out = written(out, "urls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [split_url(url) for url in batch.column(1).to_pylist()]
            hosts, paths = (pa.array([x[k] for x in split], pa.string()) for k in (0, 1))
            verdicts = [v or ("block" if p else "allow") for v, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), hosts, paths, batch.column(2), pa.array(verdicts, pa.string()), batch.column(4)], [id_col, "host", "path", "rule", "verdict", "pattern"])

    return out.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string")


def _looked_through(index: Broadcast, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            before = [Found(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            found = [own.judge(*split_url(url)).or_else(b) for url, b in zip(batch.column(1).to_pylist(), before, strict=True)]
            columns = [pa.array([getattr(x, c) for x in found], pa.string()) for c in ("site", "verdict", "blocked")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [id_col, "url", "site", "site_verdict", "pattern"])

    return run


def _oracle() -> str:
    blocked = "|".join(BLOCK_WORDS)
    globs = ", ".join(f"('{g}')" for g in BLOCK_GLOBS)
    return rf"""
WITH p AS (
    SELECT page_id,
           CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
    FROM pages
), r AS (
    SELECT *,
           CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern
FROM (
    SELECT *, least((SELECT min('word:' || w) FROM unnest(string_split('{blocked}', '|')) AS t(w)
                     WHERE regexp_matches(host, '(^|[.-])' || w || '([.-]|$)')),
                    (SELECT min('glob:' || g) FROM (VALUES {globs}) AS t(g)
                     WHERE contains(path, '/')
                       AND regexp_full_match(host, replace(replace(split_part(g, '/', 1), '.', '\.'), '*', '.*'), 's')
                       AND regexp_full_match(lower(path), replace(replace(substr(g, strpos(g, '/')), '.', '\.'), '*', '.*'), 's'))) AS pattern
    FROM r
)
"""


ORACLE = _oracle()
