from __future__ import annotations

import random
import re

from postern.llm import url_filter
from tests.llm.conftest import rows

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    None, "", "example.org/es/", "://", "http://", "http://example.org", "http://example.org/", "http://EXAMPLE.org/es/x", "http://example.org/ES/x",
    "https://www.example.org/en/1", "https://www.example.org/en/123?x=/es/", "https://www.example.org/en/2", "http://notexample.org/es/", "http://example.org.net/es/",
    "http://a.com/fr/", "http://a.com/fr", "http://a.com/de/?q", "http://com/de/", "http://com.de/de/", "http://x/http://y.org/", "a://b.org?c://d.com/de/", "http://b.org#/x",
    "http://free-bets.example.com/en/1", "http://bets.example.net/", "http://alphabets.example.net/", "http://casino-win.net/fr/", "http://a.net/casino", "http://é.org/x", "http://x.org\n/y",
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    parts = re.split(r"[.\-]", host)
    globbed = any(brute_glob(g, host + path.lower()) for g in url_filter.BLOCK_GLOBS)
    return host, path, None, "block" if globbed or any(w in parts for w in url_filter.BLOCK_WORDS) else "allow"


def brute_glob(glob, text):
    """Character by character; a star before the first slash does not take one."""
    reach = {0}
    for k, c in enumerate(glob):
        if c == "*":
            for i in sorted(reach):
                while i < len(text) and ("/" in glob[:k] or text[i] != "/"):
                    i += 1
                    reach.add(i)
        else:
            reach = {i + 1 for i in reach if i < len(text) and text[i] == c}
    return len(text) in reach


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(3)
    urls = [*URLS]
    for _ in range(400):
        host = rng.choice(["", "www.", "m.", "free-", "Ads."]) + rng.choice(["example", "bets", "casino", "es"]) + rng.choice([".org", ".com", ".net", "-win.com", ""])
        urls.append(rng.choice(["http://", "https://", ""]) + host + rng.choice(["", "/", "/es/", "/en/1", "/en/2", "/fr/x", "/de/", "/DE/", "?x", "#de/"]) + rng.choice(["", "y", "?es", "#t"]))
        if rng.random() < 0.4:
            glob = rng.choice(url_filter.BLOCK_GLOBS).replace("*", rng.choice(["", "a", "a.b", "x-y"]))
            urls.append(f"http://{glob}" + rng.choice(["", "z", "/", "?q"]))
            urls.append(f"http://h.net/{glob.upper()}")
    pages = spark.createDataFrame([(i if i else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = rows(url_filter.judge(pages), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i if i else None, *brute(u)) for i, u in enumerate(urls)), key=repr)


def test_rarest_token_files_the_rule_and_changes_nothing(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    counts = url_filter.token_counts(pages, url_filter.SITE_RULES, "url")
    assert counts["es"] < counts["example"] < len(URLS)
    rule = url_filter.Rule("digits", "block", r"^[^/]*/.*\d{4}", ())
    got = url_filter.judge(spark.createDataFrame([(1, "http://a.net/x2024"), (2, "http://a.net/x")], "page_id long, url string"), pattern_rules=(rule,))
    assert [r.verdict for r in got.orderBy("page_id").collect()] == ["block", "allow"]


def test_few_rules_run_and_blocks_of_rules_agree(spark):
    """The rarest token keeps rules from being tried; filing them under their commonest tries far more."""
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['m.', 'ad.', ''])}h{i % 50}.net/{rng.choice(['download', 'online', 'free', 'buy', 'click'])}/{rng.choice(['x', 'pills', 'keygen'])}/{i}" for i in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.PATTERN_RULES
    counts = url_filter.token_counts(pages, rules, "url")
    tried = lambda index: sum(len(index.fetched(*url_filter.split_url(u))) for u in urls)
    rarest, commonest = tried(url_filter.Index(rules, counts)), tried(url_filter.Index(rules, {t: -n for t, n in counts.items()}))
    assert rarest < 0.5 * commonest and rarest < 0.05 * len(urls) * len(rules)
    whole = rows(url_filter.judge(pages), "page_id", "rule", "verdict", "pattern")
    assert rows(url_filter.judge(pages, most_rules=9), "page_id", "rule", "verdict", "pattern") == whole
    assert {v for _, _, v, _ in whole} == {"allow", "block"}
    twins = (url_filter.Rule("one name", "block", r"^a", ()), url_filter.Rule("one name", "block", r"^h", ()))
    assert url_filter.judge(pages, pattern_rules=twins).where("verdict = 'block'").count() == sum('//m.' not in u for u in urls)


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
