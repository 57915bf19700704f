import fnmatch
import random
import re

from tablewright.llm.url_rules import MARK, RULES, Automaton, Glob, canonical, judge


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "org/", "http://", "http://org", "http://org/", "http://ORG/x", "http://xorg/", "http://a.b.org?q/", "https://Example.org/es/", "https://n.example.org/es", "https://example.org/en/17?x#y", "ftp://x.com/fr/.org/es/", "http://a.com/de/é", "x://y://com/de/", "http://com/de/" + "z" * 5000, "http://İ.com/fr/", "http://a\x00.org/\n/", "http://evil.com/x.example.org/es/"]


def test_query_against_plain_rules(spark):
    rows = [(i if i else None, u, "h") for i, u in enumerate(URLS)] + [(5, URLS[5], "h")]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *plain(u)) for i, u, _ in rows], key=str)
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_globs_over_several_words():
    rnd = random.Random(1)
    patterns = ["*", "", "a*b", "*a*b*", "abc" * 30, "a*" * 40, "*b", "b*", "**a"] + ["".join(rnd.choice("ab*") for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    urls = [b"", b"a", b"ab", b"abc" * 30, b"a" * 60] + ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 15))).encode() for _ in range(200)]
    automaton = Automaton([Glob.of_pattern(p) for p in patterns])
    assert automaton.words > 4
    got = automaton.matches(urls)
    for i, u in enumerate(urls):
        for j, p in enumerate(patterns):
            assert got[i, j] == fnmatch.fnmatchcase(u.decode(), p), (u, p)


def test_canonical():
    assert canonical("HTTP://A.b/C?d") == ("a.b", "/C") and MARK not in "\U0010ffff".encode()
