"""URL filter rules by a bit-parallel wildcard automaton.

Each rule becomes a glob over a canonical URL of bytes: ``.host``, a byte 255 (which no text holds),
the path and a second byte 255. All globs stand one after another in the bits of a few 64-bit words, a
bit for each literal byte, and one Shift-And pass over a URL advances every glob at once: a bit is set
when its glob's bytes so far have matched, a ``*`` keeps the bit before it alive, and the bit of a
glob's last literal tells a match. URLs run in step, so numpy works on a column of bytes at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, table

MARK = b"\xff"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The verdict on URLs that no rule fits.
DEFAULT = "allow"
#: URLs that run in step at once.
LANES = 4096


@dataclass
class Glob:
    """Tokens of a glob: literal bytes, or None for ``*``."""

    tokens: list[int | None]

    @staticmethod
    def of_rule(rule: str) -> Glob:
        host, path = re.fullmatch(r"([^/]*)(.*)", rule, re.S).groups()
        literal = ("." + host).encode() + MARK + path.encode()
        return Glob([None, *literal, None])

    @staticmethod
    def of_pattern(pattern: str) -> Glob:
        """``*`` any bytes, everything else itself; MARK may be written as ``|``."""
        return Glob([None if c == "*" else b for c in pattern for b in (MARK if c == "|" else c.encode())])


class Automaton:
    def __init__(self, globs: list[Glob]):
        """A glob of k literals takes k + 1 bits: its start, and one after each literal."""
        self.globs, at = globs, 0
        starts, stays, ends = [], [], []
        bytes_at: list[tuple[int, int]] = []
        for glob in globs:
            starts.append(at)
            star = False
            for i, t in enumerate(glob.tokens):
                if t is None:
                    stays.append(at)
                else:
                    at += 1
                    bytes_at.append((t, at))
                star = t is None and i == len(glob.tokens) - 1
            ends.append((at, star or not glob.tokens))
            at += 1
        self.words = max(1, -(-at // 64))
        self.start, self.stay = self._mask(starts), self._mask(stays)
        self.byte = np.zeros((256, self.words), np.uint64)
        for b, bit in bytes_at:
            self.byte[b, bit // 64] |= np.uint64(1 << bit % 64)
        self.ends = ends

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for b in bits:
            mask[b // 64] |= np.uint64(1 << b % 64)
        return mask

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """(URLs, globs) of booleans: the glob fits the whole URL."""
        found = np.zeros((len(urls), len(self.globs)), bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        for lo in range(0, len(order), LANES):
            lanes = order[lo : lo + LANES]
            sizes = np.array([len(urls[i]) for i in lanes])
            data = np.frombuffer(b"".join(urls[i] for i in lanes), np.uint8)
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            state = np.tile(self.start, (len(lanes), 1))
            for step in range(int(sizes[0]) if len(sizes) else 0):
                n = int(np.searchsorted(-sizes, -step, side="left"))  # the longest come first
                s = state[:n]
                moved = s << np.uint64(1)
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.byte[data[at[:n] + step]]) | (s & self.stay)
            for g, (bit, _) in enumerate(self.ends):
                found[lanes, g] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1) != 0
        return found


_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(65, 91)}


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    m = _HOST.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url; others are ignored).

    Of the rules that fit, the longest decides, of those of one length the first. A URL that no rule
    fits, that is null or that has no host part gets ``default`` and a null rule. Very long URLs are matched
    whole. Repeated rows get equal results; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: -len(r[1]))

    def run(batches):
        automaton = Automaton([Glob.of_rule(r) for _, r in ranked])
        for batch in batches:
            parts = [canonical(u.as_py()) for u in batch.column(1)]
            fits = automaton.matches([b"." + h.encode() + MARK + p.encode() + MARK for h, p in parts])
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if ranked else np.full(len(parts), -1)
            rule = [ranked[i][1] if i >= 0 else None for i in first]
            verdict = [ranked[i][0] if i >= 0 else default for i in first]
            columns = [[h for h, _ in parts], [p for _, p in parts], rule, verdict]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op8_url_rules(spark, sf_dir: str) -> DataFrame:
    """Every row of pages."""
    return judge(table(spark, sf_dir, "pages"))


ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '(?s)[?#].*$', '') AS path FROM cut),
rules(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
"""
