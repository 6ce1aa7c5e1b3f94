"""URL filters with a bit-parallel wildcard automaton.

Glob rules are packed end to end into the bits of multiword Shift-And masks.
One state vector per URL, as many 64-bit words as the rules need, simulates
all rules at once over the canonical URL, byte by byte; a batch of URLs moves
in step. ``?`` is any byte but ``/``; ``*`` any run without ``/``; ``**`` any run.

The canonical URL is a dot, the host, the path and, with its mark, the query.
The dot lets ``**.com/en/**`` fit a host and its subdomains alike. A null URL
or one without ``://`` has an empty host and path, is ``.``, and no rule fits.
Repeated rows are judged alike, rows without page_id like others; columns other
than page_id and url are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

SCHEMA = "page_id long, host string, path string, rule string, verdict string, pattern string"


@dataclass(frozen=True)
class Rule:
    verdict: str
    #: Host and path, as in ``example.com/en/7``; fits the host, its subdomains and longer paths.
    rule: str

    @property
    def glob(self) -> str:
        return f"*.{self.rule}**"


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))
#: The method's own globs, for URLs that no rule fits: trackers, feeds and advertisements.
GLOBS = ("**?utm_source=**", "**&utm_source=**", "*.ads.**", "**/ads/**", "**/login**", "**.php*")


#: Bytes beyond which a URL is read by itself.
LONG = 4096


class Automaton:
    """Patterns as Shift-And masks. Bit i of a pattern is set once its first i + 1 items have been read."""

    def __init__(self, globs: list[str]):
        items: list[tuple[str, int]] = []
        self.last, starts = [], []
        for g in globs:
            tokens = re.findall(r"\*\*|\*|[^*]", g.encode().decode("latin-1")) or [""]
            starts.append(len(items))
            items.append(("", 0))  # the state before the first byte
            for t in tokens:
                if t in ("*", "**"):  # a star is a loop on the state before it
                    items[-1] = (items[-1][0], max(items[-1][1], len(t)))
                elif t:
                    items.append((t, 0))
            self.last.append(len(items) - 1)
        self.words = -(-len(items) // 64)
        bit = lambda ks: np.array([sum(1 << (k - 64 * w) for k in ks if 64 * w <= k < 64 * w + 64) for w in range(self.words)], np.uint64)
        self.start = bit(starts)
        move, loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for c in range(256):
            own = chr(c)
            move[c] = bit([k for k, (t, _) in enumerate(items) if t == own or t == "?" and own != "/"])
            loop[c] = bit([k for k, (_, kind) in enumerate(items) if kind == 2 or kind == 1 and own != "/"])
        self.move, self.loop = move, loop
        self.numbers: list[tuple[int, int]] = []

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """[text, pattern]: whether the pattern fits the whole text."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            out = np.empty((n, len(self.last)), bool)
            short = np.flatnonzero(sizes <= LONG)
            out[short] = self.matches([texts[k] for k in short])
            for k in long:
                out[k] = self.matches_one(texts[k])
            return out
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        ends = sizes[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(ends[0]) if n else 0):
            live = int(np.searchsorted(-ends, -at, side="left"))  # texts longer than ``at``
            c = flat[begin[:live] + at]
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = (moved & self.move[c]) | (s & self.loop[c])
        out = np.empty((n, len(self.last)), bool)
        for p, k in enumerate(self.last):
            out[order, p] = (state[:, k // 64] >> np.uint64(k % 64)) & one == one
        return out


    def matches_one(self, text: bytes) -> list[bool]:
        """A row of ``matches``: the same masks as whole numbers, which spares a long URL the steps of a batch."""
        whole = lambda words: sum(int(w) << 64 * k for k, w in enumerate(words))
        if not self.numbers:
            self.numbers = [(whole(m), whole(x)) for m, x in zip(self.move, self.loop)]
        state = whole(self.start)
        for move, loop in map(self.numbers.__getitem__, text):
            state = (state << 1 & move) | (state & loop)
        return [bool(state >> k & 1) for k in self.last]


def parts(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lowered), path and query with its mark."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", ""
    m = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?", rest)
    host = m[1].encode().lower().decode()
    return host, m[2], m[3] or ""


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[str, ...] = GLOBS) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict and pattern (the method's own that fits, else null)."""
    ranked = sorted(rules, key=lambda r: (-len(r.rule), r.rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob for r in ranked] + list(globs))
        for b in batches:
            if not b.num_rows:
                continue
            split = [parts(u) for u in b.column(1).to_pylist()]
            fits = automaton.matches([f".{h}{p}{q}".encode() for h, p, q in split])
            rule, verdict, glob = [], [], []
            for own in fits:
                k = np.flatnonzero(own)
                r = ranked[k[0]] if len(k) and k[0] < len(ranked) else None
                g = next((globs[x - len(ranked)] for x in k if x >= len(ranked)), None)
                rule.append(r and r.rule)
                verdict.append(r.verdict if r else "block" if g else "allow")
                glob.append(g)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in ([s[0] for s in split], [s[1] for s in split], rule, verdict, glob)]], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return pages.select(pages["page_id"].cast("long"), pages["url"]).mapInArrow(run, SCHEMA)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH split AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), cut AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM split
), fit AS (
  SELECT *, CASE WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN '.' || host LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN '.' || host LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN '.' || host LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
         '.' || host || path || query AS whole
  FROM cut
), own AS (
  SELECT *, CASE WHEN regexp_matches(whole, '^(?s:.*)[^/]utm_source=(?s:.*)$') THEN '**?utm_source=**'
         WHEN contains(whole, '&utm_source=') THEN '**&utm_source=**'
         WHEN regexp_matches(whole, '^[^/]*\.ads\.') THEN '*.ads.**'
         WHEN contains(whole, '/ads/') THEN '**/ads/**'
         WHEN contains(whole, '/login') THEN '**/login**'
         WHEN regexp_matches(whole, '\.php[^/]*$') THEN '**.php*' END AS pattern
  FROM fit
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM own
"""
