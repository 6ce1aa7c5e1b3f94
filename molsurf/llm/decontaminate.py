"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A word is a maximal run of digits, letters and non-ASCII bytes, A-Z lower-cased.
Every ``window`` consecutive words of a benchmark item are a pattern; an item of
fewer words, but not none, is one pattern. The search works on words as symbols,
with blocks of ``BLOCK`` words and, in each group of patterns, the length m of
the shortest:

* the shift table says for a block how far it is from the end of the nearest
  pattern's first m words that hold it; a block in none shifts by m - BLOCK + 1;
* where the shift is nothing, the block as a suffix and the block m - BLOCK words
  earlier as a prefix select the patterns that may stand here;
* these are compared with the text word by word.

Patterns of full windows and those of short items form two groups, so that one
short item does not shorten every shift.

The benchmark comes to the driver in parts of about ``part_bytes``, one at a time,
and goes out as a broadcast each; executors search a batch of texts for a part's
patterns and drop them before the next part is read. So no process holds more
than a part, whatever the benchmark's size. Texts are split a slice at a time.

Null text has no words, in documents and items. An item without id counts under
the empty string; items that share an id count once. Repeated documents give
repeated rows. Other columns are ignored, whatever their names. With an empty
benchmark nothing is contaminated; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, released, table, words_by_slices

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
#: Everything ASCII but digits and letters separates words; A-Z become a-z.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words in a block of the shift table.
BLOCK = 2
#: Bytes of a text that are split into words at once, and of texts that are searched for one part of the benchmark after another.
SLICE, TEXTS = 1 << 20, 1 << 24

Pattern = tuple[bytes, ...]


def word_slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The text's words, a slice at a time; a word that a slice cuts is put together once, however long."""
    return words_by_slices(text, size, lambda part: part.translate(WORDS))


class Search:
    """The tables of one group of patterns."""

    def __init__(self, patterns: dict[Pattern, set[str]]):
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        self.most = self.m - self.block + 1
        self.longest = max(map(len, patterns))
        self.shift: dict[Pattern, int] = {}
        #: suffix block -> prefix block -> patterns
        self.heads: dict[Pattern, dict[Pattern, list[tuple[Pattern, set[str]]]]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.block, self.m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.most), self.m - end)
            self.heads[p[self.m - self.block : self.m]][p[: self.block]].append((p, items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) of each occurrence, by start."""
        shift, m, block, most, n = self.shift, self.m, self.block, self.most, len(words)
        at = m
        while at <= n:
            b = tuple(words[at - block : at])
            step = shift.get(b, most)
            if step:
                at += step
                continue
            start = at - m
            for p, items in self.heads[b].get(tuple(words[start : start + block]), ()):
                if tuple(words[start : start + len(p)]) == p:
                    yield start, start + len(p), items
            at += 1


class Searcher:
    """All patterns of a part of the benchmark: [(item, text)]."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        found: dict[bool, dict[Pattern, set[str]]] = {}
        for name, text in items:
            words = [w for part in word_slices(text) for w in part]
            whole = len(words) >= window
            for k in range(max(len(words) - window, 0) + 1 if words else 0):
                found.setdefault(whole, {}).setdefault(tuple(words[k : k + window]), set()).add(name)
        self.groups = [Search(p) for p in found.values()]
        #: Words that the next slice must see again.
        self.tail = max((g.longest for g in self.groups), default=1) - 1

    def scan(self, text: bytes) -> tuple[int, set[str], list[list[int]]]:
        """The number of words, the items found, and the merged spans of words inside occurrences."""
        n, items, tail, own = 0, set(), [], []
        for words in word_slices(text):
            here, first = tail + words, n - len(tail)
            for g in self.groups:
                last = None
                for a, b, names in g.occurrences(here):
                    items |= names
                    if last and first + a <= last[1]:
                        last[1] = max(last[1], first + b)
                    else:
                        own.append(last := [first + a, first + b])
            n += len(words)
            tail = here[len(here) - min(self.tail, len(here)) :]
        return n, items, merged(own)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def parts_of(benchmark: DataFrame, part_bytes: int) -> list:
    """The benchmark's items as broadcasts of about ``part_bytes`` each (an item is never cut)."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text") + F.length("item") + 16)).first()[0] or 0
    n = -(-total // part_bytes)
    if n > 1:
        rows = checkpointed(rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition(n, "part"))
    out = []
    for k in range(n):
        own = [(r["item"], bytes(r["text"])) for r in (rows.where(F.col("part") == k) if n > 1 else rows).select("item", "text").toLocalIterator()]
        out.append(spark.sparkContext.broadcast(pickle.dumps(own)))
    return out


def find_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = 1 << 23) -> DataFrame:
    """Words, hits, items and hit spans (in words, end exclusive) of each document."""
    parts = parts_of(benchmark, part_bytes)

    def search(texts: list[bytes]) -> list[tuple[int, set[str], list[list[int]]]]:
        out = [(0, set(), [])] * len(texts)
        for part in parts or [None]:
            if len(parts) != 1 or not kept:  # the only part stays for the task
                kept.clear()
                kept.append(Searcher(pickle.loads(part.value) if part else [], window))
                if part:
                    vars(part).pop("_value", None)  # read from disk again when its turn comes
            for k, t in enumerate(texts):
                n, items, spans = kept[0].scan(t)
                out[k] = n, out[k][1] | items, out[k][2] + spans
        return out

    kept: list[Searcher] = []

    def rows(found: tuple[int, set[str], list[list[int]]]) -> tuple:
        n, items, spans = found
        spans, names = merged(spans), sorted(items)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        return n, sum(b - a for a, b in spans), len(names), digest, bool(spans), names, [{"start": a, "end": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
        types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for b in batches:
            raw, at = b.column(1).cast(pa.binary()), 0
            while at < len(raw):
                texts, held = [], 0
                while at + len(texts) < len(raw) and held < TEXTS:
                    texts.append(raw[at + len(texts)].as_py() or b"")
                    held += len(texts[-1])
                cols = list(zip(*map(rows, search(texts))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)
                at += len(texts)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lambda batches: released(run(batches)), SCHEMA)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), starts AS (
  SELECT item, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS pos FROM b WHERE len(words) > 0
), patterns AS (
  SELECT DISTINCT item, size, array_to_string(words[pos:pos + size - 1], ' ') AS pattern FROM starts
), sizes AS (
  SELECT DISTINCT size FROM patterns
), places AS (
  SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM d, sizes WHERE len(words) >= size
), found AS (
  SELECT w.r, w.pos, w.size, p.item FROM (SELECT r, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS pattern FROM places) w JOIN patterns p ON w.pattern = p.pattern AND w.size = p.size
), hit AS (
  SELECT r, count(DISTINCT pos + k) AS n_hit FROM (SELECT DISTINCT r, pos, size FROM found) f, range(0, 10) t(k) WHERE k < size GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
