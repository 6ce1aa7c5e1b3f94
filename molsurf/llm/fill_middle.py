"""Fill-in-the-middle transformation with succinct rank and select.

A text is cut into units ``[A-Za-z]+|[^A-Za-z]``. A bit for each UTF-8 byte says
whether a unit starts there; the bits of many texts, one after another, are
packed into 64-bit words, and a directory holds the number of ones before each
block of ``BLOCK`` words. rank (directory, then popcounts inside a block) at a
text's two ends gives its number of units, n; select (binary search in the
directory, then popcounts inside one block, then bits inside one word) gives the
byte where its unit k starts. A second such vector marks the bytes that start a
code point, so that rank turns byte cuts into code points. Nothing is a list of
tokens: a text of b bytes takes b / 4 bytes of bits, built a slice at a time.

Of an id's hash h (see ``draws``): h1 and h2 modulo n + 1 are the two cuts, h3
decides whether a text stays plain, h4 between the orders:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

Texts that hold a sentinel stay plain, so each sentinel comes up once in an output
and ``restored`` finds the three parts. Null text counts as empty and stays plain.
A null id counts as the empty string in its hash. Repeated rows give repeated
results (the hash knows the id only); other columns are ignored, whatever their
names; an empty table gives an empty result. Memory is that of the longest text,
its output and their bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
SENTINELS = ("<P>", "<S>", "<M>")
#: Words in a block of the directory.
BLOCK = 16
#: Bytes of text whose bits are made at once, and of texts that share a bitvector.
SLICE = 1 << 22


class Bits:
    """A packed bitvector with rank and select."""

    def __init__(self, n: int):
        words = -(-n // 64)
        self.n, self.words = n, np.zeros(-(-(words + 1) // BLOCK) * BLOCK, "<u8")

    def fill(self, at: int, bits: np.ndarray) -> None:
        """Set the bits from ``at`` on, a multiple of 64."""
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[at // 8 : at // 8 + len(packed)] = packed

    def index(self) -> Bits:
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).reshape(-1, BLOCK).sum(1, dtype=np.int64))])
        return self

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, block = at >> 6, (at >> 6) // BLOCK
        near = self.words.reshape(-1, BLOCK)[block]
        inside = np.bitwise_count(near).astype(np.int64)
        inside[np.arange(BLOCK) >= (word % BLOCK)[:, None]] = 0
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + inside.sum(1) + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of one number k, from 0; there must be so many."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.words.reshape(-1, BLOCK)[block]).astype(np.int64), axis=1)
        word = (upto <= left[:, None]).sum(1)
        left = left - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        own = self.words[block * BLOCK + word]
        ones = np.cumsum(np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1, dtype=np.int64)
        return (block * BLOCK + word) * 64 + (ones <= left[:, None]).sum(1)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Where units and where code points start in the bytes of texts that begin at ``starts``."""
    units, points = Bits(len(data)), Bits(len(data))
    for at in range(0, len(data), SLICE):
        own = data[max(at - 1, 0) : at + SLICE]
        letter = (own | 32) - np.uint8(97) < 26
        fresh = np.ones(len(own), bool)  # the byte before is no letter, or of another text
        fresh[1:] = ~letter[:-1]
        begun = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + SLICE)]
        fresh[begun - max(at - 1, 0)] = True
        first = (own & 0xC0) != 0x80
        skip = 1 if at else 0
        units.fill(at, (np.where(letter, fresh, first))[skip:])
        points.fill(at, first[skip:])
    return units.index(), points.index()


def cuts(texts: list[bytes], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: n, the bytes before the two cuts, and the code points of prefix and middle."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    units, points = boundaries(data, starts[sizes > 0])
    first = units.rank(starts)
    n = units.rank(ends) - first
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    at = np.broadcast_to(ends, ranks.shape).copy()
    inside = ranks < n  # the last cut is the text's end, where no unit starts
    at[inside] = units.select((first + ranks)[inside])
    chars = np.diff(np.stack([points.rank(starts), points.rank(at[0]), points.rank(at[1])]), axis=0)
    return n, at - starts, chars


def draws(seed: int, doc_id: Column) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of seed, a colon and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def groups(sizes: np.ndarray) -> Iterator[slice]:
    """Rows in turn whose bytes begin in one slice of ``SLICE``."""
    own = (np.cumsum(sizes) - sizes) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(sizes)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


def fill_in_middle(docs: DataFrame, seed: int = 1, transformed: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each text; ``transformed`` of a hundred are cut, ``spm`` of a hundred of these suffix first."""
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            h = [b.column(k).to_numpy() for k in (2, 3, 4, 5)]
            for rows in groups(pc.fill_null(pc.binary_length(raw), 0).to_numpy()):
                texts = [t or b"" for t in raw.slice(rows.start, rows.stop - rows.start).to_pylist()]
                n, at, chars = cuts(texts, h[0][rows], h[1][rows])
                plain = (h[2][rows] % 100 >= transformed) | np.array([not t or p in t or s in t or m in t for t in texts], bool)
                first = h[3][rows] % 100 < spm
                out = []
                for t, x, y, keep, back in zip(texts, *at.tolist(), plain.tolist(), first.tolist()):
                    out.append(t if keep else b"".join((s, t[y:], p, t[:x], m, t[x:y]) if back else (p, t[:x], s, t[y:], m, t[x:y])))
                form = np.where(plain, "plain", np.where(first, "spm", "psm"))
                counts = [pa.array(c, pa.int64(), mask=plain) for c in chars]
                cols = [b.column(0).slice(rows.start, len(texts)), pa.array(n, pa.int64()), pa.array(form, pa.string()), *counts, pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])

    given = docs.select(docs["doc_id"].cast("long"), docs["text"], *draws(seed, docs["doc_id"]))
    return given.mapInArrow(lambda batches: released(run(batches)), SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from an output and its form alone."""
    p, s, m = sentinels
    middle = F.substring_index(output, m, -1)
    body = F.substring_index(output, m, 1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        inner = body.substr(F.lit(len(first) + 1), F.length(body))
        return F.substring_index(inner, second, 1), F.substring_index(inner, second, -1)

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(psm[0], middle, psm[1])).when(form == "spm", F.concat(spm[1], middle, spm[0])).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
