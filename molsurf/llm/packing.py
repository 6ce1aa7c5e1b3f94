"""Best-fit packing of tokenized documents by swap-based local search.

Documents are first laid into bins one after another, as they come, ``CHUNK``
pieces at a time. Local search does the packing: the lightest underfull bin of a
group is emptied by moves of one or two documents, one-for-one and two-for-one
swaps with the other underfull bins; of all exchanges that make it lighter, the
one that adds most to the sum of squared fills goes first, each document or pair
to the place it fits best. Then the next lightest, until none empties. Every
exchange raises the sum of squared fills, so the search ends.

A chunk is searched where it was tokenized, without a shuffle. Underfull bins
then meet in rounds: sorted by fill, in groups of at most ``BINS`` bins and about
``PIECES_TOGETHER`` pieces, lightest with lightest. Rounds end at the least
possible number of bins, or when one empties fewer than one in ``WORTH`` of the
bins it was given. So memory is bounded by a group, and nothing is gathered by
the driver but sums.

Chunks follow the order of the rows. With ``order``, a column of distinct longs
from 0 to 2^44, sequences are numbered in the order of their first documents.

Null text counts as empty: one piece that holds only the end id. Repeated rows
are packed once each. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, partitions, released, table

CAPACITY, END_ID = 4096, 1
#: Pieces laid out and searched together at first; bins, pieces and the least yield of a later group or round.
CHUNK, BINS, PIECES_TOGETHER, WORTH = 2048, 512, 8192, 1000
#: Cuts whose ids a worker keeps, in each of two generations; others are tokenized anew.
KEPT = 80_000
#: Bytes of text that are cut into words at a time.
GROUP = 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
BINNED = PIECES + ", pos long, bin long, first long, fill long, offset long"
#: Bits of a sequence's number that tell the pieces of one document apart.
PIECE_BITS = 19


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Printable ASCII, and precomposed Latin letters that lower-case to letters: for these, the tokenizer's cuts are simple.
_LATIN = "À-ÖØ-öø-įĲ-ľŁ-ňŊ-ſ"
PLAIN = re.compile(f"[!-~{_LATIN}]+")
#: The tokenizer's own cuts (fixed values of its file), for such text.
CUTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


class WordIds:
    """Ids of whole texts, tokenized word by word.

    The tokenizer drops white space and never joins what white space parts, so
    a text's ids are those of its white-space-separated words, end to end. A
    plain word is lower-cased and cut, and each cut looked up or given to the
    BPE model; any other word goes through the whole tokenizer. Known words
    live in two generations, so that those in use outlast those seen once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.latin = {c: as_bytes(chr(c))[0][0] for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.marks = {m: self.piece(m) for m in ".,;:!?"}

    def known(self, low: str) -> bytes:
        """The ids of one cut."""
        ids = self.young.get(low)
        if ids is None:
            ids = self.old.get(low)
            self.young[low] = ids = self.piece(low) if ids is None else ids
        return ids

    def piece(self, low: str) -> bytes:
        if not low.isascii():
            low = low.translate(self.latin)
        of = self.id_bytes
        return b"".join([of[t.id] for t in self.model.tokenize(low)])

    def word(self, word: str) -> bytes:
        body, mark = (word, b"") if word[-1:] not in self.marks else (word[:-1], self.marks[word[-1]])
        if body.isalpha() and (body.isascii() or PLAIN.fullmatch(body)):
            return self.known(body.lower()) + mark
        if "<|" in word or not PLAIN.fullmatch(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known, CUTS.findall(word.lower())))

    def ids(self, texts: pa.Array, end: int) -> Iterator[bytes]:
        """Each text's little-endian unsigned 32-bit ids, then ``end``; a few megabytes of text at a time."""
        tail = self.id_bytes[end]
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP, side="right")))
            if len(self.young) > KEPT:
                self.old, self.young = self.young, {}
            lists = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, to - at), ""))
            words = lists.flatten().dictionary_encode()
            own = list(map(self.word, words.dictionary.to_pylist()))
            code = words.indices.to_numpy(zero_copy_only=False)
            ids = np.frombuffer(b"".join(own), "<u4")
            length = np.fromiter(map(len, own), np.int64, len(own)) // 4
            first = np.cumsum(length) - length
            each = length[code]
            ends = np.cumsum(each)
            total = int(ends[-1]) if len(ends) else 0
            flat = ids[np.repeat(first[code] - (ends - each), each) + np.arange(total)].tobytes() if total else b""
            bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))] * 4
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield flat[a:b] + tail
            at = to


def kept_words(path: str) -> WordIds:
    """The worker's own WordIds, which outlives a task."""
    kept = sys.modules.setdefault("_packing_words", types.ModuleType("_packing_words"))
    if path not in vars(kept):
        setattr(kept, path, WordIds(path))
    return vars(kept)[path]


def next_fit(length: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, laid out one after another."""
    out, k, fill = [], -1, capacity
    for s in length.tolist():
        if fill + s > capacity:
            k, fill = k + 1, 0
        fill += s
        out.append(k)
    return np.array(out, np.int64)


def offers(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(total, first, second): the distinct totals of one or two of the documents, with the lengths that make them (second 0: one)."""
    size, n = np.unique(length, return_counts=True)
    a, b = np.triu_indices(len(size))
    ok = (a != b) | (n[a] > 1)
    a, b = a[ok], b[ok]
    total, at = np.unique(np.concatenate((size, size[a] + size[b])), return_index=True)
    return total, np.concatenate((size, size[a]))[at], np.concatenate((np.zeros(len(size), np.int64), size[b]))[at]


def local_search(length: np.ndarray, home: np.ndarray, capacity: int) -> tuple[np.ndarray, dict[str, int]]:
    """The bin of each piece after the search, and how many moves, swaps by kind, and emptied bins it took."""
    home = home.copy()
    n = int(home.max(initial=-1)) + 1
    fill = np.bincount(home, length, n).astype(np.int64)
    live = np.bincount(home, minlength=n) > 0
    least, count = -(-int(length.sum()) // capacity), int(live.sum())
    stuck = np.zeros(n, bool)
    did = dict.fromkeys(("moves", "one_for_one", "two_for_one", "emptied"), 0)
    near = np.flatnonzero(fill[home] < capacity)  # pieces of underfull bins; bins that have since been filled are left out below
    steps = 0
    while True:
        bins = np.flatnonzero(live & ~stuck & (fill < capacity))
        if not len(bins):
            break
        light = int(bins[np.argmin(fill[bins])])
        while fill[light]:
            if steps % 16 == 0:
                near = near[fill[home[near]] < capacity]
            steps += 1
            own = np.flatnonzero(home == light)
            total, first, second = offers(length[own])
            room = capacity - fill
            others = np.flatnonzero(live & (room > 0))
            others = others[others != light]
            at = home[near]
            kept = (at != light) & (room[at] > 0)
            taken, at = near[kept], at[kept]
            # a place is a bin's room, or that with what one of its documents would leave
            place = np.concatenate((room[others], length[taken] + room[at]))
            back = np.concatenate((np.zeros(len(others), np.int64), length[taken]))
            where = np.concatenate((others, at))
            best = np.searchsorted(total, place, side="right") - 1
            gone = np.where(best >= 0, total[best] - back, 0) if len(total) else np.zeros(len(place), np.int64)
            gain = np.where(gone > 0, gone * (fill[where] - fill[light] + gone), 0)
            if not len(gain) or gain[k := int(np.argmax(gain))] <= 0:
                break
            x, y = first[best[k]], second[best[k]]
            give = own[length[own] == x][:1]
            if y:
                give = np.append(give, own[(length[own] == y) & (own != give[0])][0])
            if k < len(others):
                did["moves"] += 1
            else:
                did["two_for_one" if y else "one_for_one"] += 1
                home[taken[k - len(others)]] = light
            home[give] = where[k]
            fill[where[k]] += gone[k]
            fill[light] -= gone[k]
        if fill[light]:
            stuck[light] = True
            if count <= least:
                break
        else:
            live[light] = False
            count -= 1
            did["emptied"] += 1
            stuck[:] = False
    return home, did


def columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def packed(rows: dict[str, np.ndarray], home: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pieces with the bin that home says, called names[home]; in a bin they stand by position, piece and id."""
    if len(home):
        order = np.lexsort((rows["doc_id"], rows["piece"], rows["pos"], home))
        own, length = home[order], rows["length"][order]
        ends = np.cumsum(length)
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.append(start, len(own)))
        offset = ends - length - np.repeat((ends - length)[start], size)
        fill = np.repeat(np.add.reduceat(length, start), size)
        pos, piece = rows["pos"][order], rows["piece"][order].astype(np.int64)
        if pos.max() >> 63 - PIECE_BITS or piece.max() >> PIECE_BITS:
            raise ValueError("a position of 2^44 or more, or a document of 2^19 pieces or more")
        first = np.repeat((pos << PIECE_BITS | piece)[start], size)
        cols = [rows[c][order] for c in columns(PIECES) + ["pos"]] + [names[own], first, fill, offset]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols[:1]] + [pa.array(cols[1].astype(np.int32))] + [pa.array(c) for c in cols[2:]], names=columns(BINNED))


def filled(docs: DataFrame, path: str | None, capacity: int, order: Column | None, chunk: int = CHUNK) -> DataFrame:
    """Pieces, where each starts among its document's ids, their checksums, and their bins after the first search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_words(path or default_tokenizer())
        names = columns(PIECES) + ["pos"]
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple] = []
        used = 0

        def search(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal used
            table = dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T))
            home = next_fit(table["length"], capacity)
            yield from packed(table, local_search(table["length"], home, capacity)[0], base + used + np.arange(len(rows)))
            used += len(rows)

        for b in batches:
            whole: list[tuple] = []
            for doc, pos, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), words.ids(b.column(1), END_ID)):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    (whole if len(own) == 4 * capacity else held).append((NO_ID if doc is None else doc, k, at // 4, len(own) // 4, zlib.crc32(own), pos))
            if whole:
                yield from search(whole)
            while len(held) >= chunk:
                yield from search(held[:chunk])
                held = held[chunk:]
        if held:
            yield from search(held)

    pos = F.lit(0).cast("long") if order is None else order.cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], pos.alias("pos")).mapInArrow(lambda batches: released(run(batches)), BINNED)


#: Stands for a null doc_id inside.
NO_ID = -(1 << 63)


def searched(binned: DataFrame, capacity: int, groups: int) -> DataFrame:
    """Underfull bins after one more round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = {c: t.column(c).to_numpy() for c in columns(PIECES) + ["pos"]}
            names, home = np.unique(t.column("bin").to_numpy(), return_inverse=True)
            yield from packed(rows, local_search(rows["length"], home, capacity)[0], names)

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held).combine_chunks()
            bins = t.column("bin").to_numpy()
            start = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1]))) if len(bins) else np.empty(0, int)
            at = 0
            while True:  # the last bin may go on in the next batch
                first = int(np.searchsorted(start, at))
                to = min(first + BINS, int(np.searchsorted(start, at + PIECES_TOGETHER)))
                to = max(to, first + 1)
                if to >= len(start):
                    break
                yield from search(t.slice(at, int(start[to]) - at))
                at = int(start[to])
            held = t.slice(at).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield from search(pa.Table.from_batches(held))

    return binned.repartitionByRange(groups, "fill", "bin").sortWithinPartitions("fill", "bin").mapInArrow(lambda batches: released(run(batches)), BINNED)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, order: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    order: a number below 2^44 of each document; sequences are then numbered by their first one's. It must not repeat: two sequences of one number are an error.
    """
    spark = docs.sparkSession
    state = checkpointed(filled(docs, path, capacity, order))
    full = F.col("fill") >= capacity
    parts = []
    had = None
    while True:
        sums = state.agg(F.count(F.when((F.col("offset") == 0) & ~full, 1)), F.count(F.when((F.col("offset") == 0) & full, 1)), F.sum(F.when(~full, F.col("length")))).first()
        left, done, tokens = sums[0], sums[1], sums[2] or 0
        if left <= -(-tokens // capacity) or (had is not None and (had - left - done) * WORTH < had):
            break
        parts.append(state.where(full))
        had = left
        state = checkpointed(searched(state.where(~full), capacity, max(1, min(partitions(spark), left // (2 * BINS)))))
    parts.append(state)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if order is not None and not out.where("offset = 0").groupBy("first").count().where("count > 1").isEmpty():
        raise ValueError("order repeats: two sequences would have one number")
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return out.select(doc_id, *columns(PIECES)[1:], F.col("bin" if order is None else "first").alias("sequence_id"), "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
