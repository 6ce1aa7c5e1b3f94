"""Benchmark windows in documents, against brute force."""

import hashlib
import random
import re
import time

import pytest

from molsurf.llm import decontaminate
from molsurf.llm.decontaminate import Searcher, find_contaminated, word_slices

DOC = "doc_id long, text string, items string, spans long, item string"
ITEM = "item_id long, text string, doc_id string"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    """(number of words, items, places of words inside an occurrence)"""
    w, hit, names = words_of(text), set(), set()
    for name, own in items:
        v = words_of(own)
        size = min(window, len(v))
        patterns = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else ()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in patterns:
                names.add("" if name is None else str(name))
                hit.update(range(i, i + size))
    return len(w), names, hit


@pytest.mark.parametrize("size", [5, 7, 64, 1 << 20])
@pytest.mark.parametrize("text", ["", " ", "abc", "  abc  ", "a" * 200, "a b  c" * 20, "é ü" * 30, "aaaaaaa bbbbbbb " * 9, "aaaaaa bbbbbbb" * 9, "Ab-Cd_9"])
def test_words_of_slices(text, size):
    assert [w.decode() for part in word_slices(text.encode(), size) for w in part] == words_of(text)


def test_search_is_brute_force():
    rng = random.Random(2)
    for _ in range(120):
        vocabulary = ["a", "b", "c", "D", "e1", "é"][: rng.randint(1, 6)]
        text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        items = [(str(k), text(rng.randint(0, 14))) for k in range(rng.randint(0, 6))]
        window = rng.choice([1, 2, 5, 10])
        search = Searcher([(n, t.encode()) for n, t in items], window)
        for _ in range(6):
            t = text(rng.randint(0, 60))
            n, names, spans = search.scan(t.encode())
            assert (n, names, {k for a, b in spans for k in range(a, b)}) == brute(t, items, window)


def test_occurrences_across_slices(monkeypatch):
    item = " ".join(f"w{k}" for k in range(40))
    text = "x " * 50 + item + " y" * 50 + " short one " * 3
    search = Searcher([("1", item.encode()), ("2", b"short one")], 10)
    whole = search.scan(text.encode())
    monkeypatch.setattr(decontaminate.word_slices, "__defaults__", (16,))
    assert search.scan(text.encode()) == whole == (146, {"1", "2"}, [[50, 90], [140, 146]])


def test_blocks_shift():
    """Most words are never looked at: the shift of a strange block is the pattern's length less one."""
    looked = []

    class Seen(list):
        def __getitem__(self, k):
            looked.append(k)
            return list.__getitem__(self, k)

    search = Searcher([("1", b"a b c d e f g h i j")], 10).groups[0]
    assert list(search.occurrences(Seen([b"z"] * 900))) == []
    assert len(looked) == (900 - 10) // 9 + 1


@pytest.mark.parametrize("part_bytes", [1 << 23, 100])
def test_documents(spark, part_bytes):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "x'y"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(0, 30))) for k in range(30)] + [(None, "alone"), (7, None), (3, "w1"), (8, "one two three"), (8, "one two three")]
    texts = [None, "", "---", "ALONE", "w1", "one, TWO! three", "x" * 100_000] + [text(20) + " " + (rng.choice(items)[1] or "") + " " + text(9) for _ in range(40)]
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts)] + [(5, texts[5], "x", 1, "y"), (None, "alone", "x", 1, "y")]
    docs = spark.createDataFrame(rows, DOC)
    benchmark = spark.createDataFrame([(*i, "z") for i in items], ITEM)
    got = sorted(map(repr, find_contaminated(docs, benchmark, part_bytes=part_bytes).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    want = []
    for doc_id, t, *_ in rows:
        n, names, hit = brute(t, items, 10)
        want.append((doc_id, n, len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(f"Row(doc_id={a!r}, n_words={b}, n_hit={c}, n_items={d}, items_sha256={e!r}, contaminated={f})" for a, b, c, d, e, f in want)


def test_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "aa one two bb one two one", "x", 1, "y")], DOC)
    benchmark = spark.createDataFrame([(4, "one two", "z")], ITEM)
    r = find_contaminated(docs, benchmark).first()
    assert ([tuple(s) for s in r["spans"]], list(r["items"])) == ([(1, 3), (4, 6)], ["4"])
    assert find_contaminated(docs.where("false"), benchmark).count() == 0
    assert not find_contaminated(docs, benchmark.where("false")).first()["contaminated"]


def test_long_words_are_read_once():
    began = time.perf_counter()
    assert Searcher([("1", b"a b")], 10).scan(b"a" * (64 << 20) + b" a b")[2] == [[1, 3]]
    assert time.perf_counter() - began < 10
