"""Fill in the middle: rank and select against plain lists, outputs against the contract, and the round trip."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from molsurf.llm import fill_middle
from molsurf.llm.fill_middle import Bits, cuts, fill_in_middle, restored

DOC = "doc_id long, text string, form string, output string, h1 string"


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_rank_and_select(n, share):
    bits = np.random.default_rng(n).random(n) < share
    b = Bits(n)
    b.fill(0, bits)
    b.index()
    ones = np.flatnonzero(bits)
    at = np.arange(n + 1)
    assert b.rank(at).tolist() == [0, *np.cumsum(bits).tolist()]
    assert b.select(np.arange(len(ones))).tolist() == ones.tolist()


@pytest.mark.parametrize("size", [64, 128, 1 << 22])
def test_cuts_are_those_of_a_list(monkeypatch, size):
    monkeypatch.setattr(fill_middle, "SLICE", size)
    rng = random.Random(1)
    texts = ["", "a", "é", "abc def", "12 ab—cd ñ", "x" * 500, " " * 300, "日本語abc日本" * 40, ""] + ["".join(rng.choice("ab é日😀.\n") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    h1, h2 = (np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
    n, at, chars = cuts([t.encode() for t in texts], h1, h2)
    for k, t in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted((int(h1[k]) % (len(units) + 1), int(h2[k]) % (len(units) + 1)))
        prefix, middle = "".join(units[:a]), "".join(units[a:b])
        assert (n[k], at[0, k], at[1, k], chars[0, k], chars[1, k]) == (len(units), len(prefix.encode()), len((prefix + middle).encode()), len(prefix), len(middle))


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_outputs_and_round_trip(spark):
    rng = random.Random(3)
    texts = [None, "", "<P>", "a <S> b", "x<M", "<<P", "a" * 100_000, "é" * 5000, "<", "\0", "one"] + ["".join(rng.choice("ab <PSM>é\n日") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    rows = [(k, t, "f", "o", "h") for k, t in enumerate(texts)] + [(None, "no id here", "f", "o", "h"), (6, texts[6], "f", "o", "h")]
    out = fill_in_middle(spark.createDataFrame(rows, DOC))
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    by_id = {(d, t): plain(d, t) for d, t, *_ in rows}
    want = {d: (x, t or "") for (d, t), x in by_id.items()}
    for r in got:
        x, t = want[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == x
        assert r["back"] == t


def test_shares_sentinels_and_nothing(spark):
    docs = spark.createDataFrame([(k, "some words here", "f", "o", "h") for k in range(50)], DOC)
    assert {r["form"] for r in fill_in_middle(docs, transformed=0).collect()} == {"plain"}
    own = ("[pre]", "[suf]", "[mid]")
    out = fill_in_middle(docs, transformed=100, spm=100, sentinels=own).withColumn("back", restored(F.col("output"), F.col("form"), own))
    assert {(r["form"], r["back"]) for r in out.collect()} == {("spm", "some words here")}
    assert all(r["output"].startswith("[suf]") and r["output"].count("[mid]") == 1 for r in out.collect())
    assert fill_in_middle(docs.where("false")).count() == 0
