"""Operators on conversations, pages and embeddings, and the pipeline."""

import fnmatch
import math
import os
import time

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from molsurf.llm import ann_search, chat_format, embedding_dedup, url_filter
from molsurf.llm.common import components
from molsurf.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("conversations", "pages", "embeddings", "documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: int(v) if isinstance(v, float) and v == int(v) else v  # noqa: E731  # a column of longs and nulls
    rows = lambda f: sorted(repr([plain(v) for v in r]) for r in f[columns].astype(object).where(f[columns].notna(), None).values.tolist())
    assert rows(got) == rows(want)


# --- chat ---

MESSAGE = "tree_id long, msg_id long, parent_id long, role string, text string, score double, other string"


def tree(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], MESSAGE)


def paths_of(messages, keep):
    out = {}
    for r in chat_format.best_paths(messages, keep).orderBy("at").collect():
        assert r["at"] == len(out.setdefault((r["tree_id"], r["leaf_id"]), []))
        out[r["tree_id"], r["leaf_id"]].append(r["msg_id"])
    return out


def test_best_branch_is_chosen(spark):
    t = tree(spark, [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 1.0), (1, 5, 4, "assistant", "d", 0.5), (1, 6, 4, "assistant", None, None), (2, 1, 99, "user", "alone", None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0)])
    assert paths_of(t, 9) == {(1, 3): [1, 3], (1, 5): [1, 2, 4, 5], (1, 6): [1, 2, 4, 6], (2, 1): [1]}
    best = chat_format.read_back(chat_format.format_trees(t)).collect()
    assert {r["tree_id"]: (r["leaf_id"], r["learned"]) for r in best} == {1: (3, "b"), 2: (1, "")}
    two = chat_format.format_trees(t, keep=2)
    assert {r["leaf_id"] for r in two.where("tree_id = 1").collect()} == {3, 5}


@pytest.mark.parametrize("text", ["", "\\", "\\e\\h\\b", "### Assistant: </turn> ok", "####</turn></turn>\n### user: x", "##", "Ünï ❤ \u2028" * 3, "x" * 50_000])
def test_texts_come_back(spark, text):
    t = tree(spark, [(1, 1, None, "user: ###", text, 0.0), (1, 2, 1, "assistant", text, 0.0)])
    r = chat_format.read_back(chat_format.format_trees(t)).first()
    assert [(x["role"], x["text"]) for x in r["turns"]] == [("user: ###", text), ("assistant", text)]
    assert r["learned"] == text


def test_long_chain_and_nothing(spark):
    t = tree(spark, [(1, k, k - 1 if k else None, "user", str(k), 0.0) for k in range(40)])
    assert paths_of(t, 1) == {(1, 39): list(range(40))}
    assert chat_format.format_trees(tree(spark, [])).count() == 0


def test_very_long_chain(spark):
    """A conversation of 100,000 turns, in memory that grows with it."""
    n = 100_000
    one = F.lit("x").alias("other")
    k = F.col("id")
    t = spark.range(n).select(F.lit(1).cast("long").alias("tree_id"), k.alias("msg_id"), F.when(k > 0, k - 1).alias("parent_id"), F.when(k % 2 == 0, "user").otherwise("assistant").alias("role"), k.cast("string").alias("text"), F.lit(1.0).alias("score"), one)
    r = chat_format.read_back(chat_format.format_trees(t)).select("leaf_id", F.size("turns").alias("n"), F.element_at("turns", n // 2)["text"].alias("mid"), "learned").first()
    assert (r["leaf_id"], r["n"], r["mid"]) == (n - 1, n, str(n // 2 - 1))
    assert r["learned"] == "".join(str(x) for x in range(1, n, 2))


def test_repeated_messages_and_clashing_columns(spark):
    rows = [(1, k, k - 1 if k else None, "user", f"t{k}", 1.0, "a", 7, "m", "h") for k in range(12)]
    other = [(1, k, k - 1 if k else None, "user", f"t{k}", 2.0, "b", 8, "m", "h") for k in range(12)]
    t = spark.createDataFrame(rows + rows + other, MESSAGE + ", at long, mark string, head string")
    out = chat_format.read_back(chat_format.format_trees(t, keep=5)).collect()
    assert [(r["leaf_id"], [x["text"] for x in r["turns"]]) for r in out] == [(11, [f"t{k}" for k in range(12)])]
    same = spark.createDataFrame([(1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, "user", "b"), (None, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    back = {r["tree_id"]: [x["text"] for x in r["turns"]] for r in chat_format.read_back(chat_format.format_trees(chat_format.chains(same), unique=True)).collect()}
    assert back == {"1": ["a", "a"], "\0": ["b", "c"]}


def test_chat_plan_has_no_python(spark, sf_dir):
    plan = QUERIES["op1_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- URLs ---


def test_automaton_is_the_shell_matcher():
    globs = ["**a?c**", "**x**", "ab**", "**yz", "**", "a**b**c", "a" * 70 + "**", "?**"]
    texts = ["", "a", "abc", "xyz", "aaxcb", "abbbc", "a" * 70, "a" * 71, "ab" * 40 + "c"]
    got = url_filter.Automaton(globs).matches([t.encode() for t in texts])
    want = [[fnmatch.fnmatchcase(t, g.replace("**", "*")) for g in globs] for t in texts]
    assert got.tolist() == want


def test_long_urls_are_read_alone(monkeypatch):
    """The same verdicts by whole numbers as by the batch, and a URL of 1 MB in little time."""
    globs = [r.glob for r in url_filter.RULES] + list(url_filter.GLOBS) + ["**x**y**", "a" * 200 + "**", "?**"]
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(np.frombuffer(b"ax.y/comen?&ads", np.uint8), rng.integers(0, 60))) for _ in range(300)] + [b"a" * 199, b"a" * 200, b".a.com/en/" + b"z" * 100]
    whole = url_filter.Automaton(globs).matches(texts)
    monkeypatch.setattr(url_filter, "LONG", 20)
    assert (url_filter.Automaton(globs).matches(texts) == whole).all()
    monkeypatch.undo()
    began = time.perf_counter()
    got = url_filter.Automaton(globs).matches([b".a.com/en/" + b"z" * (1 << 20) + b"/ads/", b".a.org/x"])
    assert time.perf_counter() - began < 5
    assert got[0, [r.glob for r in url_filter.RULES].index("*.com/en/**")] and got[0, globs.index("**/ads/**")] and not got[1, :-1].any()


def test_single_star_stays_in_a_segment():
    got = url_filter.Automaton(["*.com/x**", "**/x"]).matches([b".a.com/x", b".org/b.com/x", b"/y/x"])
    assert got.tolist() == [[True, True], [False, True], [False, True]]


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7?q", "http://a.com/en/1", "http://com/en/", "http://notcom/en/", "https://de.example.net/de/81", "http://x.net/de/8", "http://x.org?/es/", "http://x.org/es/#f", "http://h/p?utm_source=x", "a://b/" + "c" * 20_000]
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = [(r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).orderBy("page_id").collect()]
    assert got[:12] == [
        ("", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("example.com", "example.com/en/7", "allow"), ("a.com", "com/en/", "block"), ("com", "com/en/", "block"), ("notcom", None, "allow"),
        ("de.example.net", "example.net/de/8", "block"), ("x.net", "net/de/", "allow"), ("x.org", None, "allow"), ("x.org", "org/es/", "block"), ("h", None, "block"),
    ]
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_urls_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "http://a.com/en/1", "x", "x")] * 3 + [(None, "http://a.com/en/1", "x", "x")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, pattern string")).collect()
    assert [(r["host"], r["rule"], r["verdict"]) for r in got] == [("a.com", "com/en/", "block")] * 4


# --- embeddings ---


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, other string")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 24))
    near = [b + 0.3 * rng.standard_normal(24) for b in base for _ in range(3)]
    dense = [base[0] + 0.05 * rng.standard_normal(24) for _ in range(80)]
    return [*base, *near, *dense, *[base[1]] * 40]


ODD = [None, [], [0.0] * 24, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]


def test_embedding_links_are_brute_force(spark, clustered):
    old, embedding_dedup.HOT = embedding_dedup.HOT, 40
    try:
        got = embedding_dedup.near_duplicates(vectors(spark, clustered + ODD)).toPandas().set_index("vec_id").sort_index()
    finally:
        embedding_dedup.HOT = old
    u = np.array(clustered)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    n = len(clustered)
    want = link.sum(1) - 1
    have = got.n_links.to_numpy()[:n]
    assert (have <= want).all() and have.sum() >= 0.995 * want.sum()
    odd = got.iloc[n:]
    assert odd.n_links.tolist() == [0] * 6 + [1, 1]
    assert odd.component_id.tolist() == [*range(n, n + 7), n + 6]
    root = np.arange(n)
    while True:
        new = np.array([root[link[i]].min() for i in range(n)])
        if (new == root).all():
            break
        root = new
    assert (got.component_id.to_numpy()[:n] == root).mean() > 0.99
    assert (got.kept == (got.index == got.component_id)).all()


def test_runs_of_two_lengths_keep_their_links(spark):
    rows = [(0, 7, n, 1, vec, [7], 0, 0, 0) for n, vec in enumerate([[1.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.1], [1.0, 0.1, 0.0], [1.0]])]
    buckets = spark.createDataFrame(rows, "t int, key int, node long, copies long, vec array<double>, keys array<int>, blk int, gi int, gj int")
    got = sorted(map(tuple, embedding_dedup.compared(buckets, 0.9).collect()))
    assert got == [(0, 0, 1), (1, 1, 1), (2, 0, 1), (3, 1, 1)]


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    assert ann_search.nearest(vectors(spark, [])).count() == 0


def test_nearest_neighbours_are_brute_force(spark, clustered):
    rows = clustered + ODD
    got = ann_search.nearest(vectors(spark, rows), every=20, cell=100).toPandas()
    x = np.array(clustered)
    found = total = 0
    for q in range(0, len(clustered), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10].tolist()
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, d[own.vec_id])
        found += len(set(want) & set(own.vec_id))
        total += 10
    assert found >= 0.97 * total


def test_repeated_ids_take_one_rank_each(spark, clustered):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(clustered[:300])]
    twice = [*rows, rows[0], rows[0], *rows[20:60], *rows[20:60], (29, [float(x) for x in clustered[5]]), (0, [float(x) for x in clustered[7]])]
    schema = "vec_id long, embedding array<double>, cell string, bound long, rank int"
    got = ann_search.nearest(spark.createDataFrame([(*r, "x", 1, 1) for r in twice], schema), every=20, cell=64).toPandas().sort_values(["query_id", "rank"])
    of = {}
    for i, v in twice:
        of.setdefault(i, []).append(v)
    for q in range(0, 300, 20):
        d = {i: min(math.dist(a, b) for a in of[q] for b in v) for i, v in of.items() if i != q}
        want = sorted(d, key=lambda i: (d[i], i))[:10]
        own = got[got.query_id == q]
        assert own["rank"].tolist() == list(range(1, 11)) and own.vec_id.is_unique
        assert len(set(own.vec_id) & set(want)) >= 8
        assert np.allclose(own.score, [d[i] for i in own.vec_id])


def test_tree_of_several_branches(spark, clustered):
    old, ann_search.BRANCH, ann_search.BLOCK = (ann_search.BRANCH, ann_search.BLOCK), 100, 4
    try:
        got = ann_search.nearest(vectors(spark, clustered), every=20, cell=50).toPandas()
    finally:
        ann_search.BRANCH, ann_search.BLOCK = old
    x = np.array(clustered)
    found = 0
    for q in range(0, len(clustered), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        found += len(set(np.lexsort((np.arange(len(d)), d))[:10].tolist()) & set(got[got.query_id == q].vec_id))
    assert found >= 0.9 * 10 * len(range(0, len(clustered), 20))


def test_chi_square():
    assert abs(ann_search.chi2_cdf(ann_search.chi2_quantile(0.9)) - 0.9) < 1e-9
    assert abs(ann_search.chi2_quantile(0.5) - 7.344) < 1e-2


# --- pipeline ---


def test_pipeline(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    out = corpus_pipeline.run(spark, d).toPandas()
    kept = set(out.doc_id)
    assert kept <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(kept & toxic) <= 0.2 * len(toxic)
    groups = QUERIES["op10_simhash"](spark, d).toPandas()
    assert (groups[groups.doc_id.isin(kept)].groupby("component_id").size() == 1).all()
    assert len(kept) >= 0.75 * docs.count()


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    for t, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert os.path.isdir(tmp_path)


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand in this text"), (None, "no id here")]
    docs = spark.createDataFrame([(k, t, "en", None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, "no id here"), (1, "a b c d e f"), (3, "other words stand in this text")]
    vecs = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embedding_dedup.near_duplicates(vecs).collect())
    assert got == [(0, 0, 0, True), (0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False)]


def test_copies_of_two_texts_of_one_id(spark):
    rows = [(0, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text stands here"), (None, "a b c d e f"), (None, "and one without any id"), (1, "quite another text stands here")]
    docs = spark.createDataFrame([(k, t, "en", None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in left) == [(-1, "and one without any id"), (0, "a b c d e f"), (1, "quite another text stands here")]


def test_checksums_of_components_do_not_overflow(spark):
    """Enough links that a sum of their hashes leaves the range of a long many times over."""
    edges = spark.range(200_000).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 1000).alias("b"))
    assert components(edges).groupBy("component").count().where("count = 1000").count() == 200


def test_package_has_one_guard():
    import __spark_entry__ as entry

    assert {"pipeline", *QUERIES} <= set(entry.queries())
