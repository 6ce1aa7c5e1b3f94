"""The pipeline against plain Python, stage by stage."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from test_documents import brute_components, brute_fingerprint, whole_and_gapless
from tokenizers import Tokenizer

import corpus_pipeline
from molsurf.llm import language_id, packing, toxicity


def test_pipeline_is_brute_force(spark, sf_dir):
    """Decisions of every stage by one text at a time; both sides share the trained models only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    limit = chain.thresholds["toxic"] if chain else 2.0
    kept = [k for k, r in rows.items() if not chain or chain.predict(chain.features([(r["text"] or "").encode()]))[0, 1] < limit]
    model = language_id.train(docs.where(F.col("doc_id").isin(kept)).where(~language_id.is_held_out(F.col("doc_id"))))
    known = []
    for k in kept:
        words = language_id.words_of(rows[k]["text"])
        if words and language_id.has_letter(words) and model.marginals(words).mean(0).max() >= language_id.LEAST_SCORE:
            known.append(k)
    known.sort()
    groups = brute_components([brute_fingerprint(rows[k]["text"]) for k in known])
    stay = [k for i, k in enumerate(known) if groups[i] == i]
    whole = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for k in stay:
        ids = [*whole.encode(rows[k]["text"] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[k, piece] = (at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want
    whole_and_gapless(out, 4096)
    assert out.sequence_id.nunique() <= 1.02 * -(-out.length.sum() // 4096) + 1


def test_sequences_follow_the_mixture(spark, tmp_path):
    """A hot source and rare ones: sequences in order start with documents in the order of the mixture, so all sources come early."""
    rows = [(k, f"text number {k} " * (5 + k % 90), "en", "hot" if k % 10 else f"rare{k % 3}", None) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "mixed")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(path)
    mixed = spark.read.parquet(path)
    at = mixed.select("doc_id", "source", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).toPandas().sort_values(["f", "i"]).reset_index(drop=True)
    place = {d: k for k, d in enumerate(at.doc_id)}
    out = corpus_pipeline.pack(spark, mixed, "").toPandas()
    assert set(out.doc_id) == set(range(3000))
    whole_and_gapless(out, 4096)
    first = out[out.offset == 0].sort_values("sequence_id").doc_id.map(place)
    assert first.is_monotonic_increasing
    early = at.source[:900].value_counts(normalize=True)
    assert early.drop("hot").min() > 0.07 and early["hot"] < 0.75  # by square roots; by counts it would be 0.9
    shuffled = corpus_pipeline.pack(spark, mixed.select("*").orderBy(F.desc("doc_id")), "")  # no files of its own order to tell
    assert shuffled.count() == len(out)


def test_sequence_numbers_beyond_a_file_of_24_bits(spark, tmp_path, monkeypatch):
    """Documents numbered from 2^24 on, and files whose rows go on from one another."""
    import pytest

    full = " ".join(f"word{k}" for k in range(4096))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, full, None, None, None) for k in range(6)], kinds)
    far = packing.pack(docs, order=F.col("doc_id") + (1 << 24) - 2).toPandas()
    whole_and_gapless(far, 4096)
    assert far.sequence_id.nunique() == (far.offset == 0).sum()
    with pytest.raises(ValueError, match="order repeats"):
        packing.pack(docs, order=F.lit(7).cast("long"))
    docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "mixed"))
    seen = {}
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda placed, order: seen.update({r["doc_id"]: r["n"] for r in placed.select("doc_id", order.alias("n")).collect()}))
    corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), "")
    assert seen == {k: k for k in range(6)}


def test_what_stages_wrote_goes(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, sf_dir)
    (top,) = tmp_path.iterdir()
    assert [p.name for p in top.iterdir()] == ["4_best_fit_packing"] and out.count() > 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _at long, _file string, p_toxic double, score string, row int"
    rows = [(k, t, "en", s, None, 1, "f", 0.5, "s", 2) for k, t, s in [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, None, None), (2, "", "x"), (3, "w " * 30_000, None), (None, "some words of a text", "y")]]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(out.doc_id.fillna(-1).astype(int).unique()) == [-1, 1, 3]
    assert (out[out.doc_id == 3].length.sum()) == 30_001
