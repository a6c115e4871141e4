"""Ids and other columns pass every operator bit for bit: beside nulls, beyond 2**53, repeated, in empty tables and beside clashing names."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from larkfield.llm import bpe, embed_dedup, exact_dedup, html_extract, licenses, near_dedup, packing, resharding, token_counts, toxicity

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
BIG = (1 << 60) + 1
IDS = [BIG, None, BIG + 2, BIG, None, 7]
TEXTS = ["one two three four five six", "other words are here in this one", None, "a third text of its own", "one two three four five six", ""]
NAMES = ["part", "ids", "at", "row", "norm", "hash", "best", "rep", "bucket", "size", "shard", "key", "gram", "_score", "_id", "score", "_dropped", "lead", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *("x" for _ in NAMES)) for i, t in zip(IDS, TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in NAMES)).coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 1), (7, 1, 0), (None, 1, 1), (BIG + 2, None, None)], "doc_id bigint, quality int, toxic int")


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=str)


WANT = sorted(IDS, key=str)


def test_narrow_operators(docs, labels, spark):
    for made in (bpe.encode_table(docs, WORD), token_counts.count_tokens(docs, PIECE), toxicity.toxicity(docs, labels), licenses.scan(docs), resharding.reshard(docs, 3)):
        assert ids(made) == WANT
    assert sorted({str(i) for i in ids(packing.pack(docs, WORD))}) == sorted({str(i) for i in IDS})
    pieces = packing.pack(docs, WORD, window=3).collect()
    assert sum(r.opens for r in pieces) == len(IDS) == sum(r.closes for r in pieces)
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html", "part as text", "at as n_chars")
    assert ids(html_extract.extract_pages(pages), "page_id") == WANT


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, None), ("a", "z")], "doc_id string, text string")
    for made in (bpe.encode_table(docs, WORD), token_counts.count_tokens(docs, PIECE), packing.pack(docs, WORD), exact_dedup.exact_dedup(docs), licenses.scan(docs)):
        assert ids(made) == ["None", "a", "a"] or ids(made) == sorted(["a", "a", None], key=str)


def test_exact_keeps_one_row_of_a_group(docs, spark):
    got = exact_dedup.exact_dedup(docs).collect()
    assert ids(exact_dedup.exact_dedup(docs)) == WANT and sum(r.kept for r in got) == 4
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.group_size == 2} == {(BIG, BIG, 2, True), (None, BIG, 2, False), (BIG + 2, 7, 2, False), (7, 7, 2, True)}
    same = spark.createDataFrame([(4, "ab"), (4, "a b"), (7, "ab"), (4, "a b")], "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(same).collect()
    assert [r.keep_id for r in got] == [4] * 4 and sum(r.kept for r in got) == 1


def test_exact_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    texts = ["hot text " + " " * (k % 5) for k in range(60)] + [f"cold {k // 2}" for k in range(20)] + ["warm"] * 7
    got = exact_dedup.exact_dedup(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)).collect()
    for r in got:
        group = [(-len(t), k) for k, t in enumerate(texts) if t.replace(" ", "") == texts[r.doc_id].replace(" ", "")]
        assert (r.keep_id, r.group_size, r.kept) == (min(group)[1], len(group), r.doc_id == min(group)[1])


def test_near_keeps_one_row_of_a_cluster(docs, spark):
    got = near_dedup.near_dedup(docs)
    assert ids(got) == WANT and all(r.kept and r.cluster_id == r.doc_id for r in got.collect())
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(BIG, base), (BIG, "other " * 3 + "text"), (BIG + 1, base + " more"), (BIG + 2, base), (BIG, base), (None, base), (5, " ".join(f"v{k}" for k in range(60))), (5, base + " end"), (6, " ".join(f"v{k}" for k in range(60)) + " end")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    by_row = {r.row: r for r in got}
    assert [by_row[k].doc_id for k in range(len(rows))] == [i for i, _ in rows]
    assert [by_row[k].cluster_id for k in range(len(rows))] == [5, BIG, 5, 5, 5, None, 5, 5, 5]
    assert [k for k in range(len(rows)) if by_row[k].kept] == [1, 5, 6, 7]


def test_embeddings_repeated_and_null_ids(spark):
    rows = [(BIG, [1.0, 0.0]), (BIG, [1.0, 0.01]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0])]
    got = sorted(embed_dedup.embed_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)).collect(), key=str)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted([(BIG, 1, BIG, True), (BIG, 1, BIG, True), (None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)], key=str)


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_stages_drop_rows_not_ids(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    same = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (2, "unique words here")], "doc_id bigint, text string").coalesce(1)
    same.write.parquet(str(tmp_path / "same"))
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and set(out.collect()) <= set(docs.collect())
        left = stage(spark, spark.read.parquet(str(tmp_path / "same")), folder).collect()
        assert sorted((r.doc_id, r.text) for r in left) == [(1, "aa bb"), (2, "unique words here")]
        assert stage(spark, docs.limit(0), folder).count() == 0
    out = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns and set(out.collect()) <= set(docs.collect())
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), folder).count() == 0


def test_pipeline_toxicity_stage_keeps_what_the_model_keeps(spark):
    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model, rows = toxicity.fit(docs, labels), docs.collect()
    want = {r.doc_id for r, s in zip(rows, model.score([r.text or "" for r in rows])) if s < 0.7}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, base).collect()} == want


def test_pipeline_of_nulls_empties_and_very_long_texts(spark, tmp_path):
    long = " ".join(f"w{k % 5000}" for k in range(200_000))
    rows = [(1, None), (2, ""), (None, "x"), (3, long), (4, long + " end"), (3, "short one"), (3, "short one"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).where("opens").collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, None, 3, 3], key=str)
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
