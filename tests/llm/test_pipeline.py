from collections import Counter

import pytest

import corpus_pipeline
from sieveline.llm import langid, mixing, neardup, quality
from tests.llm import cases


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    clean = [(100 + i, " ".join(f"{w}{(i * 31 + k) % 97}" for k, w in enumerate(cases.EN.split() * 3)), "en", "d") for i in range(40)]
    cases.frame(spark, clean).drop("key").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_decide_as_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda d: Counter(r.doc_id for r in corpus_pipeline.judged(d).collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "language ID", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    view = corpus_pipeline.judged(docs)
    assert all(r.doc_id is not None for r in view.collect()) and sum(i >= 1 << 62 for i in ids(docs)) == 2

    after = stages["quality rules"](spark, docs, sf_dir)
    bad = {r.doc_id for r in quality.judge(view, labels).collect() if not r.kept}
    assert any(i >= 1 << 62 for i in bad)  # junk without an id goes too
    assert after.columns == columns and ids(after) == Counter({i: n for i, n in ids(docs).items() if i not in bad})

    after = stages["language ID"](spark, docs, sf_dir)
    found = langid.identify(view, langid.train(view))
    bad = {r.doc_id for r in langid.doubted(found, view).collect()}
    assert bad >= {r.doc_id for r in found.collect() if r.lang_pred == "und"}
    assert after.columns == columns and ids(after) == Counter({i: n for i, n in ids(docs).items() if i not in bad})

    after = stages["MinHash near-dedup"](spark, docs, sf_dir)
    kept = {r.doc_id for r in neardup.near_duplicates(view).collect() if r.kept}
    assert after.columns == columns and ids(after) == Counter(kept)

    after = stages["mixing sources"](spark, docs, sf_dir)
    assert after.columns == columns and ids(after) == ids(mixing.replicated(docs).select(columns))


def test_a_column_with_a_dot_is_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("bucket", "a.b")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_the_whole(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096


def test_shuffled_rejections_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(-1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect())
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    assert one == sorted(-1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect())
