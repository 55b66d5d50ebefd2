"""The pipeline's stages, each on what its predecessor kept."""

import pytest

import corpus_pipeline as cp
from nightgrid.llm import rules
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_jaccard import plain as plain_classes
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        docs.append(cp.stored(stage(spark, docs[-1], SF), f"test-{name}"))
    return docs


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_and_order(steps):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "decontamination", "packing"]
    for df in steps[1:5]:
        assert df.dtypes == steps[0].dtypes and df.exceptAll(steps[0]).count() == 0


def test_classifier_and_rules_follow_labels(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in rows(steps[1])}
    assert all((d in kept) == (q == 1) for d, q in labels.items())
    before = [(r.doc_id, r.base_failed) for r in rules.judge(steps[1]).collect()]
    after = {d for d, _ in rows(steps[2])}
    clean = [d for d, failed in before if not failed]
    assert not after & {d for d, failed in before if failed}
    assert len([d for d in clean if d in after]) >= 0.99 * len(clean)


def test_one_of_each_class_stays(steps):
    least = {}
    for d, c, *_ in plain_classes(rows(steps[2])):
        least[c] = d if c not in least else min(least[c], d)
    assert sorted(d for d, _ in rows(steps[3])) == sorted(least.values())


def test_contaminated_documents_go(spark, steps):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in plain_hits(rows(steps[3]), bench) if r[5]}
    assert dirty and {d for d, _ in rows(steps[4])} == {d for d, _ in rows(steps[3])} - dirty


def test_everything_left_is_packed(steps):
    check_packing(rows(steps[4]), steps[5].collect())


def test_run_gives_the_last_stage(spark, steps):
    got = cp.run(spark, SF)
    assert got.select("doc_id", "piece", "ids_crc32").exceptAll(steps[5].select("doc_id", "piece", "ids_crc32")).count() == 0
    assert got.count() == steps[5].count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
