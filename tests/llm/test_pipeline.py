import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from rillwork.llm import secrets  # noqa: E402
from rillwork.session import settle  # noqa: E402
from tests.llm.odd import odd_docs  # noqa: E402
from tests.llm.test_links import roots, shingles, similar  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_clean_documents(tables):
    first, language, toxic, unique, masked, packed = tables
    for df in (language, toxic, unique, masked):
        assert df.columns == first.columns
    assert language.count() >= 0.99 * first.count()
    labels = first.sparkSession.read.parquet(f"{SF}/labels.parquet")
    gone = language.join(toxic, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.filter("toxic = 0").count() <= 2 and gone.filter("toxic = 1").count() > 0
    assert packed.select("doc_id").distinct().count() == masked.count()


def test_one_document_of_each_group_stays(tables):
    before, after = tables[2].collect(), {r.doc_id for r in tables[3].collect()}
    sets = [shingles(r.text) for r in before]
    tokens = {}
    for k, s in enumerate(sets):
        for t in s:
            tokens.setdefault(t, []).append(k)
    pairs = {(a, b) for own in tokens.values() for a in own for b in own if b < a}
    label = roots(len(sets), [(a, b) for a, b in pairs if similar(sets[a], sets[b])])
    want = {min(before[k].doc_id for k in range(len(sets)) if label[k] == r) for r in set(label)}
    assert after == want


def test_live_secrets_are_masked(tables):
    kept = tables[4].withColumn("repository", F.concat_ws("/", "source", "lang"))
    assert secrets.weigh_secrets(kept, repository="repository").agg(F.sum("n_live")).first()[0] == 0
    assert tables[4].filter(F.col("text").contains("[SECRET]")).count() > 0
    same = tables[3].join(tables[4].withColumnRenamed("text", "masked"), "doc_id").filter("text != masked AND NOT masked LIKE '%[SECRET]%'")
    assert same.count() == 0 and tables[3].count() == tables[4].count()


def test_run_gives_the_pieces_of_the_last_stage(spark, tables):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tables[5].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        stage(spark, docs.limit(0), SF).collect()
