import corpus_pipeline
from prefengine.llm import decontam, quality, queries, simhash, substrings
from tests.conftest import SF_SMOKE


def test_stages_take_effect(spark):
    """Every stage against its operator's own result on what the stage got."""
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet").cache()
    columns, ids = docs.columns, lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    labels, bench = (spark.read.parquet(f"{SF_SMOKE}/{t}.parquet") for t in ("labels", "benchmark"))

    good = corpus_pipeline.STAGES[0][1](spark, docs, SF_SMOKE).cache()
    assert good.columns == columns and ids(good) == ids(quality.classify(docs, labels).filter("predicted = 1"))
    one = corpus_pipeline.STAGES[1][1](spark, good, SF_SMOKE).cache()
    groups = simhash.near_duplicates(good)
    assert one.columns == columns and ids(one) == ids(groups.filter("doc_id = component_id"))
    cut = corpus_pipeline.STAGES[2][1](spark, one, SF_SMOKE).cache()
    assert cut.columns == columns and ids(cut) == ids(one)
    sizes = {r.doc_id: r.n_bytes - r.n_removed for r in substrings.repeats_digest(one).collect()}
    assert all(0 <= sizes[r.doc_id] - len(r.text.encode()) <= 6 for r in cut.collect())
    clean = corpus_pipeline.STAGES[3][1](spark, cut, SF_SMOKE).cache()
    leaks = {r.doc_id for r in decontam.find_leaks(cut, bench).collect()}
    assert clean.columns == columns and ids(clean) == [i for i in ids(cut) if i not in leaks]
    mix = corpus_pipeline.STAGES[4][1](spark, clean, SF_SMOKE)
    assert ids(mix) == ids(clean) and mix.filter("taken > 3 * size or taken < 0").count() == 0
    assert ids(corpus_pipeline.run(spark, SF_SMOKE)) == ids(mix)


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_leak_query_against_substrings(spark):
    """On the given tables the planted items stand as they are: the query finds each of those documents."""
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_SMOKE}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontaminate"](spark, SF_SMOKE).collect()}
    assert want and want <= got and all(any(w in d.text for w in [i.text[20:60]]) for a, b in got - want for d in docs if d.doc_id == a for i in items if i.item_id == b)
