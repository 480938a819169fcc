import corpus_pipeline
from difftide.llm import quality, simhash, suffix_dedup, toxicity


def test_stages_one_by_one(spark):
    """Each stage against its operator's own rows, which the operators' tests hold against brute force."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "toxicity", "SimHash near-dedup", "suffix-array dedup", "packing"]

    one = stages["quality classifier"](spark, docs, sf_dir)
    want = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(want)
    two = stages["toxicity"](spark, one, sf_dir)
    clean = {r.doc_id for r in toxicity.toxicity(one, labels).where("predicted = 0").collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == clean
    three = stages["SimHash near-dedup"](spark, two, sf_dir)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == {r.component_id for r in simhash.simhash_groups(two).collect()}
    four = stages["suffix-array dedup"](spark, three, sf_dir)
    assert four.columns == docs.columns and four.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    cut = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(three).collect()}
    before = {r.doc_id: r.text for r in three.collect()}
    after = four.collect()
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        gone = len(before[r.doc_id].encode()) - len(r.text.encode())
        assert cut[r.doc_id] - 8 * (cut[r.doc_id] > 0) <= gone <= cut[r.doc_id] and r.n_chars == len(r.text)
    five = stages["packing"](spark, four, sf_dir).collect()
    assert {r.doc_id for r in five} == set(before)
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.start, r.length) for r in five)


def test_empty(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_odd_rows_and_columns(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns called like those that stages add."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, sf_dir).orderBy("doc_id").limit(30).collect()
    rows = [tuple(r) for r in kept]
    width = len(docs.columns)
    blank = lambda **named: tuple(named.get(c) for c in docs.columns)
    longest = " ".join(r.text for r in kept) * 20
    rows += [rows[0], rows[0], blank(), blank(), blank(doc_id=900_001, text=""), blank(doc_id=900_002, text=longest), blank(doc_id=rows[1][0], text=rows[2][docs.columns.index("text")])]
    clash = ["__kept", "__fingerprint", "__row", "__id", "sequence_id", "offset", "score", "h", "body", "n"]
    schema = docs.schema
    for name in clash:
        schema = schema.add(name, "string")
    odd = spark.createDataFrame([(*r, *clash) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        got = out.collect()
        assert out.columns == odd.columns and len(got) <= len(rows), name
        assert all(tuple(r)[width:] == tuple(clash) for r in got), name
        if name == "suffix-array dedup":
            assert len(got) == len(rows) and sum(r.text is None for r in got) == 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).collect()
    assert sum(r.start == 0 for r in pieces) == len(rows)
