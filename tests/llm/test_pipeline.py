import corpus_pipeline
from tarnweave.llm import queries

from .data import documents, odd_rows, prose
from .test_toxicity import labelled


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_the_stated_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert {k.split("_")[0] for k in queries.queries()} == {f"op{n}" for n in range(1, 14)}


def test_run_over_a_small_folder(spark, tmp_path):
    rows, labels = labelled()
    near = prose(900, 400).split()
    rows += odd_rows() + [(900, " ".join(near), "a"), (901, " ".join(near[:200] + ["other"] + near[201:]), "b")]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [docs.count()]
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / f"{name}.parquet")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    toxic = {i for i, _, y in labels if y}
    kept = {r["doc_id"] for r in docs.collect()}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len({900, 901} & kept) <= 1 and 2 not in kept
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    want = sorted((r["doc_id"], r["first_word"], r["length"], r["text"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("doc_id is not null").collect())
    got = sorted((r["doc_id"], r["first_word"], r["length"], r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is not null").collect())
    assert got == want and sum(x[2] for x in got) > 1000
