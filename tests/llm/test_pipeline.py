"""The pipeline's stages, each against its operator's brute force, and the whole run."""

import corpus_pipeline
import pytest
from granary.llm.simhash import fingerprint

BENCH = "solve for x when two x plus three equals eleven and explain every step you take"


@pytest.fixture
def sf_dir(spark, tmp_path):
    clean = [f"document {i} " + " ".join(f"w{(i * 7 + k * k) % 211}" for k in range(60)) for i in range(60)]
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100, clean[3]), (101, clean[3]), (102, "intro " + BENCH + " outro"), (103, "password=abcdef12 " + clean[9][:200]), (104, None), (105, None), (106, "")]
    toxic = [(200 + i, " ".join(f"w{(i * 11 + k * k) % 211}" for k in range(40)) + " idiot moron scum") for i in range(40)]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in [*docs, *toxic]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, _ in [*docs, *toxic] if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {None: {r.doc_id: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns + ["pieces"] * (name == corpus_pipeline.STAGES[-1][0])
        out.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept[None]) - set(kept["toxicity"]) == set(range(200, 240))
    alone = {}
    for i, r in sorted(kept["toxicity"].items()):
        alone.setdefault(fingerprint(r.text), i)
    assert set(kept["near_duplicates"]) == set(alone.values()) and not {100, 101, 105, 106} & set(alone.values())
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {102}
    secret = kept["secrets"][103]
    assert "abcdef12" not in secret.text and "[assign]" in secret.text and secret.n_chars == len(secret.text)
    assert all(kept["secrets"][i] == r for i, r in kept["decontamination"].items() if i != 103)
    last = kept["sentencepiece"]
    assert {i: r.text for i, r in last.items()} == {i: r.text for i, r in kept["secrets"].items()}
    assert sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(repr, last.values()))


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
