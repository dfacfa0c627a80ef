"""The pipeline's stages against brute force."""

import corpus_pipeline
from geotiles.llm.common import materialize
from tests.llm import brute


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], data)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == columns
    raw, good, single, clean, mixed, packed = seen
    texts = {r["doc_id"]: r["text"] for r in raw.collect()}

    def kept(t):
        n, _, _, _, rep = brute.quality(t)
        return n >= 50 and 100 * rep <= 50 * n and not brute.fails_other_rules(t)

    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(good) == sorted(d for d, t in texts.items() if kept(t))
    rows = [(d, texts[d]) for d in ids(good)]
    assert ids(single) == sorted({c for _, c in brute.components(rows, 5, 80, 100)})
    assert ids(clean) == ids(single)
    assert not any(brute.secrets(r["text"]) for r in clean.collect()) and all(len(r["text"]) == r["n_chars"] for r in clean.collect())
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(counts) <= set(ids(clean)) and set(counts.values()) <= {1, 2}
    assert packed.where("piece = 0").count() == mixed.count()


def test_empty(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
