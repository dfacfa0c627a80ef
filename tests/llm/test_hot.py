"""Very frequent passages, and fingerprints left out, lose no link."""

import random

from geotiles.llm import ngram_join
from tests.llm import brute


def test_shared_passages(spark):
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(120):
        own = [f"o{i // 2}_{k}" for k in range(rng.choice([25, 60, 90]))] if i % 2 == 0 else rows[-1][2]
        own = list(own)
        if i % 2 and rng.random() < 0.7:
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own[:10] + passage + own[10:]), own))
    docs = [(i, t) for i, t, _ in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for n, num in ((3, 90), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_classes(df, n, ngram_join.Bound(num, 100)).collect()}
        assert got == {d: c for (d, _), (_, c) in zip(docs, brute.components(docs, n, num, 100), strict=True)}
