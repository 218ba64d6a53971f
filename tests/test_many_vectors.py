"""Nearest vectors of many queries: the vectors are read once, and the results are those of brute force."""

import numpy as np

from docweave.operators import vectors
from docweave.plans import queries_search as S


def test_thousands_of_queries_read_the_vectors_once(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (2_600, 4)).astype(float)  # few different vectors: many equal scores
    m[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    seen = df.mapInArrow(counted, df.schema)
    got = vectors.top_k(seen, df.selectExpr("id as query_id", "vector"), 6, dim=4).collect()
    assert read.value == len(m)  # twice as many before
    norm = np.sqrt((m * m).sum(axis=1))
    some = norm > 0
    unit = m / np.where(some, norm, 1)[:, None]
    scores = np.round(unit @ unit.T, 6)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert set(found) == set(np.flatnonzero(some).tolist())
    for q in range(0, len(m), 37):
        if some[q]:
            others = [i for i in np.flatnonzero(some).tolist() if i != q]
            best = sorted(others, key=lambda i: (-scores[q, i], i))[:6]
            assert [i for _, i, _ in sorted(found[q])] == best


def test_chunk_vectors_are_written_once_in_a_session(spark):
    d = "/root/testdata/sf0.001"
    assert S.kept_vectors(spark, d) is S.kept_vectors(spark, d)
    assert S.kept_vectors(spark, d).inputFiles()
