"""What queries give on tables larger than those of the other tests, or of other shapes, by small tables that have their traits."""

import time

import duckdb
import numpy as np
import pytest

from gaugeworks.functions import sequential
from gaugeworks.operators import focus, prefix_scores, spectral
from gaugeworks.plans import headline

from .test_oracle import near, plain


@pytest.fixture
def equals_sql(spark, tmp_path):
    """Compares queries with their SQL over tables given as rows and a schema."""

    def compare(names, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        for name in names:
            df = headline.QUERIES[name](spark, str(tmp_path))
            columns = sorted(df.columns)
            got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
            cursor = con.execute(headline.ORACLES[name])
            at = [[d[0] for d in cursor.description].index(c) for c in columns]
            want = sorted(tuple(plain(row[k]) for k in at) for row in cursor.fetchall())
            assert len(got) == len(want), name
            wrong = [(a, b) for a, b in zip(got, want) if a != b and not near(a, b)]
            assert not wrong, (name, wrong[:3])

    return compare


def test_hash_orders_of_ids_over_a_million(equals_sql):
    docs = [(k * 40_009, "\n".join(f"line {j} of {k}" for j in range(9))) for k in range(400)]
    equals_sql(["claim_subsample_cap", "train_test_hash_split", "shuffle_select", "subsample_fraction", "distinct_question_sample"], documents=(docs, "doc_id long, text string"))


def test_matrices_of_many_groups(spark):
    """Many small groups in one batch, among them a lone sample and a large one, against one frame at a time."""
    rng = np.random.default_rng(8)
    rows = [(g, f"k{g}", i, j, float(w), float(c)) for g in range(60) for n in [40 if g == 7 else 1 + g % 5] for i in range(n) for j in range(n) for w, c in [rng.random(2)]]
    pairs = spark.createDataFrame(rows, "g long, h string, i int, j long, entail double, contra double").repartition(2)
    for columns, f in ((["entail"], spectral.eccentricity), (["entail", "contra"], spectral.semantic_sets)):
        want = {tuple(r)[:2]: r.value for r in spectral.per_group(pairs, ["g", "h"], lambda p, f=f, columns=columns: f(*(spectral.dense(p, c) for c in columns))).collect()}
        got = {tuple(r)[:2]: r.value for r in spectral.per_matrix(pairs, ["g", "h"], columns, f).collect()}
        assert got == pytest.approx(want, abs=1e-9) and len(got) == 60


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.85])
def test_clusters_of_many_vectors(threshold):
    """Against one cosine at a time, among them zero and equal vectors; a few thousand take seconds, not minutes."""
    rng = np.random.default_rng(9)
    vectors = np.concatenate([rng.normal(size=(150, 6)), np.zeros((2, 6)), np.ones((3, 6))])
    sums, want = [], []
    for v in vectors:
        scores = [float(v @ s / (np.linalg.norm(v) * np.linalg.norm(s) or 1)) for s in sums]
        best = int(np.argmax(scores)) if scores else -1
        if scores and scores[best] >= threshold:
            sums[best] = sums[best] + v
        else:
            best = len(sums)
            sums.append(v.copy())
        want.append(best)
    assert spectral.cosine_clusters(vectors, threshold) == want
    began = time.perf_counter()
    spectral.cosine_clusters(rng.normal(size=(3000, 64)), 0.5)
    assert time.perf_counter() - began < 10


def test_few_rows_of_a_batch_are_objects_at_once(spark):
    """More rows in one batch than are worked on at once, and a null and an empty one among them."""
    rows = [(k, [float(k), 1.0], [k % 2 == 0, True], [(1, 0, 0.5)]) for k in range(3 * focus.ROWS)] + [(-1, None, None, None), (-2, [], [], [])]
    df = spark.createDataFrame(rows, "id long, b array<double>, k array<boolean>, e array<struct<i:int,j:int,a:double>>").coalesce(1)
    got = {r.id: r.value for r in focus.focus(df, "id", "b", "k", "e", 0.9).collect()}
    assert got == {r[0]: sequential.focus(r[1] or [], r[2] or [], r[3] or [], 0.9) for r in rows}
    texts = spark.createDataFrame([("g", k, [f"w{j}" for j in range(k % 4)]) for k in range(150)], "g string, i int, w array<string>").coalesce(1)
    found = {r.i: [bytes(x) for x in r["keys"]] for r in prefix_scores.prefixes(texts).collect()}
    assert all(found[k] == found[3][: k % 4] for k in range(150)) and len(set(found[3])) == 3
