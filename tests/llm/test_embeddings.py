import numpy as np
import pytest

from gleanery.llm import embeddings as em

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, limit=em.COSINE):
    links = [0] * len(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def good(v):
        return v is not None and None not in v and np.isfinite(v).all() and any(v)

    unit = [np.array(r[1], np.float32).astype(float) if good(r[1]) and r[2] is not None else None
            for r in rows]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] != rows[j][2] \
                    or len(unit[i]) != len(unit[j]):
                continue
            if unit[i] @ unit[j] >= limit:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i))) for i, r in enumerate(rows)), key=str)


def found(spark, rows):
    out = em.near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


def cluster(rng, n, spread, d=64):
    return (rng.normal(size=d) + spread * rng.normal(size=(n, d))).tolist()


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = em.hadamard(x)
    assert np.allclose(em.hadamard(y), x) and np.allclose((x ** 2).sum(1), (y ** 2).sum(1))
    r = em.rotate(x[:, :11], 1, 0)
    assert r.shape == (5, 16) and np.allclose((r ** 2).sum(1), (x[:, :11] ** 2).sum(1))


def test_recall_at_the_threshold():
    """Pairs with a cosine of just 0.93 share a bucket."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1)[:, None] * a
    n /= np.linalg.norm(n, axis=1)[:, None]
    b = em.COSINE * a + np.sqrt(1 - em.COSINE ** 2) * n
    x, y = em.bucket_ids(a, 1), em.bucket_ids(b, 1)
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() > 0.995
    x, y = em.bucket_ids(a, 2), em.bucket_ids(b, 2)
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() > 0.9


def pairs_at_the_threshold(rng, n, d, cosine=em.COSINE):
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1)[:, None] * a
    n /= np.linalg.norm(n, axis=1)[:, None]
    return a, cosine * a + np.sqrt(1 - cosine ** 2) * n


@pytest.mark.parametrize("axes", [1, 2, 3])
@pytest.mark.parametrize("d", [64, 128])
def test_recall_is_the_same_for_all_axes(axes, d):
    a, b = pairs_at_the_threshold(np.random.default_rng(9), 4000, d)
    x, y = em.bucket_ids(a, axes), em.bucket_ids(b, axes)
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() > 0.9995


@pytest.mark.parametrize("bucket, axes", [(10, 2), (1, 3)])
def test_a_large_label_changes_no_links(spark, monkeypatch, bucket, axes):
    """Axes follow from the label alone, and pairs are found with any number."""
    monkeypatch.setattr(em, "BUCKET", bucket)
    rng, rows = np.random.default_rng(13), []
    for label, n in ((1, 1000), (2, 20)):
        for v in np.stack(pairs_at_the_threshold(rng, n, 64, 0.9301), 1).reshape(-1, 64):
            rows.append((len(rows), v.tolist(), label))
    sizes = spark.createDataFrame([(2000, 64), (40, 64)], "n bigint, d int")
    assert [r[0] for r in sizes.select(em.axes_for("n", "d")).collect()] == [axes, 1]
    out = {r[0]: r[1:] for r in found(spark, rows)}
    assert all(out[i] == (1, i - i % 2) for i in range(len(rows)))


def test_pairs_count_in_one_bucket_only():
    left, right = np.array([[5, 9, 2], [1, 2, 3]]), np.array([[9, 5, 7], [4, 5, 6]])
    assert em.first_common(left, right).tolist() == [5, np.iinfo(np.int64).max]


def test_clusters(spark, monkeypatch):
    """A cluster larger than a block, chains about the threshold, lone vectors."""
    monkeypatch.setattr(em, "BLOCK", 50)
    rng = np.random.default_rng(5)
    vectors = cluster(rng, 180, 0.05) + cluster(rng, 60, 0.27) + cluster(rng, 60, 0.28) \
        + rng.normal(size=(100, 64)).tolist()
    rows = [(int(i), v, int(i % 2)) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    assert found(spark, rows) == brute(rows)


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in docs.select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"])
           for r in em.near_embeddings(docs).collect()}
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= em.COSINE) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    assert {i: got[i][0] for i in got} == dict(zip(ids.tolist(), near.sum(1).tolist()))


def test_odd_rows(spark):
    v, w = [1.0, 0.0, 0.0, 0.0], [0.99, 0.01, 0.0, 0.0]
    rows = [(1, v, 1), (2, w, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 4, 1),
            (7, [1.0, float("nan"), 0.0, 0.0], 1), (8, [float("inf"), 0.0, 0.0, 0.0], 1),
            (9, [1.0, None, 0.0, 0.0], 1), (10, [1.0, 0.0], 1), (10, [1.0, 0.0], 1), (None, v, 2),
            (12, [], 1), (13, [-1.0, 0.0, 0.0, 0.0], 1), (14, [5.0], 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == [(1, 0, 1)]
    frame = spark.createDataFrame([(*r, 3, 4) for r in rows], SCHEMA + ", row int, bucket int")
    assert em.near_embeddings(frame).count() == len(rows)


def test_very_many_equal_vectors(spark):
    """A class of equal vectors is compared as one."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 16))
    near = base[0] + rng.normal(size=16) * 0.02
    vectors = [base[0]] * 20_000 + [near] * 7 + [base[1]] * 300 + [base[2], base[3]]
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)],
                                  "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           em.near_embeddings(frame).collect()}
    assert got == {**{i: (20_006, 0) for i in range(20_007)},
                   **{20_007 + i: (299, 20_007) for i in range(300)},
                   20_307: (0, 20_307), 20_308: (0, 20_308)}
