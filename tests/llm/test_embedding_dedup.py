import numpy as np
import pytest

from difftide.llm.embedding_dedup import learn_rotation, near_duplicates


def brute(rows, threshold):
    """(id, links, component) by all pairs of rows."""
    good = [k for k, (i, v, c) in enumerate(rows) if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    scaled = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in scaled.items()}
    pairs = [(a, b) for n, a in enumerate(good) for b in good[:n] if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    links, comp = [0] * len(rows), [i for i, _, _ in rows]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in rows:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return [(i, n, c, i is not None and i == c) for (i, _, _), n, c in zip(rows, links, comp)]


@pytest.mark.parametrize("chunk", [2048, 7])
def test_links(spark, chunk):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(64).tolist(), k % 3) for k in range(150)]
    rows += [(200 + k, (np.array(rows[k % 20][1]) + 0.02 * rng.standard_normal(64)).tolist(), k % 20 % 3) for k in range(60)]
    rows += [(300 + k, (3 * np.array(rows[1][1])).tolist(), 1) for k in range(30)]
    centre = rng.standard_normal(64)
    rows += [(400 + k, (centre + 0.05 * rng.standard_normal(64)).tolist(), 2) for k in range(40)]
    rows += [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("inf")] * 64, 1), (503, rows[1][1], None), (None, rows[1][1], 1), (504, rows[1][1], 2), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [1e300] * 64, 0), (508, [1e-300] * 64, 0), (1, rows[1][1], 1), (509, [], 0), (510, [None, 1.0], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n long")
    got = sorted(map(tuple, near_duplicates(df, chunk=chunk).collect()), key=str)
    assert got == sorted(brute(rows, 0.93), key=str)


def test_recall_on_registered_shape(spark):
    """Pairs down to the threshold itself: at least 0.9 are found, none too many."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((400, 64))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.93, 0.99, (400, 1))
    both = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * noise])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(both)]
    want = sum(n for _, n, _, _ in brute(rows, 0.93))
    got = sum(r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert 0.9 * want <= got <= want


def test_rotation_and_empty(spark):
    x = np.random.default_rng(7).standard_normal((2000, 16)) * np.linspace(1, 5, 16) + 3
    mean, turn = learn_rotation(x)
    assert np.allclose(turn.T @ turn, np.eye(16)) and abs(((x - mean) @ turn > 0).mean() - 0.5) < 0.03
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("dims, common", [(2, 0.0), (16, 0.0), (32, 0.0), (16, 0.9), (64, 0.9)])
def test_recall_at_the_threshold_itself(spark, dims, common):
    """Short vectors and vectors with a common mean; partners lie at cosine 0.931."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    mean = common * unit(rng.standard_normal(dims))
    base = unit(mean + np.sqrt(1 - common**2) * unit(rng.standard_normal((1500, dims))))
    noise = rng.standard_normal(base.shape)
    noise = unit(noise - (noise * base).sum(1, keepdims=True) * base)
    both = np.concatenate([base, 0.931 * base + np.sqrt(1 - 0.931**2) * noise])
    rows = [(k, v.tolist(), k % 1500) for k, v in enumerate(both)]  # a label for each pair: only it counts
    got = sum(r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert 0.97 * 3000 <= got <= 3000
