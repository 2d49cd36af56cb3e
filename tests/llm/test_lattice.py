"""Lattice hashing against brute force."""

import numpy as np

from quillgraph.llm import lattice


def test_nearest_point_of_e8_is_nearest():
    r = np.random.default_rng(1)
    x = r.standard_normal((200, 8)) * 2
    near, second = lattice.nearest_e8(x)
    for z in (near, second):
        assert ((z % 2 == 0).all(1) | (z % 2 == 1).all(1)).all()
        assert (z.sum(1) % 4 == 0).all()
    # the 240 shortest vectors of the lattice: no neighbour is nearer
    roots = [v for v in np.stack(np.meshgrid(*[[-2, 0, 2]] * 8), -1).reshape(-1, 8) if (v != 0).sum() == 2]
    roots += [v for v in np.stack(np.meshgrid(*[[-1, 1]] * 8), -1).reshape(-1, 8) if v.sum() % 4 == 0]
    assert len(roots) == 240
    own = ((2 * x - near) ** 2).sum(1)
    for v in roots:
        assert (((2 * x - near - v) ** 2).sum(1) >= own - 1e-9).all()


def test_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((300, 64))
    rows = []
    for v in base:
        rows.append(v)
        for _ in range(r.integers(0, 4)):
            rows.append(v + r.standard_normal(64) * r.choice([0.02, 0.1, 0.2, 0.28]) * np.linalg.norm(v) / 8)
    rows = [x.astype(np.float32).tolist() for x in rows]
    rows += [[1.0, 0.5, 0.25], [1.0, 0.5, 0.26], rows[0], rows[0], None, [0.0] * 64, [float("nan")] * 64, [1.0] * 3, [None] + [1.0] * 63, []]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    got = {x["vec_id"]: x for x in lattice.near_duplicates(df).collect()}
    good = [i for i, x in enumerate(rows) if x is not None and len(x) == 64 and None not in x and np.isfinite(x).all() and any(x)]
    v = np.array([rows[i] for i in good], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    want = near.sum(1) - 1
    found = sum(got[i]["n_links"] for i in good)
    assert all(got[i]["n_links"] <= w for i, w in zip(good, want))
    assert found >= 0.97 * want.sum() and want.sum() > 400
    assert len(got) == len(rows)
    other = [i for i, x in enumerate(rows) if x is not None and len(x) == 3 and x[1] < 1]  # vectors of another length
    assert [got[i]["n_links"] for i in other] == [1, 1] and {got[i]["component_id"] for i in other} == {other[0]}
    for i in set(range(len(rows))) - set(good) - set(other):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(x["kept"] == (x["component_id"] == x["vec_id"]) for x in got.values())
    assert got[len(rows) - 8]["component_id"] == 0


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, k string, v string"
    assert lattice.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    odd = [(None, [1.0, 0.0], "", ""), (3, [1.0, 0.0], "", ""), (3, [1.0, 0.0], "", ""), (2, None, "", "")]
    got = sorted((x["vec_id"] or -1, x["n_links"], x["component_id"]) for x in lattice.near_duplicates(spark.createDataFrame(odd, kind)).collect())
    assert got == [(-1, 2, 3), (2, 0, 2), (3, 2, 3), (3, 2, 3)]


def all_links(v):
    v = v / np.linalg.norm(v, axis=1)[:, None]
    return (v @ v.T >= 0.95).sum(1) - 1


def test_large_cells_are_split_and_pairs_counted_once(spark, monkeypatch):
    """A group of near copies beyond a block, in cells of several blocks, beside vectors of their own."""
    monkeypatch.setattr(lattice, "BLOCK", 64)
    monkeypatch.setattr(lattice, "HOT", 3)
    r = np.random.default_rng(3)
    base = r.standard_normal(64)
    v = np.concatenate([base + r.standard_normal((500, 64)) * r.choice([0.02, 0.1, 0.16], 500)[:, None], r.standard_normal((400, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = np.array([x["n_links"] for x in lattice.near_duplicates(df).orderBy("vec_id").collect()])
    want = all_links(v.astype(float))
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum() and want.sum() > 100_000
    assert got[500:].sum() == want[500:].sum() == 0


def test_cells_leave_few_pairs_to_compare(spark):
    """The lattice decides what is compared: of all pairs of unlike vectors fewer than one in 10,000 meet."""
    r = np.random.default_rng(4)
    v = (r.standard_normal((40, 64)).repeat(100, 0) * 0.6 + r.standard_normal((4000, 64))).astype(np.float32)  # 40 topics
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    nodes = lattice.vectors(df, "vec_id", "embedding")
    n = np.array([x["n"] for x in lattice.cell_sizes(lattice.entries(nodes)).collect()])
    assert (n * (n - 1) // 2).sum() < 1e-4 * len(v) * (len(v) - 1) / 2 * 8
    assert n.max() < 0.01 * len(v)


def test_recall_at_the_bound():
    """Pairs at a cosine of 0.95, 0.96 and 0.97 meet in some cell."""
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    a = lattice.signatures(x)
    for c, least in ((0.95, 0.94), (0.96, 0.97), (0.97, 0.99)):
        b = lattice.signatures(c * x + np.sqrt(1 - c * c) * z)
        met = (a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))
        assert met.mean() >= least


def test_null_and_largest_ids(spark):
    top = (1 << 63) - 1
    df = spark.createDataFrame([(top, [1.0, 0.0]), (None, [1.0, 0.0]), (top, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((x["vec_id"] or -1, x["n_links"], x["component_id"], x["kept"]) for x in lattice.near_duplicates(df).collect())
    assert got == [(-1, 1, top, False), (top, 0, top, True), (top, 1, top, True)]
