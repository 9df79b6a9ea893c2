"""Whitening, the Merkle manifest and exact top-k against brute force and
edge rows: nulls, empty and very long texts, ties, repeats, empty tables,
extra columns with clashing names."""

import math
import zlib
from hashlib import sha256

import numpy as np
import pytest

from probelab.llm import impacts, merkle, whitening

VECTORS = "vec_id long, embedding array<float>, label int, dim int, x string, row string, n int, w int, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0, "x", "r", 1, 2, 3) for i, v in rows], VECTORS)


def whole(v, scale=64, offset=0):
    return [math.floor(scale * float(np.float32(c))) + offset for c in v]


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


# ---- whitening --------------------------------------------------------------

def brute_whitened(rows, k=16):
    x = np.array([whole(v, offset=1_000_000) for _, v in rows], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(axis=0)
    z = (n * fit - s).astype(float) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = (n * x - s).astype(float) / n @ u[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), out, e / e.sum()


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((90, 20)) @ rng.standard_normal((20, 20)) * np.geomspace(3, 0.02, 20)
    return [(i, v.tolist()) for i, v in enumerate(mixed)] + [(200 + i, mixed[0].tolist()) for i in range(60)]


def test_whitening_matches_dense_eigenvectors(spark, cloud):
    rows = [(None, [1.0] * 20), (7, None), (8, [math.nan] * 20), (9, [None] + [1.0] * 19), (10, [math.inf] * 20), (11, [])] + cloud
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    keep = [(-1 if i is None else i, v) for i, v in usable(rows)]
    n, dev, want, share = brute_whitened(keep)
    assert len(got) == 16 * len(keep) and set(got.n) == {n}
    got["vec_id"] = got.vec_id.fillna(-1)
    wide = got.pivot_table(index=["vec_id"], columns="component", values="whitened", aggfunc="first")
    seen = {i: (d, w) for (i, _), d, w in zip(keep, dev, want)}
    for i, (d, w) in seen.items():
        assert set(got[got.vec_id == i].deviation) == {d}
        np.testing.assert_allclose(np.abs(wide.loc[i].to_numpy()), np.abs(w), rtol=1e-8, atol=1e-8)
    # one sign for all rows of a component
    order = [i for i in seen]
    a, b = wide.loc[order].to_numpy(), np.array([seen[i][1] for i in order])
    np.testing.assert_allclose(a * np.sign((a * b).sum(axis=0)), b, atol=1e-8)
    np.testing.assert_allclose([got[got.component == c].explained.iloc[0] for c in range(1, 17)], share[:16], rtol=1e-9)
    assert got.identity_error.max() < 1e-9


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = {(r.vec_id, r.component): r for r in whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])])).collect()}
    assert flat[1, 2].whitened is None and flat[1, 2].explained == 0 and flat[1, 1].explained == 1
    assert abs(flat[1, 1].whitened) == pytest.approx(1) and flat[2, 1].whitened == flat[3, 1].whitened == -flat[1, 1].whitened
    lengths = whitening.whiten(vectors(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])])).collect()
    assert {(r.vec_id, r.component, r.n) for r in lengths} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)}
    huge = whitening.whiten(vectors(spark, [(1, [3e38]), (2, [-3e38])])).collect()
    assert all(r.deviation is None and abs(r.whitened) == pytest.approx(1) for r in huge)


def test_factor_and_rotations():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((12, 30)) * np.geomspace(1, 1e-6, 12)[:, None]
    v = a @ a.T
    factor, pivots = whitening.pivoted_cholesky(v)
    assert np.allclose(np.triu(factor, 1), 0) and np.allclose(factor @ factor.T, v[pivots][:, pivots], rtol=1e-12, atol=1e-20)
    turned = whitening.one_sided_jacobi(factor)
    gram = turned.T @ turned
    scale = np.sqrt(np.outer(gram.diagonal(), gram.diagonal()))
    assert np.abs(gram / scale - np.eye(12)).max() < 1e-13
    values, columns = whitening.principal(v)
    assert np.allclose(np.sort(values), np.linalg.eigvalsh(v), rtol=1e-6)
    assert np.allclose(v @ columns, columns * values, atol=1e-10 * values[0])
    assert whitening.principal(np.outer([1.0, 2, 3], [1.0, 2, 3]))[1].shape == (3, 1)
    assert whitening.principal(np.zeros((3, 3)))[0].size == 0


# ---- Merkle manifest --------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, pos int, path string, total int, block int"


def h(s):
    return sha256(s.encode()).hexdigest()


def brute_tree(leaves):
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
            paths[k].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        at, level = [i // 3 for i in at], [h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(put, (r[0], r[3], r[2], r[4], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, above = brute_tree([trees[s][0] for s in names])
    out = []
    for s, more in zip(names, above):
        for (_, _, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            path = path + more
            at = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                at = leaf(r, r[1].replace("\n", ""))
            for a, b in path:
                at = h(a + at + b)
            out.append((r[0], own, trees[s][0], root, h("".join(a + b for a, b in path)), at, at == root))
    return sorted(out, key=str)


def documents(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, "p", 2, 3) for r in rows], DOCS)


def audited(spark, rows):
    return sorted((tuple(r) for r in merkle.audit(merkle.manifest(documents(spark, rows))).collect()), key=str)


def test_manifest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"line {i}\nmore", "en", "hot", 5) for i in range(1500)]         # three blocks and a tier above them
    rows += [(5000 + i, f"ü{i}\n", None, f"s{int(rng.integers(9))}", None) for i in range(60)]
    rows += [(None, None, None, None, None), (None, "a\nb", "en", None, 3), (7, "", "en", "lone", 0), (9000, "x\n" * 100_000, "en", "é", 1)]
    rows += [(9001, "same\n", "en", "twice", 5)] * 4 + [(9001, "other", "en", "twice", 5), (9002, "-", "-", "-", 1)]
    got = audited(spark, rows)
    assert got == brute_manifest(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 728, 729, 730])
def test_manifest_sizes(spark, n):
    rows = [(i, "a\n", "en", "s", 2) for i in range(n)]
    assert audited(spark, rows) == brute_manifest(rows)


def test_manifest_empty_and_proofs(spark):
    assert audited(spark, []) == []
    rows = [(i, f"t{i}", "en", f"s{i % 4}", 2) for i in range(40)]
    m = merkle.manifest(documents(spark, rows))
    for r in merkle.proofs(m).collect():
        assert merkle.folded(r.leaf, merkle._path(r.proof)) == m.root


def test_sweeps_hold_the_label_order():
    for n in (1, 2, 5, 9, 10, 27, 100):
        leaves = [h(str(i)) for i in range(n)]
        top, inner = merkle.ascend(leaves, merkle._height(n, True))
        root, paths = brute_tree(leaves)
        assert top == root and list(inner) == sorted(inner)
        got = dict(merkle.descend(n, merkle._height(n, True), inner, ()))
        assert [merkle._steps(got[i]) for i in range(n)] == paths


# ---- exact top-k ------------------------------------------------------------

def brute_top(rows, k=20):
    rows = [(i, whole(v)) for i, v in usable(rows) if i is not None]
    out = []
    for a, (i, q) in enumerate(rows):
        if i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, w)), j, b) for b, (j, w) in enumerate(rows) if b != a and len(w) == len(q))
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, **how):
    return sorted(tuple(r) for r in impacts.top_k(vectors(spark, rows), **how).collect())


@pytest.mark.parametrize("scale", [0.1, 1.0, 40.0])
def test_top_k_matches_brute_force(spark, scale):
    rng = np.random.default_rng(int(scale * 10))
    centres = rng.standard_normal((6, 12))
    rows = [(int(i), (scale * (centres[i % 6] + rng.standard_normal(12) / 4)).tolist()) for i in range(400)]
    rows += [(1000 + i, (scale * centres[0]).tolist()) for i in range(130)]          # a hot vector
    rows += [(40, rows[0][1]), (40, rows[1][1]), (None, rows[0][1]), (2000, None), (2020, [math.nan] * 12), (2040, []), (2060, [1.0, -2.0]), (2061, [3.0, 1.0])]
    want = brute_top(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, shard=64, group=2, block=5) == want       # many shards, groups and blocks


def test_top_k_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(20, [1.0]), (3, [2.0])]) == [(20, 1, 3, 64 * 128)]
    assert found(spark, [(20, [0.0, 0.0]), (3, [2.0, 1.0]), (1, [5.0, -7.0])]) == [(20, 1, 1, 0), (20, 2, 3, 0)]
    big = found(spark, [(20, [1e38, 1.0]), (3, [1e38, 0.0]), (4, [-1e38, 0.0])])
    assert big == [(20, 1, 3, 2 ** 63 - 1), (20, 2, 4, -2 ** 63)]


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(8)
    w = rng.integers(-500, 500, (300, 9))
    shard = impacts.Shard(np.arange(300), np.arange(300), w, levels=16).open()
    for q in (rng.integers(-50, 50, 9), np.zeros(9, int), np.array([3, 0, 0, 0, 0, 0, 0, 0, -1])):
        exact, last = shard.w @ q, None
        for least in (1e9, 2e4, 5e3, 1e3, 100, 1, 0):
            upper, all_in = impacts.bounds(shard, q, least)
            assert (upper >= exact).all() and (last is None or (upper <= last + 1e-6).all())
            last = upper
        assert all_in
