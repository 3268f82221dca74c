"""Exact duplicates, centroid clustering and Merkle manifests against brute force, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.llm import centroids, exact_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, run int, hash string, idx long, levels string"


def rows_of(spark, rows, parts=5):
    """Rows (doc_id, text, lang, source, n_chars) under more columns named like the operators' own."""
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2, "clash") for r in rows], SCHEMA).repartition(parts)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(None, "a b", "x", None, 3), (3, "ab", None, "s", None), (3, "ab", None, "s", None), (4, "a\tb\x0b", "x", "s", 3), (2, "a b", "y", "s", 3), (5, None, None, None, None), (6, "", "x", "t", 0), (7, " \r\n", "é", "t", 3)]
    rows += [(8, "x " * 70000, "x", "s", 140000), (9, "x" * 70000, "x", "s", 70000), (10, "漢 字", "x", "s", 3), (11, "漢字", "x", "s", 2), (-7, "a  b", "x", "s", 4)]
    rows += [(100 + i, "hot  text" if i % 3 else "hottext", "hot", "s", i) for i in range(90)]
    return rows + [(300 + i, f"word {rng.integers(60)}", ["x", "y", None, "hot"][rng.integers(4)], "s", int(rng.integers(9))) for i in range(300)]


def plain(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


@pytest.mark.parametrize("bits", [1, 3])
def test_exact_dedup(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "FAN_BITS", bits)
    rows = odd_rows()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t, *_ in rows:
        g = groups[plain(t)]
        want.append((i, min(g)[3], len(g), hashlib.sha256(plain(t).encode()).hexdigest()))
    got = exact_dedup.exact_groups(rows_of(spark, rows, 11)).collect()
    key = lambda r: str(tuple(r))
    assert sorted((key((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)) == sorted(map(key, want))
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_carries_columns(spark):
    docs = rows_of(spark, odd_rows()).withColumn("a.b", F.lit(1)).withColumn("carry_0", F.lit("z"))
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert out.count() == len({plain(r[1]) for r in odd_rows()})
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_exact_dedup_has_no_python(spark):
    plan = exact_dedup.exact_groups(rows_of(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoop" not in plan


def lloyd(x, k, rounds, ids):
    order = sorted(range(len(x)), key=lambda j: (hashlib.sha256(f"1:{'' if ids[j] is None else ids[j]}".encode()).hexdigest(), ids[j] is None, ids[j] or 0, x[j].astype(np.int8).tobytes()))
    c = x[order[:k]].copy()
    near = lambda: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        a = near().argmin(axis=1)
        for j in range(len(c)):
            if (a == j).any():
                own = x[a == j]
                c[j] = [int(s) // len(own) for s in own.sum(axis=0)]
    d = near()
    return d.argmin(axis=1), d.min(axis=1), c


def test_sort_means_against_all_distances():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, c = rng.integers(-3, 4, (200, 4)), rng.integers(-3, 4, (9, 4))
        c[3] = c[7]  # equal centroids: the smaller number wins
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        cluster, distance, done = centroids.sort_means(x, rng.integers(0, 9, 200), c)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    x = np.concatenate([rng.integers(-9, 9, (500, 8)) + 1000 * i for i in range(8)])
    _, _, done = centroids.sort_means(x, np.repeat(np.arange(8), 500), np.array([[1000 * i] * 8 for i in range(8)]))
    assert done == len(x)  # all others are beyond the bound


def test_cluster(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.4, (400, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[1].tolist())]
    bad = [(1000, None), (1001, [0.0] * 63), (1002, [0.0] * 63 + [None]), (1003, [float("nan")] + [0.0] * 63), (1004, [float("-inf")] * 64), (1005, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + bad], "vec_id long, vector array<double>, cluster string").repartition(5)
    assigned, last = centroids.cluster(df)
    whole = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    cluster, distance, c = lloyd(whole, 16, 3, [i for i, _ in rows])
    assert (last == c).all()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, assigned.collect())) == sorted(key((i, int(a), int(d))) for (i, _), a, d in zip(rows, cluster, distance))
    out = centroids.described(assigned, last).collect()
    assert {r.inertia for r in out} == {int(distance.sum())}
    assert {(r.cluster, r.cluster_inertia) for r in out} == {(int(j), int(distance[cluster == j].sum())) for j in set(cluster)}


def test_cluster_few_and_far(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, vector array<double>")
    assert centroids.described(*centroids.cluster(df([]))).count() == 0
    far = df([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)])
    got = {r.vec_id: r for r in centroids.described(*centroids.cluster(far)).collect()}
    assert {r.distance for r in got.values()} == {0} and len({r.cluster for r in got.values()}) == 3
    same = df([(i, [0.5] * 64) for i in range(40)])
    assert {(r.cluster, r.distance) for r in centroids.cluster(same)[0].collect()} == {(0, 0)}
    with pytest.raises(ValueError):
        centroids.cluster(df([]), dim=65)


def test_packed_vectors_of_each_width():
    for most in (100, 30000, 1 << 26):
        x = np.random.default_rng(most).integers(-most, most, (7, 64))
        assert (centroids.unpacked(centroids.packed(x)[2:], 64) == x[2:]).all()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        i, t, la, s, n = r
        return H(part(i), part(s), part(la), part(None if n is None else n + more), part(t))

    def tree(nodes):
        """Levels from the nodes to the root."""
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][j : j + 2]) for j in range(0, len(out[-1]), 2)])
        return out

    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    forest = {}
    for k, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        forest[k] = tree([leaf(r) for r in g])
    keys = sorted(groups)
    top = tree([forest[k][-1][0] for k in keys])
    out = []
    for a, k in enumerate(keys):
        for p, r in enumerate(groups[k]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc, proof = leaf(r, 1 if hit and r[4] is not None else 0), ""
            for levels, at in ((forest[k], p), (top, a)):
                for nodes in levels[:-1]:
                    run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += "".join(x for j, x in enumerate(run) if j != at % 2)
                    run[at % 2] = acc
                    acc, at = H(*run), at // 2
            out.append((r[0], leaf(r), forest[k][-1][0], top[-1][0], H(proof), acc, acc == top[-1][0]))
    return out


def digests(df):
    text = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", text, "folded_root", F.col("folded_root") == F.col("root")).collect()]


@pytest.mark.parametrize("stride", [1, 3, 8])
def test_merkle(spark, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    rows = odd_rows()[: 60 if stride == 1 else None]
    got = digests(merkle.manifest(rows_of(spark, rows)))
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(rows)))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_merkle_small(spark):
    for rows in ([], [(7, "only", None, "s", 4)], [(i, "t", f"l{i}", "s", 1) for i in range(5)], [(1, "t", "x", "s", 1)] * 6):
        assert sorted(map(str, digests(merkle.manifest(rows_of(spark, rows))))) == sorted(map(str, brute_manifest(rows))), rows
