"""Near duplicates among embeddings against brute force."""

import math

import numpy as np
import pytest

from docsnap.llm import catalog, embeddings, flatgraph


def brute(rows, least=embeddings.COSINE):
    """Links and components; a row's vector is None where it links with nothing."""
    good = [
        i for i, (k, v) in enumerate(rows)
        if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    units = {i: np.array(rows[i][1], np.float32).astype(float) for i in good}
    units = {i: v / np.linalg.norm(v) for i, v in units.items()}
    links = {i: [j for j in good if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in good}
    out = []
    for i, (k, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in links.get(stack.pop(), []):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        top = None if k is None else min(rows[j][0] for j in seen)
        out.append((k, len(links.get(i, [])), top, k is not None and k == top))
    return sorted(out, key=str)


def corpus(seed=1, clusters=40, size=16):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        centre = rng.normal(size=size)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), (centre + rng.normal(size=size) * rng.choice([0.02, 0.15, 0.4])).astype(np.float32).tolist()))
    rows += [(len(rows) + k, rows[5][1]) for k in range(60)]
    rows.append((len(rows), [x * 3 for x in rows[5][1]]))
    odd = [None, [], [0.0] * size, [math.nan] * size, [None] + [1.0] * (size - 1), [math.inf] * size, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    return rows + [(900 + i, v) for i, v in enumerate(odd)] + [(None, rows[5][1]), (None, None)]


def test_like_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, label int, key string")
    expected = brute(rows)
    assert sorted(map(tuple, embeddings.vector_links(df).collect()), key=str) == expected
    monkeypatch.setattr(embeddings, "SHARD_POINTS", 25)  # many shards, and slices of them
    monkeypatch.setattr(embeddings, "CENTRES", 4)
    found = sorted(map(tuple, embeddings.vector_links(df).collect()), key=str)
    assert [r[0] for r in found] == [r[0] for r in expected]
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in expected)
    assert all(a[1] <= b[1] for a, b in zip(found, expected, strict=True))


def test_missed_pairs_are_noticed_where_pairs_are_rare(spark, monkeypatch, caplog):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 24)).astype(np.float32).tolist())]
    rows += [(3000 + i, [x * 1.01 + 0.01 for x in rows[i][1]]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    search = embeddings.links_of

    def lossy(dealt, least, exact_search=False):
        return search(dealt, least, exact_search) if exact_search else search(dealt, least).filter("false")

    monkeypatch.setattr(embeddings, "links_of", lossy)
    with caplog.at_level("WARNING", logger=embeddings.__name__):
        found = sorted(map(tuple, embeddings.vector_links(df).collect()), key=str)
    assert found == brute(rows) and sum(r[1] for r in found) == 6
    assert "all points are compared" in caplog.text


def test_search_on_one_graph():
    rng = np.random.default_rng(3)
    points = embeddings.unit(np.repeat(rng.normal(size=(60, 32)), 10, axis=0) + rng.normal(size=(600, 32)) * 0.1).astype(np.float32)
    graph = flatgraph.symmetric(flatgraph.robust_pruned(points))
    found = flatgraph.range_search(points, points, graph, 0.95)
    truth = points @ points.T >= 0.95
    assert (found & truth).sum() >= 0.99 * truth.sum()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.vector_links(df).collect()] == [(k, 0, k, True) for k, _ in rows]


def test_recall_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = {r["vec_id"]: r for r in catalog.op9_embeddings(spark, folder).collect()}
    expected = {r[0]: r for r in brute(rows)}
    asked = [k for k in expected if k % 50 == 0]
    assert sum(found[k]["n_links"] for k in asked) >= 0.9 * sum(expected[k][1] for k in asked)
    assert sum(r["n_links"] for r in found.values()) >= 0.98 * sum(r[1] for r in expected.values())
