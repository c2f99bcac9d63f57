"""Near duplicates among embeddings, by search on flat graphs over overlapping shards.

Equal vectors are one point. Centres are fitted on a bounded sample; every point joins the shards
of its ``overlap`` nearest centres. Each shard builds a robust-pruned graph, the adjacency lists of
a point from all its shards are united, and every point searches its shards on the united
lists: from the medoid by greedy hops, then by expanding the range. Pairs found are
verified in double precision. A shard above ``SHARD_POINTS`` is cut into slices with a graph each,
and every pair of slices is a group of its own, so no shard has to fit in one task.

A pair counts in the smallest shard that both points are in, so no pair is written: tasks give
sums of links and a spanning forest. For an audit, points with a near one planted beside each are
searched with the others, and more points are drawn until enough of them have links or ``MOST_AUDITED``
are drawn; all are compared with the whole table. While the share of near points found, per point,
is below ``TARGET_RECALL`` for either, the search is repeated with more overlap, and at last all
points are compared in blocks. The recall of every search is logged.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so
do rows without id. Vectors of different lengths never link. Rows that repeat an id are in
one component, each with the links of its vector. Labels and extra columns do not matter. An
empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.llm.common import keep, runs, shuffle_width
from docsnap.llm.flatgraph import range_search, robust_pruned, symmetric
from docsnap.llm.graph import components

COSINE = 0.95
SHARD_POINTS = 2_000
SAMPLE, CENTRES, ROUNDS = 65_536, 4_096, 6
OVERLAPS, TARGET_RECALL = (3, 5, 8), 0.98
AUDITED, LINKED, MOST_AUDITED = 256, 64, 4_096

#: What a search gives, one row per point and group.
LINKS = "key long, node long, links long, near long, root long, planted boolean"

log = logging.getLogger(__name__)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def good_vector() -> Column:
    return F.expr(
        "vec_id is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )


def plain_vector() -> Column:
    """The vector with one zero instead of two."""
    return F.transform("embedding", lambda x: x + F.lit(0).cast("float"))


def points_of(table: DataFrame) -> DataFrame:
    """``key``, ``node`` (smallest id), ``copies`` and ``embedding`` of the distinct good vectors."""
    return (
        table.filter(good_vector())
        .select(F.col("vec_id").cast("long"), plain_vector().alias("embedding"))
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        .withColumn("key", F.xxhash64("embedding"))
    )


def centres(points: DataFrame, size: int, overlap: int) -> np.ndarray:
    """Unit centres, fitted on a sample of at most ``SAMPLE`` points drawn by hash."""
    number = max(1, min(CENTRES, -(-size * overlap // SHARD_POINTS)))
    wanted = min(size, SAMPLE, 64 * number)
    draw = F.pmod(F.xxhash64("key", F.lit("centres")), F.lit(1 << 40))
    drawn = points.filter(draw < int((1 << 40) * min(1.0, 1.1 * wanted / max(size, 1))))
    sample = unit(matrix(drawn.select("key", "embedding").toArrow().sort_by("key")["embedding"])[:SAMPLE]).astype(np.float32)
    rng = np.random.default_rng(0)
    middle = sample[rng.permutation(len(sample))[:number]]
    for _ in range(ROUNDS):
        of = np.concatenate([(part @ middle.T).argmax(axis=1) for part in np.array_split(sample, -(-len(sample) // 4096))])
        sums = np.zeros_like(middle)
        np.add.at(sums, of, sample)
        empty = ~sums.any(axis=1)
        sums[empty] = middle[empty]
        middle = unit(sums).astype(np.float32)
    return middle


def sharded(points: DataFrame, middle: np.ndarray, overlap: int) -> DataFrame:
    """The points with ``shards``, the numbers of their nearest centres in ascending order."""
    sent = points.sparkSession.sparkContext.broadcast(middle)
    near = min(overlap, len(middle))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                likeness = unit(matrix(batch["embedding"])).astype(np.float32) @ sent.value.T
                shards = np.sort(np.argpartition(-likeness, near - 1, axis=1)[:, :near], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, shards.size + 1, near, dtype=np.int32), shards.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "shards"])

    kind = dict(points.dtypes)["embedding"]
    return points.select("key", "node", "copies", "embedding").mapInArrow(
        assign, f"key long, node long, copies long, embedding {kind}, shards array<int>"
    )


def adjacency(members: DataFrame) -> DataFrame:
    """``key`` and ``neighbours``, united over the shards of each point."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "grp"):
            keys = rows["key"].to_numpy()
            lists = robust_pruned(unit(matrix(rows["embedding"])).astype(np.float32))
            counts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.ListArray.from_arrays(counts, keys[np.concatenate(lists)])],
                names=["key", "neighbours"],
            )

    grouped = members.select(F.xxhash64("shard", "slice").alias("grp"), "key", "embedding")
    dealt = grouped.repartition(shuffle_width(members.sparkSession), "grp").sortWithinPartitions("grp", "key")
    lists = dealt.mapInArrow(build, "key long, neighbours array<long>")
    # A point is in a few shards, and each gives it a few neighbours.
    return lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


def _found(rows: pa.Table, least: float, exact_search: bool) -> np.ndarray:
    """Verified links among the rows of one group: a slice, or two of them against each other."""
    exact = unit(matrix(rows["embedding"]))
    quick = exact.astype(np.float32)
    keys = rows["key"].to_numpy()
    order = np.argsort(keys)
    linked = np.zeros((len(keys), len(keys)), bool)
    left, right = (np.flatnonzero(rows[x].to_numpy(zero_copy_only=False)) for x in ("is_left", "is_right"))
    lists = rows["neighbours"].combine_chunks()
    starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for mine, theirs in ((left, right),) if rows["inner"][0].as_py() else ((left, right), (right, left)):
        if not len(mine) or not len(theirs):
            continue
        if exact_search:
            linked[np.ix_(mine, theirs)] |= quick[mine] @ quick[theirs].T >= least - 1e-5
            continue
        place = np.full(len(keys), -1)
        place[theirs] = np.arange(len(theirs))
        near = []
        for row in theirs.tolist():
            named = values[starts[row] : starts[row + 1]]
            at = np.minimum(np.searchsorted(keys[order], named), len(keys) - 1)
            inside = place[order[at][keys[order[at]] == named]]
            near.append(inside[inside >= 0])
        found = range_search(quick[mine], quick[theirs], symmetric(near), least)
        row, at = np.nonzero(found)
        linked[mine[row], theirs[at]] = True
    linked |= linked.T
    np.fill_diagonal(linked, False)
    row, at = np.nonzero(linked)
    for k in range(0, len(row), 1 << 16):
        part = slice(k, k + (1 << 16))
        true = np.einsum("ij,ij->i", exact[row[part]], exact[at[part]]) >= least
        linked[row[part][~true], at[part][~true]] = False
    return linked


def links_of(dealt: DataFrame, least: float, exact_search: bool = False) -> DataFrame:
    """Per point and group: its links there, near points, and the point it hangs on.

    Points without copies are planted: they have links, and are none of others.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "grp"):
            linked = _found(rows, least, exact_search)
            shards = matrix(rows["shards"])
            own = rows["shard"][0].as_py()
            # The smallest shard of both is where a pair counts.
            row, at = np.nonzero(linked)
            for k in range(0, len(row), 1 << 18):
                part = slice(k, k + (1 << 18))
                below = [(shards[row[part]] == shards[at[part], j][:, None]).any(axis=1) & (shards[at[part], j] < own)
                         for j in range(shards.shape[1])]
                earlier = np.any(below, axis=0)
                linked[row[part][earlier], at[part][earlier]] = False
            copies = rows["copies"].to_numpy()
            planted = copies == 0
            links, near = linked @ copies, linked[:, ~planted].sum(axis=1)
            linked[planted] = linked[:, planted] = False
            some = np.flatnonzero(links)
            if len(some):
                root = np.arange(len(linked))
                for k in some.tolist():
                    if root[k] == k:  # everything reachable hangs on the first of it
                        reached, front = np.zeros(len(linked), bool), np.array([k])
                        while len(front):
                            reached[front] = True
                            front = np.flatnonzero(linked[front].any(axis=0) & ~reached)
                        root[reached] = k
                keys, nodes = rows["key"].to_numpy(), rows["node"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[some]), pa.array(nodes[some]), pa.array(links[some]), pa.array(near[some]),
                     pa.array(nodes[root[some]]), pa.array(planted[some])],
                    names=["key", "node", "links", "near", "root", "planted"],
                )

    columns = ["grp", "shard", "shards", "inner", "is_left", "is_right", "key", "node", "copies", "embedding", "neighbours"]
    return dealt.select(columns).mapInArrow(search, LINKS)


def searched(points: DataFrame, size: int, overlap: int | None, least: float) -> DataFrame:
    """All links between points, as sums and forests; without overlap by comparing all of them."""
    middle = centres(points, size, overlap or 1)
    homes = keep(sharded(points, middle if overlap else middle[:1], overlap or 1), "vector-homes")
    placed = homes.select("key", F.explode("shards").alias("shard"))
    slices = placed.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_POINTS).cast("int").alias("slices"))
    members = homes.withColumn("shard", F.explode("shards")).join(slices, "shard")
    members = members.withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    if overlap:
        members = members.join(keep(adjacency(members), "vector-graph"), "key")
    else:
        members = members.withColumn("neighbours", F.array().cast("array<long>"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda k: F.struct(F.least(k, "slice").alias("x"), F.greatest(k, "slice").alias("y")),
    )
    dealt = (
        members.withColumn("pair", F.explode(pairs))
        .withColumn("grp", F.xxhash64("shard", "pair.x", "pair.y"))
        .withColumn("inner", F.expr("pair.x = pair.y"))
        .withColumn("is_left", F.expr("slice = pair.x"))
        .withColumn("is_right", F.expr("slice = pair.y"))
        .repartition(shuffle_width(points.sparkSession), "grp")
        .sortWithinPartitions("grp", "key")
    )
    return keep(links_of(dealt, least, not overlap), "vector-links")


def exact_links(points: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """Near points of a bounded set of points by comparison with all others, in blocks."""
    asked = queries.select("key", "embedding").toArrow()
    ids, vectors = asked["key"].to_numpy(), matrix(asked["embedding"])
    sent = points.sparkSession.sparkContext.broadcast((ids, unit(vectors) if len(ids) else vectors))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        for batch in batches:
            if batch.num_rows and len(ids):
                linked = (vectors @ unit(matrix(batch["embedding"])).T >= least) & (ids[:, None] != batch["key"].to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(linked.sum(axis=1))], names=["key", "true_near"]
                )

    found = points.select("key", "embedding").mapInArrow(compare, "key long, true_near long")
    return found.groupBy("key").agg(F.sum("true_near").alias("true_near")).filter("true_near > 0")


def drawn(points: DataFrame, size: int, number: int) -> DataFrame:
    """About that many points, drawn by hash; all of them if there are no more."""
    share = min(1 << 40, (1 << 40) * number // max(size, 1))
    return points.filter(F.pmod(F.xxhash64("key", F.lit("audit")), F.lit(1 << 40)) < share)


def planted(points: DataFrame, size: int, least: float) -> DataFrame:
    """New points without copies, each near one that was drawn, at any cosine from ``least`` to 1."""
    rng = np.random.default_rng(1)
    beside = unit(matrix(drawn(points, size, AUDITED).select("key", "embedding").toArrow().sort_by("key")["embedding"]))
    aside = rng.normal(size=beside.shape)
    aside -= (aside * beside).sum(axis=1, keepdims=True) * beside
    aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-300)
    cosine = rng.uniform(least + 1e-5, 1 - 1e-5, (len(beside), 1))
    vectors = (cosine * beside + np.sqrt(1 - cosine * cosine) * aside).astype(np.float32)
    kind = dict(points.dtypes)["embedding"]
    made = points.sparkSession.createDataFrame([(v,) for v in vectors.tolist()], f"embedding {kind}")
    made = made.select(F.xxhash64("embedding").alias("key"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), "embedding")
    made = made.dropDuplicates(["key"])
    known = [r["key"] for r in made.select("key").collect()]
    taken = [r["key"] for r in points.filter(F.col("key").isin(known)).select("key").collect()]
    return made.filter(~F.col("key").isin(taken))


def recall(points: DataFrame, extra: DataFrame, size: int, links: DataFrame, least: float) -> float:
    """The share of near points found, per point; the lower of planted points and points drawn."""
    found = links.groupBy("key").agg(F.sum("near").alias("near"))

    def audit(asked: DataFrame) -> tuple[int, float]:
        both = exact_links(points, asked, least).join(found, "key", "left")
        share = F.least(F.coalesce("near", F.lit(0)), F.col("true_near")) / F.col("true_near")
        number, mean = both.agg(F.count("*"), F.avg(share)).first()
        return number, 1.0 if mean is None else mean

    number = AUDITED
    linked, real = audit(drawn(points, size, number))
    while linked < LINKED and number < min(size, MOST_AUDITED):
        number *= 4
        linked, real = audit(drawn(points, size, number))
    beside, made = audit(extra)
    log.info("recall %.4f of %d points with links among %d drawn, %.4f of %d planted", real, linked, number, made, beside)
    return min(real, made)


def vector_links(table: DataFrame, least: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept``, one row per vector."""
    points = keep(points_of(table), "vector-points")
    found = []
    for length, size in sorted(points.groupBy(F.size("embedding")).count().collect()):
        part = points.filter(F.size("embedding") == length)
        extra = keep(planted(part, size, least), "vector-planted")
        for overlap in OVERLAPS:
            links = searched(part.unionByName(extra), size, overlap, least)
            if recall(part, extra, size, links, least) >= TARGET_RECALL:
                break
        else:
            log.warning("recall below %.2f at overlap %d; all points are compared", TARGET_RECALL, overlap)
            links = searched(part, size, None, least)
        found.append(links.filter("not planted"))
    if not found:
        found.append(points.sparkSession.createDataFrame([], LINKS))
    links = reduce(DataFrame.unionByName, found)
    near = links.groupBy("key").agg(F.sum("links").alias("near"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = keep(
        points.select("key", "node", "copies")
        .join(near, "key", "left")
        .join(groups, "node", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("top")),
        "vector-classes",
    )
    key = F.when(good_vector(), F.xxhash64(plain_vector()))
    rows = table.select(F.col("vec_id").cast("long"), key.alias("key")).join(known, "key", "left")
    return rows.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("top", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("top", "vec_id"), F.lit(False)).alias("kept"),
    )
