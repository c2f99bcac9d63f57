"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

A conversation is a path of turns, each named by the digest of its role and text. Conversations of
one path count as one, with their number, smallest id and ids; the ids are hashed in pieces, so
that no task holds all of a common path. Paths are range-partitioned and sorted. In a
partition neighbours are joined in descending order of the turns they share: every merge of
components at a depth is a branching node there, and the nodes between it and the tops of the
merged components are chains of one child.

A node on the path of a partition's first or last row may go on next door. Those spines are all that is
left of a partition once its other nodes are written. Spines are merged across the
boundaries by the digests of their prefixes: counts add up, children are counted once, and what hangs
below a node is summed along the spines, each node by the first spine that has it.

Turns are ordered by number, null first, ties by the digest. Null roles and texts are empty. Turns of
the null conversation belong to none. Repeated rows are turns of their own. Extra columns do not matter.
An empty table gives no rows. The digests of a conversation, some 30 bytes a turn, must fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsnap.llm.common import keep, release, shuffle_width

SHARED = 5
MOST_SHARED = 9
#: Ids of one path that are written as text in one task.
PIECE_IDS = 1 << 14
#: Turns of distinct paths in one partition.
PARTITION_TURNS = 500_000
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits that tell turns apart."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def conversations_of(table: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order: digest and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", turn_digest(role, text).alias("t"), F.octet_length(text).cast("long").alias("b"))
    return (
        table.filter("conv_id is not null")
        .select(F.col("conv_id").cast("long"), turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["t"], t["b"])).alias("turns"))
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the one its block of ids begins with."""
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    first = F.col("conv_id") - F.col("conv_id") % SHARED
    heads = conversations.select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, MOST_SHARED - 1).alias("head")
    )
    own = F.slice("turns", taken.cast("int") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return (
        conversations.withColumn("first", first)
        .join(heads, "first", "left")
        .withColumn("head", F.coalesce(F.slice("head", F.lit(1), taken.cast("int")), F.slice("turns", 1, 0)))
        .select("conv_id", F.concat("head", own).alias("turns"))
    )


def distinct_paths(paths: DataFrame) -> DataFrame:
    """``path`` (digests), ``bytes``, ``n``, ``low`` and ``ends`` of each distinct path.

    ``ends`` is the digest of the ids of conversations with that path, in order.
    """
    named = keep(
        paths.select(
            "conv_id",
            F.transform("turns", lambda t: t["t"]).alias("path"),
            F.transform("turns", lambda t: t["b"]).alias("bytes"),
        ).withColumn("p", F.unhex(F.md5(F.array_join(F.transform("path", F.hex), "").cast("binary")))),
        "paths",
    )
    piece = F.floor(F.col("conv_id") / PIECE_IDS).alias("piece")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = named.groupBy("p", piece).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), ids.alias("ids")
    )

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, total, low = None, None, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"p": [last], "n": [total], "low": [low], "ends": [sha.hexdigest()]})

        for batch in batches:
            for p, n, least, text in zip(*(batch[c].to_pylist() for c in ("p", "n", "low", "ids")), strict=True):
                if p == last:
                    sha.update(b"," + text.encode())
                    total += n
                    continue
                if last is not None:
                    yield row()
                last, sha, total, low = p, hashlib.sha256(text.encode()), n, least
        if last is not None:
            yield row()

    ordered = pieces.repartition(shuffle_width(paths.sparkSession), "p").sortWithinPartitions("p", "piece")
    ends = ordered.select("p", "n", "low", "ids").mapInArrow(digest, "p binary, n long, low long, ends string")
    return ends.select("n", F.col("low").alias("conv_id"), "ends").join(named.drop("p"), "conv_id").select(
        "path", "bytes", "n", F.col("conv_id").alias("low"), "ends"
    )


class Component:
    """Neighbouring paths that share their first ``depth`` turns: a node and what is below it."""

    __slots__ = ("children", "depth", "ends", "first", "last", "leaves", "low", "n", "saved", "waiting")

    def __init__(self, row: int, depth: int, n: int, low: int, ends: str) -> None:
        self.first = self.last = row
        self.depth, self.n, self.low, self.ends = depth, n, low, ends
        self.children = self.leaves = self.saved = 0
        self.waiting: list[int] = []  # written nodes whose parent this node is

    def absorb(self, other: Component) -> None:
        """Another component whose top is at the same depth and the same node."""
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)
        self.n += other.n
        self.low = min(self.low, other.low)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        if len(self.waiting) < len(other.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting += other.waiting


class Forest:
    """The trie of the sorted paths of one partition.

    ``closed`` has the nodes that no other partition can hold, ``open`` those on the paths of the
    first and the last row: what is below them here, but for what is below other open ones.
    """

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        self.closed: list[list] = []
        self.open: list[tuple] = []
        self.spines = [self._names(rows[k][0]) for k in (0, -1)]
        parent = list(range(len(rows)))
        tops = [Component(k, len(path), n, low, ends) for k, (path, _, n, low, ends) in enumerate(rows)]

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        shared = [self._shared(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
        for edge in sorted(range(len(shared)), key=shared.__getitem__, reverse=True):
            a, b = root(edge), root(edge + 1)
            if tops[a].last - tops[a].first < tops[b].last - tops[b].first:
                a, b = b, a
            for k in (a, b):
                self._raise(tops[k], shared[edge])
            tops[a].absorb(tops[b])
            parent[b] = a
        self._raise(tops[root(0)], -1)

    @staticmethod
    def _names(path: list[bytes]) -> list[bytes]:
        """The digest of each prefix, the empty one first."""
        running, names = hashlib.md5(usedforsecurity=False), []
        for turn in (b"", *path):
            running.update(turn)
            names.append(running.copy().digest())
        return names

    @staticmethod
    def _shared(a: list[bytes], b: list[bytes]) -> int:
        for k, (x, y) in enumerate(zip(a, b, strict=False)):
            if x != y:
                return k
        return min(len(a), len(b))

    def _raise(self, top: Component, depth: int) -> None:
        """Writes the nodes from the top of a component up to, without, that depth."""
        last = len(self.rows) - 1
        sides = [side for side, row in ((0, 0), (1, last)) if top.first <= row <= top.last]
        sizes = self.rows[top.first][1]
        while top.depth > depth:
            size = sizes[top.depth - 1] if top.depth else 0
            if sides:
                name = self.spines[sides[0]][top.depth]
                above = self.spines[sides[0]][top.depth - 1] if top.depth else None
                for number in top.waiting:
                    self.closed[number][2] = name
                self.open.append(
                    (sides, name, above, top.depth, size, top.n, top.low, top.children, top.leaves, top.saved, top.ends)
                )
                top.children = top.leaves = top.saved = 0
                top.waiting = []
            else:
                for number in top.waiting:
                    self.closed[number][1] = top.low
                leaves = top.leaves if top.children else 1
                saved = top.saved + (top.n - 1) * size
                top.waiting = [len(self.closed)]
                self.closed.append([top.depth, None, None, top.low, top.n, top.children, leaves, saved, top.ends or EMPTY])
                top.children, top.leaves, top.saved = 1, leaves, saved
            top.ends = None
            top.depth -= 1


NODE = (
    "part int, side int, name binary, above binary, depth long, size long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


NODE_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in NODE.split(", ")), strict=True)
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, NODE_KINDS[kind]) for x, kind in zip(columns, kinds, strict=True)], names=list(names)
    )


def forest_rows(sorted_paths: DataFrame) -> DataFrame:
    """Closed nodes (``side`` null), and open nodes: one row for each spine they are on, counts on the first."""

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        part = None
        for batch in batches:
            rows += zip(*(batch[c].to_pylist() for c in ("path", "bytes", "n", "low", "ends")), strict=True)
            part = batch["part"][0].as_py()
        if not rows:
            return
        forest = Forest(rows)
        for start in range(0, len(forest.closed), 10_000):
            yield _batch(
                [
                    (None, None, None, above, depth, 0, low, parent, n, children, leaves, saved, ends)
                    for depth, parent, above, low, n, children, leaves, saved, ends in forest.closed[start : start + 10_000]
                ]
            )
        spines = []
        for sides, name, above, depth, size, n, low, children, leaves, saved, ends in forest.open:
            spines.append((part, sides[0], name, above, depth, size, low, None, n, children, leaves, saved, ends))
            spines += [(part, side, name, above, depth, size, None, None, 0, 0, 0, 0, None) for side in sides[1:]]
        yield _batch(spines)
        release()

    return sorted_paths.mapInArrow(grow, NODE)


def merged_spines(spines: DataFrame) -> DataFrame:
    """The open nodes as a whole, one row each, with ``name`` and ``above`` (the parent's name)."""
    merged = keep(
        spines.groupBy("name").agg(
            *(F.max(c).alias(c) for c in ("above", "depth", "size", "ends_sha256")),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
            F.min(F.struct("part", "side")).alias("owner"),
        ),
        "spine-nodes",
    )
    children = merged.filter("above is not null").groupBy(F.col("above").alias("name")).agg(F.count("*").alias("opened"))
    nodes = keep(
        merged.join(children, "name", "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("opened", F.lit(0)))
        .withColumn("own_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
        .withColumn("own_saved", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
        .select("name", "above", "depth", "conv_id", "n_convs", "n_children", "own_leaves", "own_saved", "ends_sha256", "owner"),
        "spine-values",
    )
    owned = F.struct("part", "side") == F.col("owner")
    downward = Window.partitionBy("part", "side").orderBy(F.desc("depth"))
    below = (
        spines.select("part", "side", "name", "depth")
        .join(nodes.select("name", "owner", "own_leaves", "own_saved"), "name")
        .withColumn("n_leaves", F.sum(F.when(owned, F.col("own_leaves")).otherwise(0)).over(downward))
        .withColumn("saved_tokens", F.sum(F.when(owned, F.col("own_saved")).otherwise(0)).over(downward))
        .groupBy("name")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    )
    return keep(
        nodes.join(below, "name").select(
            "name", "above", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        ),
        "spines",
    )


def path_trie(paths: DataFrame, partition_turns: int = PARTITION_TURNS) -> DataFrame:
    """The nodes of the trie of ``distinct_paths``."""
    paths = keep(paths, "distinct-paths")
    turns = paths.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    parts = max(1, min(turns, max(shuffle_width(paths.sparkSession), -(-turns // partition_turns))))
    ordered = paths.repartitionByRange(parts, "path").sortWithinPartitions("path")
    rows = keep(forest_rows(ordered.withColumn("part", F.spark_partition_id())), "trie-nodes")
    spines = merged_spines(rows.filter("side is not null"))
    parents = spines.select(F.col("name").alias("above"), F.col("conv_id").alias("open_parent"))
    node = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = rows.filter("side is null").select("above", *node).unionByName(
        spines.withColumn("parent_conv_id", F.lit(None).cast("long")).select("above", *node)
    )
    return (
        every.join(parents, "above", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "open_parent"))
        .select(*node)
    )


def conversation_trie(table: DataFrame, partition_turns: int = PARTITION_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations of a table, one row per node."""
    return path_trie(distinct_paths(rebuilt(keep(conversations_of(table), "turns"))), partition_turns)


SQL = f"""
with ids as (select distinct conv_id::bigint as c, conv_id::bigint::varchar as t from conversations where conv_id is not null),
crcs as (
  select c, (xor(list_reduce(list_prepend(4294967295, [ord(x) for x in string_split(t, '')]),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
      lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9) as h from ids),
turns as (
  select conv_id::bigint as c, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as t,
    strlen(coalesce(text, '')) as b from conversations where conv_id is not null),
numbered as (select *, row_number() over (partition by c order by turn nulls first, t) as k from turns),
rebuilt as (
  select crcs.c, k, t, b from crcs join numbered n on n.c = crcs.c - crcs.c % 5 and k <= h
  union all select crcs.c, k + 1000000000, t, b from crcs join numbered n using (c) where k > h),
steps as (select c, t, b, row_number() over (partition by c order by k) as d from rebuilt),
paths as (
  select c, 0 as d, '' as p, 0 as b, null as up from ids
  union all
  select c, d, p, b, p[:len(p) - 33] as up
  from (select c, d, b, string_agg(t || '.', '' order by d) over (partition by c order by d) as p from steps)),
longest as (select c, max(d) as most from paths group by c),
nodes as (
  select p, any_value(up) as up, d, any_value(b) as b, min(c) as low, count(*) as n,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = most), '')) as ends
  from paths join longest using (c) group by p, d),
children as (select up as p, count(*) as n_children from nodes where up is not null group by up),
whole as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (p)),
below as (
  select paths.p, sum((y.n - 1) * y.b)::bigint as saved, count(*) filter (where y.n_children = 0) as leaves
  from whole y join paths on paths.c = y.low and paths.d <= y.d group by paths.p)
select x.low as conv_id, x.d as depth, parent.low as parent_conv_id, x.n as n_convs, x.n_children, leaves as n_leaves,
  saved as saved_tokens, x.ends as ends_sha256
from whole x join below using (p) left join nodes parent on parent.p = x.up
"""
