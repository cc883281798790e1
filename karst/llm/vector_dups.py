"""Near-duplicate vectors: NN-descent over a neighbour graph, recall audited, threshold edges kept."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.llm.common import Workspace, components, shuffle_parts, table

_LOG = logging.getLogger(__name__)

THRESHOLD = 0.98
#: Neighbours in a list, and reverse neighbours that join in at a centre.
K, REVERSE = 8, 8
#: Random projections orders that seed the lists in one round, sign bits of each, rows compared in a block.
ORDERS, BITS, BLOCK = 6, 20, 192
#: Local joins end when one adds no more than this share of threshold edges, or after so many.
LEAST_GAIN, MOST_JOINS = 0.002, 4
#: Number of the first projection order that searches between components; those below seed the lists.
BRIDGE_ORDER = 1 << 20
#: Rows of a tile in which saturated vectors meet their component.
TILE = 256
#: Audited vectors (a documented bound), recall below which another round with new projections follows, rounds without a new
#: link after which it has failed.
AUDITED, LEAST_RECALL, MOST_ROUNDS = 512, 0.97, 3


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all lists of the column have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first `keys` columns, of a sorted partition, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        starts = np.flatnonzero(new)
        if len(starts) == 0:
            held.append(batch)
        else:
            if starts[0] > 0:
                held.append(batch.slice(0, starts[0]))
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for lo, hi in zip(starts[:-1], starts[1:]):
                yield batch.slice(lo, hi - lo)
            held = [batch.slice(starts[-1])]
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _edges(a: list[np.ndarray], b: list[np.ndarray], cos: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return pa.RecordBatch.from_arrays([pa.array(join(a, np.int64)), pa.array(join(b, np.int64)), pa.array(join(cos, np.float64))], names=["a", "b", "cos"])


def _batched(groups: Iterator, each: Callable, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    a, b, cos, n = [], [], [], 0
    for group in groups:
        for x, y, c in each(group):
            a.append(x), b.append(y), cos.append(c)
            n += len(x)
        if n >= size:
            yield _edges(a, b, cos)
            a, b, cos, n = [], [], [], 0
    yield _edges(a, b, cos)


EDGES = "a bigint, b bigint, cos double"


def usable(vectors: DataFrame) -> DataFrame:
    """One row (id, copies, room, v) per different vector; room numbers what may be compared: label and length.
    Vectors that are null, without label or id, empty, zero or hold a null or non-finite component are left out."""
    good = vectors.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")).where("id is not null and label is not null and v is not null")
    good = good.where(F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"))
    good = good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return good.select("id", "copies", F.xxhash64("label", F.size("v")).alias("room"), "v")


def seeds(work: Workspace, nodes: DataFrame, count: int, first_order: int, k: int = K) -> DataFrame:
    """Edges to the nearest of the rows around a vector in each of several random projection orders.

    Rows are sorted by room, sign bits and a projection, so blocks have a fixed size whatever a key holds: a dense
    group is dealt over many blocks and tasks. Where nodes have a component, the rows around are the nearest in the
    order that are of other components, however many of its own lie between.
    """
    apart = "component" in nodes.columns

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths())
            for dim in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == dim))
                x = _matrix(rows.column(2))
                for order in range(first_order, first_order + ORDERS):
                    rng = np.random.default_rng([20240611, order, int(dim)])
                    planes = rng.standard_normal((int(dim), BITS + 1))
                    y = x @ planes
                    sign = (y[:, :BITS] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(np.full(len(x), order, np.int32)), pa.array(sign.astype(np.int64)), pa.array(y[:, BITS]), rows.column(0), rows.column(2), rows.column(3)], names=["room", "ord", "sign", "along", "id", "v", "component"])

    kind = nodes.schema["v"].dataType.simpleString()
    rows = work.keep(nodes.select("id", "room", "v", F.col("component" if apart else "id").alias("component")).mapInArrow(keyed, f"room bigint, ord int, sign bigint, along double, id bigint, v {kind}, component bigint"), "orders")
    order = ["room", "ord", "sign", "along", "id"]
    sorted_rows = rows.repartitionByRange(shuffle_parts(work.spark, count * ORDERS, 25_000), *order).sortWithinPartitions(*order)

    def near(group: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, x = group.column(2).to_numpy(), _matrix(group.column(3))
        step = BLOCK // 2
        for lo in range(0, len(ids), step):
            mine = slice(lo, min(lo + step, len(ids)))
            around = slice(max(0, lo - step // 2), min(lo + step + step // 2, len(ids)))
            cos = x[mine] @ x[around].T
            cos[ids[mine][:, None] == ids[around][None, :]] = -2
            n = min(k, cos.shape[1] - 1)
            if n > 0:
                best = np.argpartition(-cos, n - 1, axis=1)[:, :n]
                yield np.repeat(ids[mine], n), ids[around][best].reshape(-1), np.take_along_axis(cos, best, axis=1).reshape(-1)

    def across(group: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, x, of = group.column(2).to_numpy(), _matrix(group.column(3)), group.column(4).to_numpy()
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(of)]):
            before, after = np.arange(max(0, lo - 2 * BLOCK), lo), np.arange(hi, min(len(of), hi + 2 * BLOCK))
            around = np.r_[before[of[before] != of[lo]][-(BLOCK // 2) :], after[of[after] != of[lo]][: BLOCK // 2]]
            n = min(k, len(around))
            for at in range(lo, hi, BLOCK) if n else ():
                mine = slice(at, min(at + BLOCK, hi))
                cos = x[mine] @ x[around].T
                best = np.argpartition(-cos, n - 1, axis=1)[:, :n]
                yield np.repeat(ids[mine], n), ids[around][best].reshape(-1), np.take_along_axis(cos, best, axis=1).reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(segments(batches, 2), across if apart else near)

    return sorted_rows.select("room", "ord", "id", "v", "component").mapInArrow(run, EDGES)


def nearest(work: Workspace, edges: DataFrame, k: int = K) -> DataFrame:
    """The lists: the k best edges of each vector, in either direction, each once."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).groupBy("a", "b").agg(F.max("cos").alias("cos"))
    best = W.partitionBy("a").orderBy(F.desc("cos"), "b")
    return work.keep(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("a", "b", "cos"), "lists")


def local_join(work: Workspace, nodes: DataFrame, lists: DataFrame, count: int, k: int = K, beside: DataFrame | None = None) -> DataFrame:
    """Neighbours of neighbours: at each centre its list, its best reverse neighbours and itself meet, and pairs
    better than what either has so far come out. A centre holds k + REVERSE + 1 vectors at most. Where nodes have a
    component, only pairs of two components come out; the lists in `beside` meet too."""
    of = "component" if "component" in nodes.columns else "id"
    worst = lists.groupBy("a").agg(F.min("cos").alias("worst"), F.count("*").alias("n")).select(F.col("a").alias("id"), F.when(F.col("n") < k, -1.0).otherwise(F.col("worst")).alias("worst"))
    reverse = lists.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("cos"), "a"))).where(F.col("r") <= REVERSE)
    members = lists.select(F.col("a").alias("centre"), F.col("b").alias("id")).union(reverse.select("b", "a")).union(nodes.select("id", F.col("id").alias("x")))
    members = (members if beside is None else members.union(beside.select("a", "b"))).distinct()
    known = nodes.select("id", "v", F.col(of).alias("component")).join(worst, "id", "left").select("id", "v", "component", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
    known = work.keep(known, "known")
    parts = shuffle_parts(work.spark, count * (k + REVERSE), 40_000)
    at = members.join(known, "id").select("centre", "id", "worst", "v", "component").repartition(parts, "centre").sortWithinPartitions("centre")

    def meet(group: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if group.num_rows > 1:
            ids, worst, x, own = group.column(1).to_numpy(), group.column(2).to_numpy(), _matrix(group.column(3)), group.column(4).to_numpy()
            cos = x @ x.T
            i, j = np.nonzero(np.triu((cos > np.minimum(worst[:, None], worst[None, :])) & (own[:, None] != own[None, :]), 1))
            yield ids[i], ids[j], cos[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(segments(batches, 1), meet)

    return at.mapInArrow(run, EDGES)


def bridged(work: Workspace, nodes: DataFrame, lists: DataFrame, threshold: float, first_order: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(threshold edges, components), with the links between components that full lists have no place for.

    An edge is in neither list only if better ones fill both, so its ends are saturated. Those search again for
    neighbours of other components alone, in new orders and local joins; what they find merges components, until a
    search finds no such link any more. Each search but the last leaves fewer components.
    """
    kept = work.keep(lists.where(F.col("cos") >= threshold).select("a", "b"), "kept")
    full = work.keep(kept.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("a").alias("id")), "saturated")
    while True:
        component = components(work, kept)
        apart = work.keep(nodes.join(full, "id", "left_semi").join(component, "id").select("id", "room", "v", "component"), "apart")
        if apart.groupBy("room").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").isEmpty():
            return kept, component
        count = apart.count()
        cross = nearest(work, seeds(work, apart, count, first_order, k), k)
        best = cross.agg(F.coalesce(F.sum("cos"), F.lit(0.0))).first()[0]
        for _ in range(MOST_JOINS):
            better = nearest(work, cross.unionByName(local_join(work, apart, cross, count, k, lists)), k)
            work.drop(cross)
            cross, was = better, best
            best = cross.agg(F.coalesce(F.sum("cos"), F.lit(0.0))).first()[0]
            if best - was <= LEAST_GAIN * abs(was):
                break
        found = work.keep(cross.where(F.col("cos") >= threshold).select("a", "b"), "bridges")
        work.drop(cross), work.drop(apart)
        if found.isEmpty():
            return kept, component
        more = work.keep(kept.union(found), "kept")
        work.drop(kept), work.drop(component)
        kept, first_order = more, first_order + ORDERS


def _tiled(work: Workspace, nodes: DataFrame, rows: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """(id, n): links of saturated vectors (rows: id), their lists enlarged to their whole component.

    The component is cut in blocks of about TILE vectors; each pair of blocks is one group, wherever it falls, and
    gives a count for each row and no pair.
    """
    sizes = component.groupBy("component").agg(F.count("*").alias("size"))
    wanted = component.join(rows, "id", "left_semi").select("component").distinct()
    placed = component.join(wanted, "component", "left_semi").join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = work.keep(placed.join(nodes.select("id", "copies", "v"), "id"), "placed")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = placed.select("component", every.alias("x"), F.col("block").alias("y"), F.lit(False).alias("row"), "id", "copies", "v")
    lines = placed.join(rows, "id", "left_semi").select("component", F.col("block").alias("x"), every.alias("y"), F.lit(True).alias("row"), "id", "copies", "v")
    key = ["component", "x", "y"]
    tiles = columns.unionByName(lines).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in segments(batches, 3):
            row = group.column(3).to_numpy(zero_copy_only=False)
            ids, copies, x = group.column(4).to_numpy(), group.column(5).to_numpy(), _matrix(group.column(6))
            if row.any() and not row.all():
                linked = (x[row] @ x[~row].T >= threshold) & (ids[row][:, None] != ids[~row][None, :])
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(linked @ copies[~row])], names=["id", "n"])

    return tiles.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


#: Found links of a vector from which a stratum of the audit begins, and true links from which a class does.
STRATA, CLASSES = (0, 1, 2, 8, 64), (1, 2, 8, 64)


def audit(nodes: DataFrame, links: DataFrame, threshold: float, most: int = AUDITED) -> float:
    """Recall of links by vector, in the class of vectors (by number of true links) where it is least.

    Half of a bounded set has no link found, the others are spread evenly over strata by number of links found; each
    stands for its stratum's vectors, so groups of thousands of links count by their vectors, as pairs do. Vectors
    without true links don't count. Each task compares its own vectors with the set, in one product.
    """
    spark = nodes.sparkSession
    turn = [F.xxhash64(F.lit("audit"), "id"), F.col("id")]
    stratum = lambda n: sum((F.col(n) >= at).cast("int") for at in STRATA[1:])
    picked = nodes.join(links, "id", "left").select("id", "room", "v", F.coalesce("n", F.lit(0)).alias("n")).withColumn("s", stratum("n"))
    sizes = {r.s: r["count"] for r in picked.groupBy("s").count().collect()}  # a row a stratum
    rows, weight = {}, {}
    for s, size in sizes.items():
        part = picked.where(F.col("s") == s).orderBy(*turn).limit(most // 2 if s == 0 else most // 2 // (len(STRATA) - 1)).collect()
        rows |= {r.id: r for r in part}
        weight |= {r.id: size / len(part) for r in part}
    if not rows:
        return 1.0
    asked = spark.sparkContext.broadcast([(r.id, r.room, np.array(r.v, np.float64)) for r in rows.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, rooms = np.asarray(batch.column(3).value_lengths()), batch.column(1).to_numpy()
            for dim in np.unique(lengths):
                queries = [q for q in asked.value if len(q[2]) == dim]
                mine = pa.array(lengths == dim)
                if queries:
                    part = batch.filter(mine)
                    ids, room, copies, x = part.column(0).to_numpy(), rooms[lengths == dim], part.column(2).to_numpy(), _matrix(part.column(3))
                    q = np.stack([v / np.sqrt(v @ v) for _, _, v in queries])
                    q_ids, q_rooms = np.array([i for i, _, _ in queries]), np.array([r for _, r, _ in queries])
                    hit = (q @ x.T >= threshold) & (q_rooms[:, None] == room[None, :]) & (q_ids[:, None] != ids[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(hit @ copies)], names=["id", "n"])

    true = nodes.select("id", "room", "copies", "v").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    classes: dict[int, list[float]] = {}
    for r in true:
        if r.n:
            got = classes.setdefault(sum(r.n >= at for at in CLASSES), [0.0, 0.0])
            got[0] += weight[r.id] * min(r.n, rows[r.id].n) / r.n
            got[1] += weight[r.id]
    return min((found / all_ for found, all_ in classes.values()), default=1.0)


def near_duplicate_vectors(work: Workspace, vectors: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Equal vectors of a label are one node with a count. Lists seeded from random projections are refined by local
    joins; a list full of threshold edges is saturated: its vector searches on in other components (see bridged),
    and its links are counted anew over its whole component, in tiles. Rounds with new projections follow while the audit finds too little; if rounds
    bring nothing new and it still does, that is an error which names the recall. Edges at or above the
    threshold are kept, none below.

    Rows that can't be compared (see usable) have no links, are their own component and stay. Rows that share a
    vec_id and a vector are copies of each other. A null vec_id has component null and kept false. Vectors of any length
    are compared whole, with those of their length. An empty table gives no row; other columns are not looked at.
    """
    nodes = work.keep(usable(vectors), "nodes")
    count = nodes.count()
    lists = None
    recall, still, turn, linked = 0.0, 0, 0, -1
    while recall < LEAST_RECALL and still < MOST_ROUNDS:
        found = seeds(work, nodes, count, turn * ORDERS, k)
        lists = nearest(work, found if lists is None else lists.unionByName(found), k)
        before = lists.where(F.col("cos") >= threshold).count()
        for _ in range(MOST_JOINS):
            better = nearest(work, lists.unionByName(local_join(work, nodes, lists, count, k)), k)
            work.drop(lists)
            lists, after = better, better.where(F.col("cos") >= threshold).count()
            if after - before <= LEAST_GAIN * max(after, 1):
                break
            before = after
        kept, component = bridged(work, nodes, lists, threshold, BRIDGE_ORDER + turn * ORDERS, k)
        links = work.keep(_links(work, nodes, kept, component, threshold, k), "counts")
        recall = audit(nodes, links, threshold)
        was, linked = linked, links.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        still, turn = 0 if linked > was else still + 1, turn + 1
    if recall < LEAST_RECALL:
        raise RuntimeError(f"near-duplicate vectors: after {turn} rounds, the last {still} of them without a new link, the audited recall is {recall:.4f}, less than {LEAST_RECALL}")
    _LOG.info("near-duplicate vectors: audited recall %.4f after %d rounds", recall, turn)
    per = nodes.select("id", "copies").join(links, "id", "left").join(component, "id", "left")
    per = work.keep(per.select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component")), "result")
    of_row = nodes.select(F.col("id").alias("node"), "room", F.col("v").alias("w")).where("room is not null")
    named = vectors.select("vec_id", "label", "embedding").withColumn("room", F.xxhash64("label", F.size("embedding")))
    out = named.join(of_row.withColumnRenamed("room", "r"), (F.col("room") == F.col("r")) & (F.col("embedding") == F.col("w")) & F.col("label").isNotNull(), "left")
    out = out.join(per, out.node == per.id, "left")
    component_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component_id).alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def _links(work: Workspace, nodes: DataFrame, kept: DataFrame, component: DataFrame, threshold: float, k: int) -> DataFrame:
    """(id, n): links of each vector that has any, copies of its neighbours counted, its own not."""
    full = work.keep(kept.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("a").alias("id")), "saturated")
    both = kept.select("a", "b").union(kept.select("b", "a")).distinct()
    short = both.join(full.withColumnRenamed("id", "a"), "a", "left_anti").join(nodes.select(F.col("id").alias("b"), "copies"), "b")
    short = short.groupBy("a").agg(F.sum("copies").alias("n")).select(F.col("a").alias("id"), "n")
    return short.unionByName(_tiled(work, nodes, full, component, threshold))


def op5_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(Workspace(spark, "op5"), table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
), n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.l > 0 AND b.l > 0 AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.98
), r AS (
  WITH RECURSIVE t(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a)
  SELECT a, min(b) AS c FROM t GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id
"""
