"""Approximate nearest neighbours by multiprobe p-stable hashing, by cosine.

Vectors are scaled to length one, so near by cosine is near by Euclidean
distance. Each of TABLES tables has HASHES functions floor((a.x + b) / WIDTH)
with Gaussian a; a bucket is one value of all of them. For a query and a
neighbour at distance r, a bucket's success probability is a product of normal
probabilities. A query visits perturbed buckets in falling order of that
estimate until the visited ones together succeed with probability REACH over
all tables; r is the distance to its nearest vectors in a bounded sample. All
vectors in visited buckets of all tables are ranked by exact cosine in double
precision, from the original components.

Every vector is indexed. Equal vectors are one entry that carries the smallest
ids, no more than an answer can use; equal queries are searched once. Buckets
are shuffled in cells (by their leading hashes), cells of many vectors or
queries in blocks, so no task holds more than BLOCK of either whatever the
skew. The cells' probabilities decide where a query goes; within a block, the
same estimate decides which buckets it visits. A query that finds fewer than it
asks for visits every bucket.

Bounds: the sample holds at most SAMPLE vectors. Cases: vectors that are null,
empty, zero, or hold null or non-finite components take no part, neither as
queries nor as candidates; rows with a null id neither; vectors of different
lengths are never compared, and those of a length that the sample misses visit
every bucket; a query is never its own neighbour, another row
with the same id and vector neither; ties go to smaller ids; with fewer
candidates than asked for, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

TABLES, HASHES, WIDTH = 4, 6, 1.5
REACH = 0.975       # estimated probability that a neighbour is in a visited bucket of some table
SAMPLE = 4_096
BLOCK = 4_096
SEED = 20_27
#: Values of a hash that can matter: unit vectors project to a standard normal.
SPAN = 4


def family(table: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (size x HASHES) and offsets of a table's functions."""
    rng = np.random.default_rng([SEED, table, size])
    return rng.normal(size=(size, HASHES)), rng.uniform(0, WIDTH, HASHES)


def codes(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash values, from 0 to 2 * SPAN - 1 (the outermost take all beyond), and the projections."""
    a, b = family(table, x.shape[1])
    p = x @ a + b
    return np.clip(np.floor(p / WIDTH), -SPAN, SPAN - 1).astype(np.int64) + SPAN, p


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in x.ravel().tolist()]).reshape(x.shape)


def value_log_probabilities(projected: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Log probability that a neighbour at distance r has each hash value: queries x HASHES x values."""
    edges = np.arange(-SPAN + 1, SPAN) * WIDTH
    below = 0.5 * (1 + _erf((edges - projected[:, :, None]) / (np.maximum(r, 1e-3)[:, None, None] * math.sqrt(2))))
    p = np.diff(np.concatenate([np.zeros((*below.shape[:2], 1)), below, np.ones((*below.shape[:2], 1))], axis=2), axis=2)
    return np.log(np.maximum(p, 1e-12))


def visit_limit(values: np.ndarray, goal: float) -> float:
    """Log probability of the last bucket visited: in falling order, up to it they reach the goal together.

    values: HASHES x values of one query. Prefixes too unlikely to matter for
    the goal are left out on the way: together they hold less than its slack.
    """
    slack = (1 - goal) / 20
    logs = np.zeros(1)
    for row in values:
        logs = (logs[:, None] + row).ravel()
        logs = np.sort(logs)[::-1]
        mass = np.cumsum(np.exp(logs))
        logs = logs[:np.searchsorted(mass, mass[-1] - slack / len(values)) + 1]
    mass = np.cumsum(np.exp(logs))
    return float(logs[min(np.searchsorted(mass, goal), len(logs) - 1)]) - 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    x = x / top
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision; the same for a pair whatever else is in the batch."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def usable(vector: Column) -> Column:
    """Is a vector given, not zero, and of finite components only?"""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def _cell_key(code: np.ndarray, leading: int) -> np.ndarray:
    key = np.zeros(len(code), np.int64)
    for j in range(leading):
        key = key * (2 * SPAN) + code[:, j]
    return key


def _index_rows(leading: int):
    """Each vector once a table, with its cell."""
    def run(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column(0)]) if b.num_rows else np.zeros(0, int)
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                x = _unit(_matrix(part.column(0)))
                for t in range(TABLES):
                    cell = _cell_key(codes(x, t)[0], leading)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t), pa.int32()), pa.array(np.full(len(x), size), pa.int32()),
                         pa.array(cell), *part.columns], ["table", "size", "cell", "vector", "ids"])
    return run


def _probe_rows(leading: int, sample: dict[int, np.ndarray], total: int, k: int, goal: float):
    """Each query once for every table and cell that holds buckets it visits, with its distance and limit."""
    heads = np.indices((2 * SPAN,) * leading).reshape(leading, -1).T if leading else np.zeros((1, 0), int)

    def run(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column(1)]) if b.num_rows else np.zeros(0, int)
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                x = _unit(_matrix(part.column(1)))
                known = sample.get(size, x[:0])
                guess = goal < 1 and len(known) > 1  # else every bucket is visited
                r = np.ones(len(x))
                if guess:
                    near = np.sort(1 - x @ known.T, axis=1)
                    # itself, if it is in the sample, doesn't count
                    near = np.where(near[:, :1] < 1e-9, near[:, 1:], near[:, :-1])
                    place = min(max(math.ceil(k * len(known) / total), 1), near.shape[1]) - 1
                    r = np.sqrt(2 * np.clip(near[:, place], 1e-6, 2))
                for t in range(TABLES):
                    values = value_log_probabilities(codes(x, t)[1], r)
                    limit = np.array([visit_limit(v, goal) for v in values]) if guess else np.full(len(x), -np.inf)
                    best = values[:, leading:].max(2).sum(1)
                    reach = sum((values[:, j][:, heads[:, j]] for j in range(leading)), np.zeros((len(x), len(heads))))
                    q, h = np.nonzero(reach + best[:, None] >= limit[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), t), pa.int32()), pa.array(np.full(len(q), size), pa.int32()),
                         pa.array(_cell_key(heads[h], leading)), part.column(0).take(pa.array(q)),
                         part.column(1).take(pa.array(q)), pa.array(r[q]), pa.array(limit[q])],
                        ["table", "size", "cell", "query", "vector", "r", "lim"])
    return run


FOUND = "query bigint, vec_id bigint, score double"


def _search_block(k: int):
    """Ids of the vectors in visited buckets of a block with the k largest cosines, for each of its queries."""
    def run(key, index: pa.Table, probes: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if index.num_rows and probes.num_rows:
            table = index["table"][0].as_py()
            raw, raw_q = _matrix(index["vector"]), _matrix(probes["vector"])
            x, ids = _unit(raw), index["ids"].to_pylist()
            smallest = np.array([i[0] for i in ids])
            buckets, of = np.unique(codes(x, table)[0], axis=0, return_inverse=True)
            of = of.ravel()
            q_ids, r, limits = (probes[c].to_numpy() for c in ("query", "r", "lim"))
            for lo in range(0, len(q_ids), 256):
                q = _unit(raw_q[lo:lo + 256])
                values = value_log_probabilities(codes(q, table)[1], r[lo:lo + 256])
                logs = sum(values[:, j][:, buckets[:, j]] for j in range(HASHES))
                visited = (logs >= limits[lo:lo + 256, None])[:, of]
                near = np.where(visited, q @ x.T, -np.inf)
                least = np.partition(near, -min(k, len(x)), axis=1)[:, -min(k, len(x))] - 1e-12
                for j, row in enumerate(near):
                    at = np.flatnonzero(row >= max(least[j], -2.0))
                    if not len(at):
                        continue
                    s = cosine(np.broadcast_to(raw_q[lo + j], (len(at), raw.shape[1])), raw[at])
                    at = at[np.lexsort((smallest[at], -s))[:k]]
                    s = cosine(np.broadcast_to(raw_q[lo + j], (len(at), raw.shape[1])), raw[at])
                    pairs = sorted((-v, i) for v, a in zip(s.tolist(), at) for i in ids[a])[:k]
                    out_q += [q_ids[lo + j]] * len(pairs)
                    out_id += [i for _, i in pairs]
                    out_s += [-v for v, _ in pairs]
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_s, pa.float64())],
                        ["query", "vec_id", "score"])
    return run


def _search(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Blocks of cells: every part of a cell's vectors meets every part of its queries."""
    cell = ["table", "size", "cell"]
    parts = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    cells = (index.groupBy(*cell).agg(F.count("*").alias("n")).join(probes.groupBy(*cell).agg(F.count("*").alias("m")), cell)
             .select(*cell, parts("n").alias("n_parts"), parts("m").alias("m_parts")))
    x = index.join(cells, cell).select(
        *cell, "vector", "ids", F.pmod(F.xxhash64("vector"), F.col("n_parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("m_parts") - 1)).alias("turn"))
    q = probes.join(cells, cell).select(
        *cell, "query", "vector", "r", "lim", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("query"), F.col("m_parts")).cast("int").alias("turn"))
    block = [*cell, "part", "turn"]
    found = x.groupBy(*block).cogroup(q.groupBy(*block)).applyInArrow(_search_block(k), FOUND)
    merged = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each row that ``is_query`` selects."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"),
                          is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = cut(rows)
    ask = k + 1  # its own id may be among them
    first = Window.partitionBy("vector").orderBy("vec_id")
    entries = cut(rows.select("vector", "vec_id").distinct().withColumn("place", F.row_number().over(first))
                  .where(F.col("place") <= ask).groupBy("vector")
                  .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = entries.count()
    sampled = entries.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector").toArrow()["vector"].to_pylist()
    sample = {n: _unit(np.array([v for v in sampled if len(v) == n], float)) for n in {len(v) for v in sampled}}
    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = cut(queries.groupBy("vector").agg(F.min("query_id").alias("query")).select("query", "vector"))
    # cells of about BLOCK vectors, whatever the number of vectors
    leading = min(HASHES, max(0, math.ceil(math.log(max(total, 1) / BLOCK) / math.log(3.3))))
    goal = 1 - (1 - REACH) ** (1 / TABLES)
    index = cut(entries.mapInArrow(_index_rows(leading), f"table int, size int, cell bigint, {_kinds(entries)}"))
    schema = f"table int, size int, cell bigint, {_kinds(asked)}, r double, lim double"
    probes = asked.mapInArrow(_probe_rows(leading, sample, max(total, 1), k, goal), schema)
    found = cut(_search(index, probes, ask))
    enough = found.groupBy("query").count().where(F.col("count") >= min(ask, total))
    rest = cut(asked.join(enough, "query", "left_anti"))
    if not rest.isEmpty():
        every = rest.mapInArrow(_probe_rows(leading, sample, max(total, 1), k, 1.0), schema)
        found = reduce(DataFrame.union, [found.join(rest, "query", "left_anti"), _search(index, every, ask)])
    answers = queries.join(asked.select("vector", "query"), "vector").drop("vector").join(found, "query")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (answers.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
