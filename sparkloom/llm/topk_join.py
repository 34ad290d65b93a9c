"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are lifted by one component, which brings all rows to one length M and is 0 for queries. Then

    |q - x|^2 = |q|^2 + M^2 - 2 q.x

so the rows of highest inner product are the nearest ones, and the triangle inequality holds. Rows and queries belong to
the Voronoi cell of their nearest pivot; summaries have each cell's number of rows and least and largest distance to its
pivot, and each query group's number and largest distance.

1. Each group of queries is solved in the nearest cells that have enough rows. This gives k candidates and, with the
   k-th one's distance, a true bound of every query and of its group.
2. A cell is left out for a whole group if the distance of the two pivots and the summaries show that no row of it comes
   within the group's bound; for a query, if its own distance to the cell's pivot, or to the hyperplane between the
   pivots, shows it. Queries, which are the fewer, are replicated to the other cells alone and solved there.

M is twice the greatest length in a bounded sample. Rows that are longer have a cell of their own, FAR, which every query
visits, and queries beyond FAR_SQUARE visit all cells; bounds need neither, so a few huge vectors change nothing for the rest.

Cells are cut into blocks of bounded size and so are the queries of a cell, so that no task holds a whole cell. Pivots
come from a bounded sample and grow with the root of the rows, to PIVOTS, which bounds what is sent to tasks.

Components are scaled and floored to integers, and products are exact whatever their size; a score beyond 64 bits is given
as the least or greatest number of 64 bits. Vectors that are null or hold a null or non-finite component, and rows without
an id, take no part. Vectors of different lengths aren't compared; lengths that the sample misses have one cell each, cut
into blocks as all others. Ties go to the smaller id. A query never finds rows of its own id; if several rows have a query's id, the query has the least
vector of them, by bytes. Several candidate rows with one id are candidates each. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import drop, written
from sparkloom.operators.ranking import sent as sent_small

K = 5
#: Pivots at most, and rows of the sample for each pivot.
PIVOTS, PER_PIVOT = 1024, 8
#: Rows and queries of a block.
BLOCK, QUERIES = 16_384, 4096
_LONG = (-(2**63), 2**63 - 1)
#: The cell of rows outside the space, and the squared length from which a vector is outside any: below, scores fit 64 bits.
FAR, FAR_SQUARE = -1, 2.0**62


def pack(x: np.ndarray) -> list[bytes]:
    """Integer vectors, in as few bytes for each component as its vector needs."""
    most = np.abs(x).max(1, initial=0)
    return [r.astype("<i2" if m < 2**15 else "<i4" if m < 2**31 else "<f8").tobytes() for r, m in zip(x, most, strict=True)]


def unpack(vectors: list[bytes], dim: int) -> np.ndarray:
    kinds = {2 * dim: "<i2", 4 * dim: "<i4", 8 * dim: "<f8"}
    return np.array([np.frombuffer(v, kinds[len(v)]) for v in vectors], np.float64).reshape(len(vectors), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exactly: as floating numbers for the rows of a for which these are exact, as
    Python's integers for the others."""
    most = np.abs(a).max(1, initial=0) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    small = most < 2**53
    if small.all():
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    out = np.empty((len(a), len(b)), object)
    out[small] = (a[small] @ b.T).astype(np.int64)
    out[~small] = whole(a[~small]) @ whole(b).T
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores of a row, ties to the smaller id."""
    if len(scores) > k:
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= border)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


@dataclass
class Space:
    """The lifted space of vectors of one length."""

    most: float  # the square of M
    pivots: np.ndarray

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        high = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))
        return np.concatenate([x, high[:, None]], 1)

    def distances(self, y: np.ndarray) -> np.ndarray:
        """Of lifted vectors to the pivots."""
        c = self.pivots
        return np.sqrt(np.maximum((y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)[None, :], 0))

    @property
    def slack(self) -> float:
        """More than distances are off by rounding."""
        return 1e-6 * np.sqrt(self.most) + 1e-9


def spread(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres of a sample, by a few rounds of k-means."""
    c = np.unique(x[:: max(1, len(x) // n)][:n], axis=0)
    for _ in range(rounds):
        home = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        n_home = np.bincount(home, minlength=len(c))
        c = np.where(n_home[:, None] > 0, sums / np.maximum(n_home, 1)[:, None], c)
    return c


def squares(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * x).sum(1)


def _spaces(rows: DataFrame, scale: int, pivots: int) -> dict[int, Space]:
    """Spaces of the lengths that a bounded sample has."""
    n = rows.count()
    wanted = max(1, min(pivots, int(n**0.5)))
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(PER_PIVOT * wanted).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append(r.v)
    out = {}
    for dim, vectors in by_dim.items():
        x = np.floor(np.array(vectors, np.float64).reshape(len(vectors), dim) * scale)
        near = squares(x) < FAR_SQUARE
        most = min(4 * float(squares(x[near]).max(initial=0)), FAR_SQUARE)
        if dim and most:
            space = Space(most, np.zeros((1, dim + 1)))
            space.pivots = spread(space.lift(x[near]), max(1, wanted * len(vectors) // len(sample)))
            out[dim] = space
    return out


def _vectors(batch: pa.RecordBatch, column: str, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and scaled vectors of a batch's rows, by length."""
    vs = batch.column(column)
    sizes = np.diff(vs.offsets.to_numpy())
    flat, lines = vs.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(vs)), sizes)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, np.floor(flat[np.isin(lines, at)] * scale).reshape(len(at), dim)


def _solved(blocks: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the k best rows of each block for each query that was sent there."""

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            dim, ids = int(left["dim"].iloc[0]), left["id"].to_numpy()
            x = unpack(left["v"].tolist(), dim)
            for lo in range(0, len(right), 512):
                part = right.iloc[lo : lo + 512]
                scores = products(unpack(part["qv"].tolist(), dim), x)
                for q, line in zip(part["qid"], scores, strict=True):
                    own = ids != q
                    got = best(line[own], ids[own], k)
                    out["query_id"] += [q] * len(got)
                    out["vec_id"] += ids[own][got].tolist()
                    out["score"] += [min(max(int(v), _LONG[0]), _LONG[1]) for v in line[own][got]]
        return pd.DataFrame(out).astype("int64")

    keys = ["dim", "cell", "salt", "part"]
    return blocks.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")


def topk(
    table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = K, scale: int = 256,
    pivots: int = PIVOTS, block: int = BLOCK, seen: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows; queries are the ids divisible by `every`.

    seen, where given, gets the numbers of queries' visits to cells, of pairs of queries and cells, and of blocks solved.
    """
    spark = table.sparkSession
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = table.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    shared = spark.sparkContext.broadcast(_spaces(rows, scale, pivots))  # PIVOTS vectors at most
    spaces = shared.value

    def assign(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for dim, at, x in _vectors(batch, "v", scale):
                home, gap = np.zeros(len(at), np.int64), np.zeros(len(at))
                if space := shared.value.get(dim):
                    near = squares(x) <= space.most
                    y = space.lift(x[near])
                    home[:] = FAR
                    home[near] = space.distances(y).argmin(1)
                    gap[near] = np.sqrt(((y - space.pivots[home[near]]) ** 2).sum(1))
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids[at], pa.int64()), "dim": pa.array([dim] * len(at), pa.int32()), "cell": pa.array(home, pa.int32()),
                    "gap": pa.array(gap, pa.float64()), "v": pa.array(pack(x), pa.binary()),
                })

    data = written(rows.mapInArrow(assign, "id long, dim int, cell int, gap double, v binary"))

    def group(batches):
        """Queries with the cell of their nearest pivot."""
        for batch in batches:
            part = batch.to_pandas()
            for dim, own in part.groupby("dim"):
                home, gap = np.zeros(len(own), np.int64), np.zeros(len(own))
                if space := shared.value.get(dim):
                    x = unpack(own["qv"].tolist(), dim)
                    near = squares(x) < FAR_SQUARE
                    d = space.distances(space.lift(x[near], True))
                    home[:] = FAR
                    home[near], gap[near] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_pandas(own.assign(home=home.astype("int32"), gap=gap), preserve_index=False)

    queries = data.where(F.col("id") % every == 0).groupBy(F.col("id").alias("qid"), "dim").agg(F.count(F.lit(1)).alias("copies"), F.min("v").alias("qv"))
    asked = written(queries.mapInArrow(group, "qid long, dim int, copies long, qv binary, home int, gap double"))

    # summaries: a row for each cell, and for each group of queries
    known = F.col("dim").isin(list(spaces))
    cells: dict[int, dict[int, tuple]] = {dim: {} for dim in spaces}
    for r in data.where(known).groupBy("dim", "cell").agg(F.count(F.lit(1)), F.min("gap"), F.max("gap")).collect():
        cells[r[0]][r[1]] = tuple(r[2:])
    groups = {(r[0], r[1]): tuple(r[2:]) for r in asked.where(known).groupBy("dim", "home").agg(F.count(F.lit(1)), F.max("gap"), F.max("copies")).collect()}
    first: dict[tuple[int, int], list[int]] = {}
    for (dim, g), (_, _, copies) in groups.items():
        if g == FAR:
            first[dim, g] = list(cells[dim])
            continue
        c = spaces[dim].pivots
        near = sorted((j for j in cells[dim] if j != FAR), key=lambda j, c=c, g=g: float(((c[j] - c[g]) ** 2).sum()))
        have = np.cumsum([cells[dim][j][0] for j in near])
        first[dim, g] = near[: int(np.searchsorted(have, k + copies)) + 1] + [FAR] * (FAR in cells[dim])

    def blocks_for(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks of the cells that queries were sent to, for each part of the queries; and the queries by block and part."""
        sent = {(r[0], r[1]): r[2] for r in routed.where(known).groupBy("dim", "cell").count().collect()}
        shape = [(dim, j, -(-n // block), -(-sent[dim, j] // QUERIES)) for dim, of in cells.items() for j, (n, *_) in of.items() if (dim, j) in sent]
        sizes = F.broadcast(spark.createDataFrame(shape, "dim int, cell int, salts int, parts int"))  # a row for each pivot
        count = lambda df, size: df.where(~known).groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        other = count(data, block).withColumnRenamed("n", "salts").join(count(routed, QUERIES).withColumnRenamed("n", "parts"), ["dim", "cell"])
        other = sent_small(other)  # a row for each length that the sample misses
        several = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = lambda df: df.where(known).join(sizes, ["dim", "cell"]).unionByName(df.where(~known).join(other, ["dim", "cell"]))
        left = one(data).select("dim", "cell", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), several("parts").alias("part"), "id", "v")
        right = one(routed).select("dim", "cell", several("salts").alias("salt"), F.pmod(F.xxhash64("qid"), "parts").cast("int").alias("part"), "qid", "qv")
        if seen is not None:
            seen["blocks"] = seen.get("blocks", 0) + left.select("dim", "cell", "salt", "part").distinct().count()
        return left, right

    sends = [(dim, g, j) for (dim, g), near in first.items() for j in near]
    ways = F.broadcast(spark.createDataFrame(sends, "dim int, home int, cell int"))  # a few rows for each pivot
    near = asked.join(ways, ["dim", "home"], "left").withColumn("cell", F.coalesce("cell", F.lit(0)))
    found = written(_solved(*blocks_for(near), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    held = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    border = held.groupBy(F.col("query_id").alias("qid")).agg(F.min("score").alias("border"), F.count(F.lit(1)).alias("n"))
    bounded = written(asked.where(known & (F.col("home") != FAR)).join(border.where(F.col("n") >= k).drop("n"), "qid", "left"))

    def limit(space: Space, x: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distances within which better rows lie."""
        return np.sqrt(np.maximum((x * x).sum(1) + space.most - 2 * scores, 0)) + space.slack

    def widest(batches):
        """The largest bound of a batch's queries, by group."""
        for batch in batches:
            part = batch.to_pandas()
            for dim, own in part.groupby("dim"):
                far = limit(shared.value[dim], unpack(own["qv"].tolist(), dim), own["border"].fillna(-np.inf).to_numpy())
                far = own.assign(far=far).groupby("home", as_index=False)["far"].max().assign(dim=np.int32(dim))
                yield pa.RecordBatch.from_pandas(far[["dim", "home", "far"]], preserve_index=False)

    bounds = bounded.mapInArrow(widest, "dim int, home int, far double").groupBy("dim", "home").agg(F.max("far")).collect()
    ways_of: dict[tuple[int, int], np.ndarray] = {}
    for dim, g, far in bounds:
        c = spaces[dim].pivots
        js = np.array([j for j in cells[dim] if j != FAR and j not in first[dim, g]], np.int64)
        apart = np.sqrt(((c[js] - c[g]) ** 2).sum(1))
        low, high = (np.array([cells[dim][j][i] for j in js]) for i in (1, 2))
        ways_of[dim, g] = js[np.maximum(apart - high, low - apart) <= groups[dim, g][1] + far + spaces[dim].slack]
    sent_ways = spark.sparkContext.broadcast((ways_of, cells))

    def route(batches):
        """The cells that a query's own bound doesn't leave out."""
        ways_of, cells = sent_ways.value
        for batch in batches:
            for (dim, g), own in batch.to_pandas().groupby(["dim", "home"]):
                space, js = shared.value[dim], ways_of[dim, g]
                x = unpack(own["qv"].tolist(), dim)
                far = limit(space, x, own["border"].fillna(-np.inf).to_numpy())
                d = space.distances(space.lift(x, True))
                low, high = (np.array([cells[dim][j][i] for j in js.tolist()]) for i in (1, 2))
                apart = np.maximum(np.sqrt(((space.pivots[js] - space.pivots[g]) ** 2).sum(1)), 1e-12)
                least = np.maximum(d[:, js] - high, low - d[:, js])
                least = np.maximum(least, (d[:, js] ** 2 - d[:, [g]] ** 2) / (2 * apart) - space.slack)
                line, column = np.nonzero(least <= far[:, None])
                picked = own.iloc[line]
                yield pa.RecordBatch.from_pydict({
                    "qid": pa.array(picked["qid"]), "dim": pa.array([dim] * len(line), pa.int32()), "cell": pa.array(js[column], pa.int32()), "qv": pa.array(picked["qv"], pa.binary()),
                })

    routed = written(bounded.mapInArrow(route, "qid long, dim int, cell int, qv binary"))
    if seen is not None:
        n_asked, n_cells = asked.count(), sum(map(len, cells.values()))
        seen |= {"visits": routed.count() + near.count(), "pairs": n_asked * n_cells}
    more = written(_solved(*blocks_for(routed), k))
    drop(data, asked, bounded, routed)
    both = found.unionByName(more)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
