"""Exact top-k search by inner product as a Voronoi join.

Points fall into the cells of pivots; small per-cell summaries deal cells to blocks of points and queries to groups of the
same block. A group first meets its own block, which gives each query a score that its k-th best cannot be below. By it, a
query needs a point x of the cell of pivot p only if q.p + |q||x - p| reaches that score, that is if x is at least a
certain distance from p; the least of these distances over a group, for each cell, is the group's bound. A point is sent
only to groups whose bound it reaches, and a query only to blocks with a cell whose radius reaches its own; each task
solves one block against one group, and the blocks' best are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.runtime import Stored

PIVOTS = 64
PIVOT_SAMPLE = 2048
QUERIES_PER_GROUP = 2048
POINTS_PER_BLOCK = 16_384
LEAST_BLOCKS = 32

_SUMMARY = "dim int, cell int, n long, radius double, n_queries long"
_SENT = pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("id", pa.int64()), ("vec", pa.list_(pa.int64())), ("floor_score", pa.float64())])
_SENT_FIELDS = "grp long, block int, id long, vec array<long>, floor_score double"
_BEST = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: What the first meeting gives: best rows, queries with their floors, and a row of bounds for the group.
_MET = pa.schema([("kind", pa.int32()), *_BEST, ("grp", pa.int64()), ("vec", pa.list_(pa.int64())), ("floor_score", pa.float64()), ("bounds", pa.list_(pa.float64()))])
_MET_FIELDS = "kind int, query_id long, query_key long, vec_id long, score long, grp long, vec array<long>, floor_score double, bounds array<double>"
_IS_BEST, _IS_QUERY, _IS_GROUP = range(3)
#: Components of this size and more have no products within 64 bits.
_LARGEST = float(2**62)
_PARTS = 1 << 32
_HASH = np.uint64(0x9E3779B97F4A7C15)


def integer_vectors(table: DataFrame, is_query, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, is_query and floor(scale * x) as array<long>. Null ids and vectors, and vectors with a null or non-finite component
    or one of 2**62 and more once scaled, take no part."""
    scaled = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    fits = F.forall(F.col(vec_col), lambda x: x.isNotNull() & (F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(_LARGEST)))
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fits
    return table.filter(usable).select(F.col(id_col).cast("long").alias("id"), scaled.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    vec = batch.column("vec")
    lengths = np.diff(vec.offsets.to_numpy())
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    starts = vec.offsets.to_numpy()[:-1] - vec.offsets.to_numpy()[0]
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)[None, :]].astype(np.float64)


class _Cells:
    """Pivots by vector length; a length without pivots has one cell around zero."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots

    def of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.of(x.shape[1])
        cell = np.argmin((p * p).sum(1)[None, :] - 2 * x @ p.T, axis=1)
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(1))


def choose_pivots(sample: list[list[int]], pivots: int, seed: int) -> _Cells:
    """A few rounds of Lloyd's algorithm on the distinct vectors of a bounded sample. Any pivots give exact results."""
    out, rng = {}, np.random.default_rng(seed)
    for dim in {len(v) for v in sample}:
        x = np.unique(np.array([v for v in sample if len(v) == dim], dtype=np.float64).reshape(-1, dim), axis=0)
        p = x[rng.permutation(len(x))[: max(1, min(pivots, len(x) // 4))]]
        for _ in range(5):
            cell = np.argmin((p * p).sum(1)[None, :] - 2 * x @ p.T, axis=1)
            p = np.array([x[cell == c].mean(0) if (cell == c).any() else p[c] for c in range(len(p))]).reshape(-1, dim)
        out[dim] = p
    return _Cells(out)


def _summarise(cells: _Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], list] = {}
        for batch in batches:
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            for rows, x in _by_dimension(batch):
                cell, dist = cells.assign(x)
                for c in np.unique(cell):
                    own = cell == c
                    s = state.setdefault((x.shape[1], int(c)), [0, 0.0, 0])
                    s[0] += int(own.sum())
                    s[1] = max(s[1], float(dist[own].max()))
                    s[2] += int((own & is_query[rows]).sum())
        rows = [(d, c, *s) for (d, c), s in state.items()]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["dim", "cell", "n", "radius", "n_queries"])

    return run


def _spread(ids: np.ndarray, shift: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * _HASH) >> np.uint64(shift)).astype(np.int64)


class _Plan:
    """How cells fall into blocks: small cells share one, large ones have several. Blocks are numbered over all lengths."""

    def __init__(self, cells: _Cells, summaries: list, queries_per_group: int, points_per_block: int, least_blocks: int):
        self.cells, self.by_dim, self.sizes = cells, {}, {}
        self.n_blocks = 0
        for dim in sorted({s["dim"] for s in summaries}):
            own = sorted((s for s in summaries if s["dim"] == dim), key=lambda s: s["cell"])
            room = min(points_per_block, max(256, -(-sum(s["n"] for s in own) // least_blocks)))
            count, first, several, radius = len(cells.of(dim)), {}, {}, {}
            filled, n_queries = room, {}
            for s in own:
                several[s["cell"]] = parts = -(-s["n"] // room)
                if parts > 1 or filled + s["n"] > room:
                    first[s["cell"]], filled = self.n_blocks, s["n"] if parts == 1 else room
                    self.n_blocks += parts
                else:
                    first[s["cell"]], filled = self.n_blocks - 1, filled + s["n"]
                radius[s["cell"]] = s["radius"]
                for b in range(first[s["cell"]], first[s["cell"]] + parts):
                    n_queries[b] = n_queries.get(b, 0) + s["n_queries"] / parts
            groups = {b: max(1, int(-(-n // queries_per_group))) for b, n in n_queries.items()}
            table = lambda known, default, t: np.array([known.get(c, default) for c in range(count)], dtype=t)
            self.by_dim[dim] = (table(first, 0, int), table(several, 1, int), table(radius, -1.0, float), groups)
            self.sizes[dim] = table({s["cell"]: s["n"] for s in own}, 0, int)

    def blocks_of(self, dim: int, cell: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Blocks of rows with these numbers: the rows of a large cell take turns."""
        first, several, _, _ = self.by_dim[dim]
        return first[cell] + numbers % several[cell]


def _place(plan: _Plan):
    """Rows with their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            block = np.zeros(batch.num_rows, dtype=np.int32)
            for rows, x in _by_dimension(batch):
                block[rows] = plan.blocks_of(x.shape[1], plan.cells.assign(x)[0], seen + rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=[*batch.schema.names, "block"])

    return run


def _bounds(q: np.ndarray, floors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each query and cell the distance from the pivot below which no point matters."""
    norm = np.sqrt((q * q).sum(1))
    gap = floors[:, None] - 1e-6 * (1 + np.abs(floors[:, None])) - q @ pivots.T
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(norm[:, None] > 0, gap / norm[:, None], np.where(gap > 0, np.inf, -np.inf))
    return np.where(np.isneginf(floors)[:, None], -np.inf, least * (1 - 1e-9 * np.sign(least)) - 1e-6)


def _joined_groups(plan: _Plan, dim: int, groups: list, room: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Groups (grp, score: its queries, bounds) to fewer that share what is sent: the joint groups, their bounds, and the joint
    group of each. A group joins the one before it if both fit into ``room`` queries and a quarter of the points that they
    may need is the same."""
    radius, sizes = plan.by_dim[dim][2], plan.sizes[dim]

    def may_need(bounds: np.ndarray) -> int:
        return int(sizes[radius >= bounds].sum())

    joint, rows, filled, of = [], [], 0, {}
    for g in groups:
        bounds = np.array(g["bounds"])
        both = np.minimum(rows[-1], bounds) if rows else bounds
        if rows and filled + g["score"] <= room and 4 * may_need(both) <= 3 * (may_need(rows[-1]) + may_need(bounds)):
            rows[-1], filled = both, filled + g["score"]
        else:
            joint.append(g["grp"])
            rows.append(bounds)
            filled = g["score"]
        of[g["grp"]] = joint[-1]
    return np.array(joint), np.array(rows), of


def _meet_points(plan: _Plan):
    """Each point to all groups of its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for rows, x in _by_dimension(batch):
                groups, block = plan.by_dim[x.shape[1]][3], blocks[rows].astype(np.int64)
                for part in range(max(groups.values())):
                    asked = np.array([part < groups[b] for b in block.tolist()], dtype=bool)
                    yield _sent(batch, block[asked] * _PARTS + part, block[asked], rows[asked], np.zeros(asked.sum()))

    return run


def _meet_queries(plan: _Plan):
    """Each query to its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blocks = batch.column("id").to_numpy(), batch.column("block").to_numpy()
            for rows, x in _by_dimension(batch):
                groups, block = plan.by_dim[x.shape[1]][3], blocks[rows].astype(np.int64)
                part = _spread(ids[rows] ^ _row_keys(x), 20) % np.array([groups[b] for b in block.tolist()], dtype=np.int64)
                yield _sent(batch, block * _PARTS + part, block, rows, np.full(len(rows), -np.inf))

    return run


def _send_points(plan: _Plan, bounds: dict[int, tuple[np.ndarray, np.ndarray, dict[int, int]]]):
    """Each point to the joint groups whose bounds it reaches, but not to one that its own block has met alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {dim: np.argsort(rows, axis=0, kind="stable") for dim, (_, rows, _) in bounds.items()}
        lone = {dim: {g for g in groups.tolist() if sum(j == g for j in of.values()) == 1} for dim, (groups, _, of) in bounds.items()}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for rows, x in _by_dimension(batch):
                if x.shape[1] not in bounds:
                    continue
                groups, least, _ = bounds[x.shape[1]]
                cell, dist = plan.cells.assign(x)
                block = blocks[rows].astype(np.int64)
                for c in np.unique(cell):
                    own, near_first = np.flatnonzero(cell == c), order[x.shape[1]][:, c]
                    reached = np.searchsorted(least[near_first, c], dist[own], "right")
                    for i in range(reached.max(initial=0)):
                        g = int(groups[near_first[i]])
                        met = block[own] == g // _PARTS if g in lone[x.shape[1]] else False
                        take = own[(reached > i) & ~np.broadcast_to(met, len(own))]
                        if len(take):
                            yield _sent(batch, np.full(len(take), g), block[take], rows[take], np.zeros(len(take)))

    return run


def _send_queries(plan: _Plan, bounds: dict[int, tuple[np.ndarray, np.ndarray, dict[int, int]]]):
    """Each query, with its floor, to the other blocks with a cell whose radius reaches its bound, as one of its joint group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, floors = batch.column("grp").to_numpy(), batch.column("floor_score").to_numpy()
            for rows, q in _by_dimension(batch):
                first, several, radius, groups = plan.by_dim[q.shape[1]]
                joint = np.array([bounds[q.shape[1]][2][g] for g in grp[rows].tolist()])
                wanted = _bounds(q, floors[rows], plan.cells.of(q.shape[1])) <= radius[None, :]
                for b in groups:
                    inside = (first <= b) & (b < first + several) & (radius >= 0)
                    asking = wanted[:, inside].any(axis=1) & (grp[rows] // _PARTS != b)
                    if asking.any():
                        yield _sent(batch, joint[asking], np.full(asking.sum(), b), rows[asking], floors[rows[asking]])

    return run


def _sent(batch: pa.RecordBatch, group: np.ndarray, block: np.ndarray, rows: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
    take = pa.array(rows.astype(np.int64))
    ids = batch.column("id" if "id" in batch.schema.names else "query_id")
    return pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), pa.array(block.astype(np.int32)), ids.take(take), batch.column("vec").take(take), pa.array(floor.astype(np.float64))], schema=_SENT)


def _matrix(table: pa.Table) -> np.ndarray:
    vec = table.column("vec").combine_chunks()
    vec = vec if isinstance(vec, pa.ListArray) else vec.chunk(0)
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _best(k: int, points: pa.Table, q: np.ndarray, qid: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and the ids and scores of its best points, at most k, that reach its floor."""
    x, xid = _matrix(points), points.column("id").to_numpy()
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    most = (np.abs(q.astype(np.float64)).sum(1).max() if q.size else 0.0) * (np.abs(x.astype(np.float64)).max() if x.size else 0.0)
    if most >= 2**63:
        raise OverflowError("inner products pass 64 bits")
    if most < 2**53:
        q, x = q.astype(np.float64), x.astype(np.float64)
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ x.T
        for r in range(len(s)):
            i = lo + r
            may = np.flatnonzero((xid != qid[i]) & (s[r] >= floors[i]))
            if len(may) > k:
                cut = np.partition(s[r][may], len(may) - k)[len(may) - k]
                may = may[s[r][may] >= cut]
                may = may[np.argsort(-s[r][may], kind="stable")][:k]  # points are in order of id
            yield i, xid[may], s[r][may].astype(np.int64)


def _asking(queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, ids, keys and floors of the distinct queries."""
    q, qid, floors = _matrix(queries), queries.column("id").to_numpy(), queries.column("floor_score").to_numpy()
    key = _row_keys(q)
    _, first = np.unique(np.stack([qid, key]), axis=1, return_index=True)  # a repeated query row asks once
    return q[first], qid[first], key[first], floors[first]


def _by_length(table: pa.Table) -> Iterator[pa.Table]:
    lengths = pc.list_value_length(table.column("vec"))
    for n in pc.unique(lengths).to_pylist():
        yield table.filter(pc.equal(lengths, n))


def _meet(plan: _Plan, k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = [_MET.empty_table()]
        for asking in _by_length(queries):
            q, qid, key, floors = _asking(asking)
            grp = asking.column("grp")[0].as_py()
            own = points.filter(pc.equal(pc.list_value_length(points.column("vec")), q.shape[1]))
            best = []
            for i, ids, scores in _best(k, own, q, qid, floors):
                best.append((np.full(len(ids), qid[i]), np.full(len(ids), key[i]), ids, scores))
                if len(ids) == k and k:
                    floors[i] = scores.min()
            columns = [np.concatenate(c) for c in zip(*best)]
            out.append(_met(_IS_BEST, len(columns[0]), **dict(zip(_BEST.names, columns))))
            out.append(_met(_IS_QUERY, len(q), query_id=qid, query_key=key, grp=np.full(len(q), grp), vec=list(q), floor_score=floors))
            bounds = _bounds(q.astype(np.float64), floors, plan.cells.of(q.shape[1])).min(axis=0)
            out.append(_met(_IS_GROUP, 1, grp=[grp], vec_id=[q.shape[1]], score=[len(q)], bounds=[bounds]))
        return pa.concat_tables(out)

    return run


def _met(kind: int, n: int, **columns) -> pa.Table:
    known = {"kind": np.full(n, kind)} | columns
    return pa.Table.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(n, f.type) for f in _MET], schema=_MET)


def _solve(k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        for asking in _by_length(queries) if points.num_rows else ():
            q, qid, key, floors = _asking(asking)
            own = points.filter(pc.equal(pc.list_value_length(points.column("vec")), q.shape[1]))
            out += [(np.full(len(ids), qid[i]), np.full(len(ids), key[i]), ids, scores) for i, ids, scores in _best(k, own, q, qid, floors)]
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_BEST) if out else _BEST.empty_table()

    return run


def _row_keys(q: np.ndarray) -> np.ndarray:
    """A hash of each vector, equal for equal vectors, to tell queries that share an id apart."""
    h = np.zeros(len(q), dtype=np.uint64)
    for column in q.astype(np.int64).T:
        h = (h ^ column.astype(np.uint64)) * _HASH
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def _routed(table: DataFrame, is_query, k: int, id_col: str, vec_col: str, scale: float, pivots: int, pivot_sample: int, queries_per_group: int, points_per_block: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What groups find in their own blocks, and the points and queries that are sent on."""
    vectors = integer_vectors(table, is_query, id_col, vec_col, scale)
    sample = [r["vec"] for r in vectors.orderBy(F.xxhash64("id", "vec"), "id").select("vec").limit(pivot_sample).collect()]
    cells = choose_pivots(sample, pivots, seed)
    parts = vectors.mapInArrow(_summarise(cells), _SUMMARY).groupBy("dim", "cell")
    summaries = parts.agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("n_queries").alias("n_queries")).collect()  # a row for each pivot
    plan = _Plan(cells, summaries, queries_per_group, points_per_block, LEAST_BLOCKS)
    stored = Stored(table.sparkSession)
    placed = stored.write(vectors.mapInArrow(_place(plan), "id long, vec array<long>, is_query boolean, block int"), "knn-points")
    queries = placed.filter("is_query").groupBy("id", "vec").agg(F.min("block").alias("block")).mapInArrow(_meet_queries(plan), _SENT_FIELDS).groupBy("grp")
    own = placed.select("id", "vec", "block").mapInArrow(_meet_points(plan), _SENT_FIELDS).groupBy("grp")
    met = stored.write(own.cogroup(queries).applyInArrow(_meet(plan, k), _MET_FIELDS), "knn-met")
    groups = met.filter(F.col("kind") == _IS_GROUP).select("grp", "vec_id", "score", "bounds").orderBy("grp").collect()  # a row for each group of queries
    bounds = {}
    for dim in sorted({g["vec_id"] for g in groups}):
        bounds[dim] = _joined_groups(plan, dim, [g for g in groups if g["vec_id"] == dim], queries_per_group)
    points = placed.select("id", "vec", "block").mapInArrow(_send_points(plan, bounds), _SENT_FIELDS)
    asking = met.filter(F.col("kind") == _IS_QUERY).select("query_id", "grp", "vec", "floor_score").mapInArrow(_send_queries(plan, bounds), _SENT_FIELDS)
    return met.filter(F.col("kind") == _IS_BEST).select(*_BEST.names), points, asking


def voronoi_top_k(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, pivots: int = PIVOTS, pivot_sample: int = PIVOT_SAMPLE, queries_per_group: int = QUERIES_PER_GROUP, points_per_block: int = POINTS_PER_BLOCK, seed: int = 7) -> DataFrame:
    """The k largest integer inner products of each query row against all other rows: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; all rows if fewer than k. Rows that ``integer_vectors`` leaves out take no part; a
    candidate must have the query's number of components. A repeated candidate row counts each time; a repeated query row
    asks once; query rows with one id and other vectors each get their own ranks. An empty table gives an empty result.
    Products that may pass 64 bits are an error. ``pivot_sample`` bounds the rows that pick pivots; it doesn't affect
    results. The driver holds a number for each pivot and group of ``queries_per_group`` queries.
    """
    met, points, queries = _routed(table, is_query, k, id_col, vec_col, scale, pivots, pivot_sample, queries_per_group, points_per_block, seed)
    best = points.groupBy("grp", "block").cogroup(queries.groupBy("grp", "block")).applyInArrow(_solve(k), "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return met.unionByName(best).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sent_shares(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, pivots: int = PIVOTS, pivot_sample: int = PIVOT_SAMPLE, queries_per_group: int = QUERIES_PER_GROUP, points_per_block: int = POINTS_PER_BLOCK, seed: int = 7) -> tuple[float, float]:
    """Of all pairs of point and group, and of query and block, the shares that ``voronoi_top_k`` sends after the first meeting."""
    met, points, queries = _routed(table, is_query, k, id_col, vec_col, scale, pivots, pivot_sample, queries_per_group, points_per_block, seed)
    vectors = integer_vectors(table, is_query, id_col, vec_col, scale)
    n, asked = vectors.count(), vectors.filter("is_query").select("id", "vec").distinct().count()
    groups, blocks = queries.select("grp").distinct().count(), points.select("block").distinct().count()
    return points.count() / max(1, n * groups), queries.count() / max(1, asked * blocks)
