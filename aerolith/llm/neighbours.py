"""The most similar vectors for every vector: multiprobe p-stable hashing with exact reranking.

Each of ``tables`` hash tables cuts space by ``functions`` Gaussian (2-stable) projections into
cells of width w. A vector is stored in its own cell of each table and looks for neighbours in that
cell and in the ``probes`` next ones, in the order of estimated success: the perturbations of its
cell whose borders it lies closest to, by the sum of squared distances to those borders. In each
cell all candidates' distances come from one matrix product per block; the nearest few are measured
exactly, and the lists of all cells and tables merge to the k nearest.

The width is fitted, not set: the largest of a ladder for which the cell of a random vector is
expected to hold at most ``load`` vectors, measured on at most FIT_ROWS vectors. One width cannot
suit all densities, so the search goes in rounds. A vector is done once it has k neighbours and the
k-th lies within CERTAIN widths, where hardly any nearer one can have missed all visited cells. The
others, which lie in thinner regions, ask again in cells that are at least twice as wide, fitted to
the vectors that still ask; the last width that can be needed puts all vectors in one cell. So every
vector gets its k neighbours, whatever the density around it.

Vectors travel once per table and group of cells, not once per cell: a group is all cells that agree
in the first few functions, as many as keep it at GROUP vectors, and most probes stay in the group.
Every vector is indexed and every vector is a query. Groups that still hold more than BLOCK vectors
are cut into blocks that each query of the group visits, so nothing is capped or dropped.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.arrowgroups import flat, lists, runs
from aerolith.runtime import HOT_SHARE, salted_join, written

TABLES = 3
FUNCTIONS = 4
PROBES = 4
#: Expected number of vectors in the cell of a random vector that asks.
LOAD = 800
#: Those who ask again may meet so many times as many.
AGAIN = 4
#: A neighbour within so many widths has hardly been missed.
CERTAIN = 0.35
#: Expected number of vectors in a group of cells.
GROUP = 8192
#: Vectors on which the cell width is fitted: the first by a hash of their ids.
FIT_ROWS = 4000
#: Vectors of a group that one task holds at a time.
BLOCK = 16_384
#: Queries in one matrix product.
CHUNK = 1024
#: So many crowded groups at most travel in the plan; more are joined.
LISTED = 20_000
#: So many ids of vectors that ask again may be broadcast.
FEW = 200_000


class Hashing:
    """The projections of all tables, and the cells, groups and probes of vectors.

    ``shared``: the functions that the cells of a group agree in. A width of None makes one cell of all.
    """

    def __init__(self, dims: int, width: float | None, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, shared: int | None = None, seed: int = 20250303) -> None:
        if width is None:
            tables, functions, probes = 1, 1, 0
        rng = np.random.default_rng(seed)
        self.tables, self.functions, self.probes, self.width = tables, functions, probes, width
        self.shared = functions if shared is None else shared
        self.axes = rng.standard_normal((dims, tables * functions))
        self.shift = rng.random(tables * functions)
        self.mix = rng.integers(1, 2**62, size=functions, dtype=np.int64) | 1
        moves = [m for m in itertools.product((-1, 0, 1), repeat=functions) if any(m)]
        self.moves = np.array(moves, dtype=np.int64).reshape(-1, functions)

    def _place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.tile(self.shift, (len(x), 1)) if self.width is None else x @ self.axes / self.width + self.shift
        cell = np.floor(at)
        return cell.astype(np.int64).reshape(len(x), self.tables, self.functions), (at - cell).reshape(len(x), self.tables, self.functions)

    def _code(self, cells: np.ndarray, functions: int) -> np.ndarray:
        """One number per cell and table (the last axis but ``functions`` is the table's); cells that share a number only gain candidates."""
        with np.errstate(over="ignore"):
            c = (cells[..., :functions] * self.mix[:functions]).sum(axis=-1)
            return (c ^ (c >> 31)) * self.tables

    def own(self, x: np.ndarray, functions: int | None = None) -> np.ndarray:
        """(rows, tables): the number of the own cell, or of the group of the first ``functions``."""
        return self._code(self._place(x)[0], self.functions if functions is None else functions) + np.arange(self.tables)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tables, 1 + probes) twice: groups and cells to visit, the own cell first, then the best perturbations of it."""
        cells, part = self._place(x)
        cost = np.zeros((len(x), self.tables, len(self.moves)))
        for f in range(self.functions):
            step = self.moves[:, f]
            cost += np.where(step == -1, part[:, :, f : f + 1] ** 2, 0.0) + np.where(step == 1, (1 - part[:, :, f : f + 1]) ** 2, 0.0)
        best = np.argsort(cost, axis=2, kind="stable")[:, :, : self.probes]
        to = np.concatenate([cells[:, :, None, :], cells[:, :, None, :] + self.moves[best]], axis=2)
        table = np.arange(self.tables)[None, :, None]
        return self._code(to, self.shared) + table, self._code(to, self.functions) + table


def _load(sample: np.ndarray, sample_ids: np.ndarray, asks: np.ndarray, ask_ids: np.ndarray, hashing: Hashing, functions: int) -> float:
    """Share of the sample that a random asking vector meets in its own cell of the first ``functions``, without itself."""
    own, mine = hashing.own(sample, functions), hashing.own(asks, functions)
    known = np.isin(ask_ids, sample_ids).sum()
    met = 0
    for t in range(hashing.tables):
        codes, counts = np.unique(own[:, t], return_counts=True)
        at = np.minimum(np.searchsorted(codes, mine[:, t]), len(codes) - 1)
        met += int(np.where(codes[at] == mine[:, t], counts[at], 0).sum()) - int(known)
    return met / (hashing.tables * max(1, len(asks) * len(sample) - int(known)))


def spread_of(sample: np.ndarray) -> float:
    """The largest distance of the sample from its mean."""
    return float(np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)).max()) if len(sample) else 0.0


def fit(sample: np.ndarray, sample_ids: np.ndarray, asks: np.ndarray, ask_ids: np.ndarray, n: int, load: float, least: float = 0.0, group: int = GROUP, **how) -> Hashing:
    """The hashing of the largest width of a ladder, not below ``least``, whose expected cell load over ``n`` vectors is at most ``load``.

    Its groups share the fewest functions that keep the expected load of a group at ``group``. Beyond
    16 times the spread of the sample one cell takes all.
    """
    dims = sample.shape[1]
    widest = 16 * spread_of(sample)
    if not widest or len(sample) < 2 or least > widest:
        return Hashing(dims, None)
    width = widest
    for _ in range(160):
        if width / 2**0.25 < least or n * _load(sample, sample_ids, asks, ask_ids, Hashing(dims, width, **how), how.get("functions", FUNCTIONS)) <= load:
            break
        width /= 2**0.25
    made = Hashing(dims, width, **how)
    while made.shared > 1 and n * _load(sample, sample_ids, asks, ask_ids, made, made.shared - 1) <= group:
        made.shared -= 1
    return made


def _top(q: np.ndarray, q_ids: np.ndarray, m: np.ndarray, m_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of ``m`` for each row of ``q`` as flat (row, id, distance): shortlist by matrix product, then exact."""
    mid = m.mean(axis=0)
    a, b = q - mid, m - mid
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = a2[:, None] + b2[None, :] - 2.0 * (a @ b.T)
    d[q_ids[:, None] == m_ids[None, :]] = np.inf
    if d.shape[1] > k:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    else:
        limit = np.full(len(d), np.finfo(float).max)
    # Rounding of the product is far below this slack, so no true neighbour falls off the shortlist.
    slack = 1e-9 * (a2 + (b2.max() if len(b2) else 0.0)) + 1e-12
    row, col = np.nonzero(d <= (np.minimum(limit, np.finfo(float).max / 2) + slack)[:, None])
    far = np.empty(len(row))
    for i in range(0, len(row), 65536):
        diff = q[row[i : i + 65536]] - m[col[i : i + 65536]]
        far[i : i + 65536] = np.sqrt((diff * diff).sum(axis=1))
    return _first(row, m_ids[col], far, k)


def _first(row: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row; ties by id."""
    order = np.lexsort((ids, far, row))
    row, ids, far = row[order], ids[order], far[order]
    start = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.empty(0, dtype=np.int64)
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    keep = place < k
    return row[keep], ids[keep], far[keep]


def _distances(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of groups, stored vectors first: per query and cell the k nearest."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    m: list[np.ndarray] = []
    m_ids: list[np.ndarray] = []
    m_code: list[np.ndarray] = []
    cells: list[np.ndarray] = []  # the codes of the group's cells and where they start, once the stored vectors are all in
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def packed() -> pa.RecordBatch:
        q = np.concatenate([o[0] for o in out])
        counts = np.concatenate([o[1] for o in out])
        ids, far = np.concatenate([o[2] for o in out]), np.concatenate([o[3] for o in out])
        offsets = np.zeros(len(counts) + 1, dtype=np.int32)
        np.cumsum(counts, out=offsets[1:])
        hit = pa.StructArray.from_arrays([pa.array(far), pa.array(ids)], names=["d", "id"])
        return pa.RecordBatch.from_arrays([pa.array(q), pa.ListArray.from_arrays(pa.array(offsets), hit)], names=["rep", "hits"])

    def search(q: np.ndarray, q_ids: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> None:
        nonlocal held
        if not m:
            return
        if not cells:
            code = np.concatenate(m_code)
            order = np.argsort(code, kind="stable")
            m[:], m_ids[:] = [np.concatenate(m)[order]], [np.concatenate(m_ids)[order]]
            names, starts = np.unique(code[order], return_index=True)
            cells[:] = [names, np.append(starts, len(order))]
        names, starts = cells
        order = np.argsort(codes, kind="stable")
        codes, rows = codes[order], rows[order]
        asked, first = np.unique(codes, return_index=True)
        last = np.append(first[1:], len(codes))
        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c in np.flatnonzero(names[at] == asked).tolist():
            lo, hi = starts[at[c]], starts[at[c] + 1]
            for i in range(first[c], last[c], CHUNK):
                who = rows[i : min(i + CHUNK, last[c])]
                row, ids, far = _top(q[who], q_ids[who], m[0][lo:hi], m_ids[0][lo:hi], k)
                near.append((who[row], ids, far))
        if not near:
            return
        # One list a query for all cells of the group.
        row, ids, far = _first(*(np.concatenate(x) for x in zip(*near)), k)
        if len(row):
            mine, counts = np.unique(row, return_counts=True)
            out.append((q_ids[mine], counts, ids, far))
            held += len(ids)

    def answer() -> None:
        for w in waiting:
            search(*w)
        waiting.clear()

    for _, rows, new in runs(batches, ["grp", "block"]):
        if new:
            answer()
            for x in (m, m_ids, m_code, cells):
                x.clear()
        x = flat(rows.column("vec")).reshape(-1, dims)
        ids = rows.column("rep").to_numpy()
        role = rows.column("role").to_numpy()
        stored = role <= 1
        if stored.any():
            m.append(x[stored])
            m_ids.append(ids[stored])
            m_code.append(rows.column("own").to_numpy()[stored])
        if (role >= 1).any():
            per = np.diff(rows.column("asks").offsets.to_numpy())
            waiting.append((x, ids, flat(rows.column("asks")), np.repeat(np.arange(len(x)), per)))
            if role[-1] > 1:  # no stored vector of the group can follow
                answer()
        if held > 200_000:
            yield packed()
            out, held = [], 0
    answer()
    if out:
        yield packed()


def cell_hits(reps: DataFrame, dims: int, hashing: Hashing, k: int, block: int = BLOCK) -> DataFrame:
    """(rep, hits): for each vector that asks and each visited cell its k nearest there. ``reps``: (rep, vec, asks)."""

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, asks = flat(b.column("vec")).reshape(-1, dims), b.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                own, counts = np.unique(hashing.own(x, hashing.shared), return_counts=True)
                to = np.unique(hashing.visits(x[asks])[0])
                codes = np.union1d(own, to)
                n = np.zeros(len(codes), dtype=np.int64)
                n[np.searchsorted(codes, own)] = counts
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n), pa.array(np.isin(codes, to))], names=["grp", "n", "asked"])

    # Groups with their sizes, with partial counts; both lists that come to the driver are bounded.
    groups = written(reps.select("vec", "asks").mapInArrow(groups_of, "grp bigint, n bigint, asked boolean").groupBy("grp").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")), "vector-groups")
    asked = groups.where("asked").select("grp").limit(LISTED + 1).collect()
    wanted = np.array(sorted(r["grp"] for r in asked), dtype=np.int64) if len(asked) <= LISTED else None
    crowded = groups.where(F.col("asked") & (F.col("n") > block)).select("grp", "n")
    listed = crowded.limit(LISTED + 1).collect()
    blocks = {r["grp"]: -(-r["n"] // block) for r in listed} if len(listed) <= LISTED else {}
    hot = np.array(sorted(blocks), dtype=np.int64)
    hot_n = np.array([blocks[c] for c in hot.tolist()], dtype=np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (grp, block, role, rep, own, asks, vec); role 0: stored only, 1: stored and asks, 2: asks only."""
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = flat(part.column("vec")).reshape(-1, dims)
                ids = part.column("rep").to_numpy()
                asking = part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                grp, code = hashing.visits(x)
                per = grp.shape[2]
                row = np.repeat(np.arange(len(x)), hashing.tables * per)
                first = np.tile(np.arange(per) == 0, len(x) * hashing.tables)
                grp, code = grp.reshape(-1), code.reshape(-1)
                kept = asking[row] | first
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, grp), max(0, len(wanted) - 1))
                    kept &= (wanted[at] == grp) if len(wanted) else False
                grp, code, row, first = grp[kept], code[kept], row[kept], first[kept]
                # Visits of one vector in one group become one row; its own cell comes first in it.
                order = np.lexsort((~first, grp, row))
                grp, code, row, first = grp[order], code[order], row[order], first[order]
                lead = np.append(True, (grp[1:] != grp[:-1]) | (row[1:] != row[:-1])) if len(grp) else np.zeros(0, dtype=bool)
                start = np.flatnonzero(lead)
                sizes = np.diff(np.append(start, len(grp)))
                grp1, row1, own1, stored = grp[start], row[start], code[start], first[start]
                n = np.ones(len(start), dtype=np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, grp1), len(hot) - 1)
                    n = np.where(hot[at] == grp1, hot_n[at], 1)
                home = np.abs(ids[row1] * 2654435761 % 4294967296) % n
                # A row per block for those that ask; those that are only stored go to their home block.
                n = np.where(asking[row1], n, 1)
                again = np.repeat(np.arange(len(start)), n)
                nth = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                nth = np.where(asking[row1[again]], nth, home[again])
                role = np.where(~asking[row1[again]], 0, np.where(stored[again] & (nth == home[again]), 1, 2))
                per_row = np.where(asking[row1[again]], sizes[again], 0)
                from_ = np.repeat(start[again], per_row) + np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
                who = row1[again]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grp1[again]), pa.array(nth.astype(np.int32)), pa.array(role.astype(np.int32)), pa.array(ids[who]), pa.array(own1[again]),
                        lists(code[from_], per_row, pa.int64()), lists(x[who].reshape(-1), np.full(len(who), dims), pa.float64()),
                    ],
                    names=["grp", "block", "role", "rep", "own", "asks", "vec"],
                )

    rows = reps.select("rep", "vec", "asks").mapInArrow(spread, "grp bigint, block int, role int, rep bigint, own bigint, asks array<bigint>, vec array<double>")
    if len(listed) > LISTED:
        per_grp = crowded.select("grp", F.ceil(F.col("n") / block).alias("__blocks"))
        rows = rows.join(per_grp, "grp", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1))).withColumn("__home", F.pmod(F.xxhash64("rep"), F.col("__blocks")))
        rows = rows.withColumn("block", F.explode(F.when(F.col("role") == 0, F.array("__home")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1))))
        rows = rows.withColumn("role", F.when((F.col("role") == 1) & (F.col("block") != F.col("__home")), 2).otherwise(F.col("role")))
        rows = rows.select("grp", F.col("block").cast("int").alias("block"), F.col("role").cast("int").alias("role"), "rep", "own", "asks", "vec")
    return (
        rows.repartition("grp", "block")
        .sortWithinPartitions("grp", "block", "role")
        .mapInArrow(lambda b: _distances(b, dims, k), "rep bigint, hits array<struct<d: double, id: bigint>>")
    )


def _sample(df: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """At most FIT_ROWS vectors, the first by a hash of their ids, and the ids."""
    rows = df.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).toPandas()
    return np.array(rows["vec"].tolist(), dtype=float).reshape(-1, dims), rows["rep"].to_numpy(dtype=np.int64)


def search(reps: DataFrame, dims: int, k: int, load: float, block: int, **how) -> DataFrame:
    """(rep, hits): the k nearest of every vector of ``reps`` (rep, vec), in rounds of growing width."""
    n_reps = reps.count()
    sample, sample_ids = _sample(reps, dims)
    full = min(k, n_reps - 1)
    asks, ask_ids, least, done = sample, sample_ids, 0.0, []
    asking, before = reps.withColumn("asks", F.lit(True)), None
    while True:
        hashing = fit(sample, sample_ids, asks, ask_ids, n_reps, load, least, **how)
        hits = cell_hits(asking, dims, hashing, k, block)
        if before is not None:
            hits = hits.unionByName(before)
        found = hits.groupBy("rep").agg(F.flatten(F.collect_list("hits")).alias("hits")).select("rep", F.slice(F.array_sort(F.array_distinct("hits")), 1, k).alias("hits"))
        if hashing.width is None:
            return functools.reduce(DataFrame.unionByName, [*done, found])
        # Vectors that met no other have no row yet and ask again too.
        sure = (F.size("hits") >= full) & (F.element_at("hits", -1)["d"] <= CERTAIN * hashing.width)
        found = written(found.withColumn("sure", sure), "vector-hits")
        done.append(found.where("sure").select("rep", "hits"))
        went = asking.where("asks").select("rep") if before is not None else reps.select("rep")
        left = written(went.join(found.where("sure").select("rep"), "rep", "left_anti"), "vectors-asking")
        n_left = left.count()
        if not n_left:
            return functools.reduce(DataFrame.unionByName, done)
        # Few ids, which is checked, go to the vectors by broadcast; else both meet by id.
        again = (F.broadcast(left) if n_left <= FEW else left).withColumn("asks", F.lit(True))
        asking = written(reps.join(again, "rep", "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "vectors-round")
        before = found.where(~F.col("sure")).select("rep", "hits")
        asks, ask_ids = _sample(asking.where("asks"), dims)
        least, load = 2 * hashing.width, AGAIN * load if len(done) == 1 else load


def nearest_vectors(df: DataFrame, row_id: str, vec: Column, dims: int, k: int, load: float = LOAD, block: int = BLOCK, **how) -> DataFrame:
    """For every row its k nearest other rows: (row_id, neighbours array<struct<d, id>>), nearest first.

    Distance is Euclidean in double precision; ties go to the smaller id. ``row_id`` is an integer
    and counts once: of repeated ids the smallest vector counts. Rows with a null id, a null vector,
    another length than ``dims``, or a null or NaN member are not in the collection. With k or fewer
    other rows all of them are neighbours; a lone row has none; an empty table gives no rows.

    Rows with equal vectors form a class that is searched once, by its smallest id. The k + 1
    smallest ids of a class are all that can be anyone's neighbours, so a class with a third of all
    rows costs no more than others, and nothing is lost.
    """
    clean = df.select(F.col(row_id).cast("bigint").alias("id"), vec.alias("vec"))
    clean = clean.where(F.col("id").isNotNull() & (F.size("vec") == dims) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)))
    # + 0.0 makes -0.0 a plain zero, so equal vectors have equal prints.
    clean = clean.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    clean = clean.withColumn("fp", F.unhex(F.md5(F.col("vec").cast("string"))))
    rows = written(clean, "vectors")
    spark = rows.sparkSession
    reps = written(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec")), "vector-classes")
    merged = search(reps.select("rep", "vec"), dims, k, load, block, **how)

    # The k + 1 smallest ids of each class: the limit inside the window applies before the exchange too.
    ranked = rows.select("fp", "id").withColumn("rn", F.row_number().over(Window.partitionBy("fp").orderBy("id"))).where(F.col("rn") <= k + 1)
    firsts = ranked.groupBy("fp").agg(F.array_sort(F.collect_list("id")).alias("firsts"))
    classes = reps.select("fp", "rep", "n").join(firsts, "fp")
    other = (
        merged.select("rep", F.explode("hits").alias("hit"))
        .select("rep", F.col("hit.d").alias("d"), F.col("hit.id").alias("cand"))
        .join(classes.select(F.col("rep").alias("cand"), "firsts"), "cand")
        .groupBy("rep")
        .agg(F.flatten(F.collect_list(F.transform("firsts", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))))).alias("others"))
        .select("rep", F.slice(F.array_sort("others"), 1, k).alias("others"))
    )
    per_class = written(classes.join(other, "rep", "left").select("fp", "n", "firsts", "others"), "class-neighbours")
    n_rows = rows.count()
    hot = [r[0] for r in per_class.where(F.col("n") * HOT_SHARE > F.lit(n_rows)).select("fp").collect()] if n_rows > 100_000 else []
    joined = salted_join(rows.select("fp", "id"), per_class.drop("n"), "fp", F.col("id"), hot)
    own = F.transform(F.filter("firsts", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")))
    none = F.expr("cast(array() as array<struct<d: double, id: bigint>>)")
    both = F.slice(F.concat(own, F.coalesce("others", none)), 1, k)
    return joined.select(F.col("id").alias(row_id), both.alias("neighbours"))


def pairs(neighbours: DataFrame, row_id: str, a: str, b: str) -> DataFrame:
    """Each pair once, the smaller id first, if one is a neighbour of the other."""
    one = neighbours.select(F.col(row_id).alias("x"), F.explode("neighbours.id").alias("y"))
    return one.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)).distinct()
