"""Distances, exact nearest neighbours by pivots, and a list index of product-quantised vectors.

Both searches deal out vectors by cell (the nearest of some centres) and bounded chunks of a cell, and send a query to the
cells it needs; a task meets one chunk of vectors with one share of the queries and keeps ``k`` rows a query.  What the
driver holds is the centres, a few distances per cell, and the code books.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.operators.ordered import topk
from lodework.session import stage

#: Centres of the exact search; vectors of a cell and queries that meet in one task.
PIVOTS, CHUNK, ASKED = 64, 8192, 2048
#: Vectors that the list index is fitted on, most lists, and code words of a part of a vector.
FIT_ROWS, MOST_LISTS, WORDS = 1 << 15, 4096, 256


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors of different length")).cast("double"))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    return _same_length(a, b, F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))))


def inner(a: Column, b: Column) -> Column:
    return _same_length(a, b, _fold(a, b, lambda x, y: x * y))


def cosine_dist(a: Column, b: Column) -> Column:
    """1 - cosine; NULL for a zero vector."""
    norms = F.sqrt(_fold(a, a, lambda x, y: x * y)) * F.sqrt(_fold(b, b, lambda x, y: x * y))
    return _same_length(a, b, 1 - _fold(a, b, lambda x, y: x * y) / F.nullif(norms, F.lit(0.0)))


def _distances(rows: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((rows - query) ** 2).sum(axis=1))
    if metric == "inner":
        return -(rows @ query)
    norms = np.linalg.norm(rows, axis=1) * np.linalg.norm(query)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, 1 - (rows @ query) / norms, np.nan)


def _rows(df: DataFrame, id_col: str, vec: str, names: tuple[str, str], metric: str) -> DataFrame:
    """Ids and vectors in double precision; unit vectors for the cosine, where zero vectors have no distance and go."""
    i, v = names
    rows = df.select(F.col(id_col).cast("long").alias(i), F.col(vec).cast("array<double>").alias(v)).where(F.col(v).isNotNull())
    if metric != "cosine":
        return rows
    return rows.where(F.exists(v, lambda x: x != 0)).withColumn(v, _unit(F.col(v)))


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-30)))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from all centres."""
    return np.maximum((rows ** 2).sum(1)[:, None] - 2 * rows @ centres.T + (centres ** 2).sum(1)[None, :], 0)


def _nearest(rows: DataFrame, centres: np.ndarray, schema: str) -> DataFrame:
    """Adds ``cell`` (number of the nearest centre) and ``gap`` (the distance from it) to rows id, v."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                gaps = _squares(_matrix(batch.column(1)), centres)
                cell = gaps.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(gaps[np.arange(len(cell)), cell]))], ["id", "v", "cell", "gap"])

    return rows.mapInArrow(run, f"{schema}, cell int, gap double")


def _chunked(rows: DataFrame, sizes: dict[int, int], shares: int) -> DataFrame:
    """Adds ``chunk``, of at most about ``CHUNK`` rows of a cell, and a copy per share of the queries."""
    spark = rows.sparkSession
    chunks = spark.createDataFrame([(c, -(-n // CHUNK)) for c, n in sizes.items()], "cell int, _chunks int")
    cut = rows.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")).drop("_chunks")
    return cut.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))) if shares > 1 else cut.withColumn("share", F.lit(0))


def _shares(queries: DataFrame) -> tuple[int, DataFrame]:
    """In how many shares the queries are dealt out, and the queries with their ``share``."""
    shares = max(1, -(-queries.count() // ASKED))
    return shares, queries.withColumn("share", F.pmod(F.xxhash64("qid"), F.lit(shares)).cast("int"))


def _sample(rows: DataFrame, count: int) -> np.ndarray:
    """That many vectors, those whose ids have the least hashes."""
    return _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(count).select("v").toArrow()["v"])


BEST = "qid long, id long, distance double"
EMPTY = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})


def _table(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    if not found:
        return EMPTY
    return pa.table({"qid": pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
                     "id": pa.array(np.concatenate([i for _, i, _ in found])), "distance": pa.array(np.concatenate([d for _, _, d in found]))})


def _best(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    good = np.flatnonzero(~np.isnan(dist))
    ids, dist = ids[good], dist[good]
    if len(dist) > 4 * k:  # ties of the k-th distance stay
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
        ids, dist = ids[near], dist[near]
    order = np.lexsort((ids, dist))[:k]
    return ids[order], dist[order]


def knn(df: DataFrame, id_col: str, vec: str, queries: DataFrame, qid: str, q_vec: str, k: int,
        metric: str = "l2") -> DataFrame:
    """(qid, id, distance, rn): the exact ``k`` nearest rows of each query; l2, cosine or inner (negative product).

    Every row belongs to the cell of its nearest pivot.  The distances of the cells' ``k`` innermost rows from their
    pivots bound a query's k-th distance from above; the triangle inequality and the half-space between two pivots bound
    its distance from a cell from below, and it is sent to the cells that may hold a neighbour.  Within a cell the same
    inequality skips rows.  The inner product is no metric: there every cell is needed.
    """
    rows = _rows(df, id_col, vec, ("id", "v"), metric)
    asked = _rows(queries, qid, q_vec, ("qid", "q"), metric)
    pivots = _sample(rows, PIVOTS)
    if not len(pivots):
        return topk(df.sparkSession.createDataFrame([], BEST), ["qid"], [F.asc("distance"), F.asc("id")], k)
    placed = stage(_nearest(rows, pivots, "id long, v array<double>"), "knn-cells")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).collect()}
    inner_rows = topk(placed.select("cell", "gap"), ["cell"], [F.asc("gap")], k).collect()
    near_cell, near_gap = np.array([r["cell"] for r in inner_rows]), np.array([r["gap"] for r in inner_rows])
    known = np.array(sorted(cells))
    low, high = (np.array([cells[c][name] for c in known]) for name in ("low", "high"))
    chunks = {c: -(-cells[c]["n"] // CHUNK) for c in cells}
    between = np.sqrt(_squares(pivots, pivots))
    shares, asked = _shares(asked)

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            gaps = np.sqrt(_squares(_matrix(batch.column(1)), pivots))
            if metric == "inner" or len(near_gap) < k:
                bound = np.full(len(gaps), np.inf)
            else:
                bound = np.partition(gaps[:, near_cell] + near_gap, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-9
            own = gaps[:, known]
            first = gaps.argmin(axis=1)
            apart = np.maximum(between[first][:, known], 1e-30)
            half = np.where(known[None, :] == first[:, None], 0, (own ** 2 - gaps.min(axis=1)[:, None] ** 2) / (2 * apart))
            needed = (own - high <= bound[:, None]) & (low - own <= bound[:, None]) & (half <= bound[:, None])
            who, where = np.nonzero(needed)
            times = np.array([chunks[c] for c in known[where]], np.int64)
            row, cell = np.repeat(who, times), np.repeat(where, times)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(known[cell].astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(own[row, cell]), pa.array(bound[row])],
                                             ["qid", "q", "share", "cell", "chunk", "from_pivot", "bound"])

    sent = asked.select("qid", "q", "share").mapInArrow(send, "qid long, q array<double>, share int, cell int, chunk int, from_pivot double, bound double")
    cut = _chunked(placed, {c: cells[c]["n"] for c in cells}, shares)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return EMPTY
        ids, mat, gap = left["id"].to_numpy(), _matrix(left["v"]), left["gap"].to_numpy()
        found = []
        for q, vector, apart, bound in zip(right["qid"].to_pylist(), _matrix(right["q"]), right["from_pivot"].to_pylist(), right["bound"].to_pylist()):
            pick = np.flatnonzero(np.abs(gap - apart) <= bound)
            if len(pick):
                found.append((q, *_best(ids[pick], _distances(mat[pick], vector, metric), k)))
        return _table(found)

    keys = ["cell", "chunk", "share"]
    best = cut.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, BEST)
    return topk(best, ["qid"], [F.asc("distance"), F.asc("id")], k)


def _lloyd(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of a bounded sample by k-means; an empty centre moves to the row farthest from its own."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        gaps = _squares(rows, centres)
        own = gaps.argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        if not filled.all():
            far = gaps[np.arange(len(rows)), own].argsort()[::-1][: (~filled).sum()]
            centres[~filled] = rows[far]
    return centres


class AnnIndex:
    """Vectors by list with their codes: lists(list_id, id, code, v), the centres, and a code book per part of a vector."""

    def __init__(self, lists: DataFrame, centres: np.ndarray, books: list[np.ndarray], sizes: dict[int, int], metric: str):
        self.lists, self.centres, self.books, self.sizes, self.metric = lists, centres, books, sizes, metric


def _split(width: int, parts: int) -> list[slice]:
    edges = [width * i // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def build_ann(df: DataFrame, id_col: str, vec: str, n_lists: int | None = None, metric: str = "l2", seed: int = 7,
              parts: int | None = None) -> AnnIndex:
    """Lists of vectors around centres, each vector with a product-quantised code of what it is apart from its centre.

    Centres and code books are fitted on at most ``FIT_ROWS`` vectors, every vector is indexed.  Lists grow with the square
    root of the rows (``MOST_LISTS`` at most); a code has a byte per part, by default one for four dimensions.
    """
    rows = _rows(df, id_col, vec, ("id", "v"), metric)
    rng = np.random.default_rng(seed)
    sample = _sample(rows, FIT_ROWS)
    if n_lists is None:
        n_lists = min(MOST_LISTS, max(1, int(df.count() ** 0.5)))
    centres = _lloyd(sample, n_lists, rng)
    width = sample.shape[1]
    spans = _split(width, min(width, parts or max(1, width // 4)))
    apart = sample - centres[_squares(sample, centres).argmin(axis=1)]
    books = [_lloyd(apart[:, span], WORDS, rng) for span in spans]

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mat = _matrix(batch.column(1))
            own = batch.column(2).to_numpy()
            rest = mat - centres[own]
            code = np.stack([_squares(rest[:, span], book).argmin(axis=1).astype(np.uint8) for span, book in zip(spans, books)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1)], ["list_id", "id", "code", "v"])

    made = _nearest(rows, centres, "id long, v array<double>").mapInArrow(encode, "list_id int, id long, code binary, v array<double>")
    # rebalance gathers small lists into few files and splits a list that holds much of the table
    lists = stage(made.hint("rebalance", "list_id"), "ann-lists", ["list_id"])
    sizes = {r["list_id"]: r["n"] for r in lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    return AnnIndex(lists, centres, books, sizes, metric)


def ann_search(index: AnnIndex, queries: DataFrame, qid: str, q_vec: str, k: int, probes: int, rerank: int | None = None) -> DataFrame:
    """(qid, id, distance, rn) over the ``probes`` lists nearest to each query; the distances are exact.

    Only the codes of these lists are read: a query's distances from the words of the code books are looked up and added.
    The best ``rerank`` of each query (by default ten times ``k``, 100 at least) are compared with their vectors.
    """
    centres, books, metric, sizes = index.centres, index.books, index.metric, index.sizes
    spans = _split(centres.shape[1], len(books))
    rerank = rerank or max(10 * k, 100)
    chunks = {c: -(-n // CHUNK) for c, n in sizes.items()}
    known = np.array(sorted(sizes))
    asked = _rows(queries, qid, q_vec, ("qid", "q"), metric)
    shares, asked = _shares(asked)

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mat = _matrix(batch.column(1))
            # the largest product wants the lists with the largest product
            gaps = -mat @ centres[known].T if metric == "inner" else _squares(mat, centres[known])
            near = known[np.argsort(gaps, axis=1)[:, :probes]]
            who, cell = np.repeat(np.arange(len(mat)), near.shape[1]), near.ravel()
            times = np.array([chunks[c] for c in cell], np.int64)
            row, cell = np.repeat(who, times), np.repeat(cell, times)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(cell.astype(np.int32)), pa.array(chunk.astype(np.int32))], ["qid", "q", "share", "cell", "chunk"])

    sent = stage(asked.select("qid", "q", "share").mapInArrow(send, "qid long, q array<double>, share int, cell int, chunk int"), "ann-asked")
    wanted = sorted(r[0] for r in sent.select("cell").distinct().collect())  # numbers of lists, MOST_LISTS at most
    codes = index.lists.where(F.col("list_id").isin(wanted)).select(F.col("list_id").alias("cell"), "id", "code")
    cut = _chunked(codes, sizes, shares)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return EMPTY
        ids = left["id"].to_numpy()
        code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        centre = centres[left["cell"][0].as_py()]
        found = []
        for q, vector in zip(right["qid"].to_pylist(), _matrix(right["q"])):
            guess = np.zeros(len(ids))
            for m, (span, book) in enumerate(zip(spans, books)):
                if metric == "inner":
                    guess -= (book @ vector[span])[code[:, m]]
                else:
                    guess += ((book - (vector - centre)[span]) ** 2).sum(axis=1)[code[:, m]]
            if metric == "inner":
                guess -= centre @ vector
            found.append((q, *_best(ids, guess, rerank)))
        return _table(found)

    keys = ["cell", "chunk", "share"]
    guessed = cut.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, BEST)
    good = topk(guessed, ["qid"], [F.asc("distance"), F.asc("id")], rerank).select("qid", "id").join(asked.select("qid", "q"), "qid")
    vectors = index.lists.where(F.col("list_id").isin(wanted)).select("id", "v")
    exact = {"l2": l2, "cosine": cosine_dist, "inner": lambda a, b: -inner(a, b)}[metric]
    scored = good.join(vectors, "id").select("qid", "id", exact(F.col("v"), F.col("q")).alias("distance"))
    return topk(scored, ["qid"], [F.asc("distance"), F.asc("id")], k)


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group, element by element with partial sums."""
    parts = df.select(group, F.posexplode(vec).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centre"))
