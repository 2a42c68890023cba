"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written


def as_matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that can take part, as a matrix of doubles, and their numbers: not null, of dim components
    (by default as many as most have), all of them finite, and not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], dtype=np.int64)
    if dim is None:
        known = sizes[sizes > 0]
        dim = int(np.bincount(known).argmax()) if len(known) else 1
    at = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(at)).flatten().cast(pa.float64())
    flat = np.array(values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), dim)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return flat[good], at[good]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1) - 2 * (x @ c.T)


class AdditiveQuantizer:
    """x is stored as one code for each of several full-dimensional codebooks and the norm of the sum of their vectors.

    All in doubles, so a few rows of huge components take nothing from the others."""

    def __init__(self, books: np.ndarray, beam: int, cells: np.ndarray):
        self.books, self.beam, self.cells = books, beam, cells

    @classmethod
    def fit(cls, x: np.ndarray, n_books: int, n_codes: int, beam: int, rounds: int, seed: int) -> AdditiveQuantizer:
        """Codebooks by k-means on residuals, one after the other; then, round by round, codes by beam search and all
        codebooks together by ridge-regularised least squares."""
        rng = np.random.default_rng(seed)
        n_codes = min(n_codes, max(1, len(x)))
        rest, books = x.copy(), []
        for _ in range(n_books):
            c = rest[rng.choice(len(rest), n_codes, replace=False)].copy()
            for _ in range(8):
                near = squared(rest, c).argmin(axis=1)
                count = np.bincount(near, minlength=n_codes)
                total = np.zeros_like(c)
                np.add.at(total, near, rest)
                full = count > 0
                c[full] = total[full] / count[full, None]
            rest -= c[squared(rest, c).argmin(axis=1)]
            books.append(c)
        own = cls(np.stack(books), beam, books[0])
        for _ in range(rounds):
            codes = own.encode(x)[0].astype(np.int64) + np.arange(n_books) * n_codes
            gram, right = np.zeros((n_books * n_codes,) * 2), np.zeros((n_books * n_codes, x.shape[1]))
            for m in range(n_books):
                np.add.at(right, codes[:, m], x)
                for k in range(n_books):
                    np.add.at(gram, (codes[:, m], codes[:, k]), 1)
            flat = own.books.reshape(-1, x.shape[1])
            solved = flat + np.linalg.solve(gram + np.eye(len(gram)), right - gram @ flat)
            own = cls(solved.reshape(own.books.shape), beam, books[0])
        return own

    def encode(self, x: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a byte for each codebook) and norms of the stored sums. Keeps the beam best partial sums of every row."""
        codes, norms = [], []
        for a in range(0, len(x), step):
            part = x[a : a + step]
            n = len(part)
            rest, picked, loss = part[:, None, :], np.zeros((n, 1, 0), np.uint8), (part * part).sum(axis=1)[:, None]
            for c in self.books:
                cost = (loss[:, :, None] + squared(rest.reshape(-1, rest.shape[2]), c).reshape(n, rest.shape[1], len(c))).reshape(n, -1)
                keep = min(self.beam, cost.shape[1])
                best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
                loss = np.take_along_axis(cost, best, axis=1)
                parent, code = best // len(c), best % len(c)
                rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - c[code]
                picked = np.concatenate([np.take_along_axis(picked, parent[:, :, None], axis=1), code[:, :, None].astype(np.uint8)], axis=2)
            top = loss.argmin(axis=1)
            codes.append(picked[np.arange(n), top])
            stored = part - rest[np.arange(n), top]
            norms.append((stored * stored).sum(axis=1))
        if not codes:
            return np.zeros((0, len(self.books)), np.uint8), np.zeros(0)
        return np.concatenate(codes), np.concatenate(norms)

    def errors(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows to their stored sums, and the lengths of the sums' parts in all."""
        rest, mass = x.copy(), np.zeros(len(x))
        for m, c in enumerate(self.books):
            rest -= c[codes[:, m]]
            mass += np.sqrt((c * c).sum(axis=1))[codes[:, m]]
        error = np.sqrt((rest * rest).sum(axis=1))
        return error + 1e-14 * (mass + np.sqrt((x * x).sum(axis=1))), mass

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances for each query and stored row, from tables of inner products."""
        out = (queries * queries).sum(axis=1)[:, None] + norms[None, :]
        for m, c in enumerate(self.books):
            out += (-2 * (queries @ c.T))[:, codes[:, m]]
        return out


def distances(queries: np.ndarray, columns: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (queries[r], rows c), summed component by component, so equal vectors tie exactly.

    columns holds the rows' components, a row of it for each."""
    total, by_component = np.zeros(len(r)), np.ascontiguousarray(queries.T)
    for q, x in zip(by_component, columns):
        d = q[r] - x[c]
        total += d * d
    return np.sqrt(total)


class Block(NamedTuple):
    """Rows that are searched together: ids, vectors, codes and, of the stored sums, squared norms, distances to the vectors
    and the lengths of their parts in all."""

    ids: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    norms: np.ndarray
    errors: np.ndarray
    masses: np.ndarray


def best_in_block(quantizer: AdditiveQuantizer, block: Block, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int, rerank: int, step: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of queries, ids and distances of the k nearest rows of the block that lie within each query's limit.

    Table lookups order the rows; the first rerank of them are scored exactly, and the k-th of these lowers the limit. No row
    lies nearer than its stored sum's distance less its own error, so all rows whose difference is not above the limit
    are scored as well, and no others can be among the k nearest. Rows with the query's id are left out."""
    columns = np.ascontiguousarray(block.x.T)
    first = min(rerank, len(block.ids))
    for a in range(0, len(ids), step):
        part, n = queries[a : a + step], len(ids[a : a + step])
        own = ids[a : a + step, None] == block.ids[None, :]
        with np.errstate(all="ignore"):
            near = quantizer.scores(part, block.codes, block.norms)
            rounding = 1e-13 * (np.sqrt((part * part).sum(axis=1))[:, None] + block.masses[None, :]) ** 2
            least = np.sqrt(np.maximum(near - rounding, 0.0)) - block.errors[None, :] * (1 + 1e-9)
            near[own] = np.inf
            order = np.argpartition(near, first - 1, axis=1)[:, :first]
            r = np.repeat(np.arange(n), first)
            d = distances(part, columns, r, order.ravel())
            taken = np.where(np.take_along_axis(own, order, axis=1), np.inf, d.reshape(n, first))
            limit = limits[a : a + step]
            if first >= k:
                limit = np.fmin(limit, np.partition(taken, k - 1, axis=1)[:, k - 1])
            rest = ~(least > limit[:, None] * (1 + 1e-9)) & ~own
            np.put_along_axis(rest, order, False, axis=1)
            more_r, more_c = np.nonzero(rest)
            r, c = np.concatenate([r, more_r]), np.concatenate([order.ravel(), more_c])
            d = np.concatenate([d, distances(part, columns, more_r, more_c)])
            good = ~own[r, c] & ~(d > limit[r])
        r, c, d = r[good], c[good], d[good]
        sort = np.lexsort((block.ids[c], d, r))
        r, c, d = r[sort], c[sort], d[sort]
        top = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        yield a + r[top], block.ids[c[top]], d[top]


def nearest(
    df: DataFrame,
    every: int = 100,
    k: int = 10,
    rerank: int = 64,
    n_books: int = 16,
    n_codes: int = 256,
    beam: int = 4,
    fit_rows: int = 10_000,
    row_block: int = 16384,
    query_block: int = 16384,
    seed: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest for each row whose id is divisible by every, among all rows but its own.

    The quantizer is fitted on at most fit_rows rows (drawn by a hash of their ids), on the driver; every row is encoded, with
    the error of its stored sum. Rows lie in cells, by the nearest of the means the first codebook began with, and cells in
    blocks of about row_block rows, so a cell that holds a third of all rows is many blocks. A query first searches a block
    each of the cells nearest to it, as far as 4 * k rows ask for, which bounds its k-th distance; then all other blocks of
    the cells that reach within that bound. In a block codes are scored by table lookups and the best reranked on the
    original vectors in double precision; so are all others that their errors leave open (`best_in_block`), so the neighbours
    found are the true ones, in dense groups too: the codes decide what that costs. A row moves once for every
    query_block queries, a query once for every block it searches, and a block gives k rows at most for each query.

    Rows with equal vectors are interchangeable but for their ids, so before the search no more than k + 1 of them, those with the
    smallest ids, are kept: no answer needs another, and a vector that a third of the rows share costs a few rows. Queries are
    all kept, however many have equal vectors, since each has an answer of its own. Rows
    whose vector is null, zero, of another dimension than most of the first rows or holds null or non-finite components take
    no part. Null ids take no part. A repeated id with one vector counts once; its other rows are never its own
    neighbours. With fewer candidates than k all are returned; an empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    share = int((1 << 20) * min(1.0, 2 * fit_rows / max(1, rows.count()))) + 1  # so few rows come near the limit, however many there are
    fit = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
    x, _ = as_matrix(fit.column("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(x):
        return spark.createDataFrame([], schema)
    dim = x.shape[1]
    quantizer = AdditiveQuantizer.fit(x, n_books, n_codes, beam, 3, seed)
    cells, most = quantizer.cells, k + 1

    def distinct(most: int | None):
        """Ids and vectors of the rows that take part, each once; of a batch's equal vectors the most smallest ids (None: all)."""

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, at = as_matrix(batch.column("v"), dim)
                ids = batch.column("id").to_numpy()[at]
                order = np.argsort(ids, kind="stable")
                seen: dict[bytes, list[int]] = {}
                keep = []
                for i in order.tolist():
                    name = xxhash.xxh3_128_digest((flat[i] + 0.0).tobytes())
                    own = seen.setdefault(name, [])
                    if (most is None or len(own) < most) and (not own or own[-1] != ids[i]):
                        own.append(ids[i])
                        keep.append((i, name))
                at = [i for i, _ in keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([n for _, n in keep], pa.binary()), pa.array(list(flat[at]), pa.list_(pa.float64()))], names=["id", "name", "v"])

        return take

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy().reshape(-1, dim)

    def to_cells(flat: np.ndarray) -> np.ndarray:
        """Distances to all cells' means."""
        total = np.zeros((len(flat), len(cells)))
        with np.errstate(over="ignore"):
            for j in range(dim):
                d = flat[:, j, None] - cells[None, :, j]
                total += d * d
        return np.sqrt(total)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = matrix(batch.column("v"))
            codes, norms = quantizer.encode(flat)
            errors, masses = quantizer.errors(flat, codes)
            far = to_cells(flat)
            cell = far.argmin(axis=1) if len(flat) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("name"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(errors), pa.array(masses), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(flat)), cell])],
                names=["id", "name", "v", "code", "norm", "error", "mass", "cell", "far"],
            )

    with Scratch(spark) as scratch:
        valid = rows.mapInArrow(distinct(most), "id long, name binary, v array<double>").dropDuplicates(["id", "name"])
        first = Window.partitionBy("name").orderBy("id")
        valid = valid.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).drop("n")
        coded = scratch.written(valid.mapInArrow(encode, "id long, name binary, v array<double>, code binary, norm double, error double, mass double, cell int, far double"), "coded")
        asked = scratch.written(rows.filter(F.col("id") % every == 0).mapInArrow(distinct(None), "id long, name binary, v array<double>").dropDuplicates(["id", "name"]), "queries")

        count, radius = np.zeros(len(cells), np.int64), np.zeros(len(cells))
        for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most n_codes rows
            count[r.cell], radius[r.cell] = r.n, r.far
        blocks = np.maximum(1, -(-count // row_block))
        n_parts = max(1, -(-asked.count() // query_block))
        placed = coded.withColumn("block", F.pmod(F.xxhash64("id", "name"), F.element_at(F.lit(blocks.tolist()), F.col("cell") + 1)).cast("int"))
        placed = placed.drop("far", "name").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))

        def visits(later: bool):
            def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for a in range(0, batch.num_rows, 64):
                        some = batch.slice(a, 64)
                        flat, ids = matrix(some.column("v")), some.column("id").to_numpy()
                        far = to_cells(flat)
                        order = np.argsort(far, axis=1, kind="stable")
                        sizes = count[order]
                        soon = np.zeros(far.shape, bool)
                        np.put_along_axis(soon, order, (np.cumsum(sizes, axis=1) - sizes < 4 * k) & (sizes > 0), axis=1)
                        own = (ids // every)[:, None] % blocks[None, :]
                        if later:
                            limit = some.column("limit").to_numpy()
                            open_ = ~((far - radius) - 1e-9 * (far + radius) > limit[:, None]) & (count > 0)
                            at, cell = np.nonzero(open_)
                            at, cell = np.repeat(at, blocks[cell]), np.repeat(cell, blocks[cell])
                            start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (cell[1:] != cell[:-1])]) if len(at) else np.zeros(0, np.int64)
                            block = np.arange(len(at)) - np.repeat(start, blocks[cell[start]])
                            new = ~(soon[at, cell] & (own[at, cell] == block))
                            at, cell, block = at[new], cell[new], block[new]
                        else:
                            at, cell = np.nonzero(soon)
                            block = own[at, cell]
                        part = (ids // every) % n_parts
                        out = some.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [*out.columns, pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(part[at].astype(np.int32))],
                            names=[*out.schema.names, "cell", "block", "part"],
                        )

            return visit

        def search(stored: pa.Table, asks: pa.Table) -> pa.Table:
            found = []
            if stored.num_rows and asks.num_rows:
                codes = np.frombuffer(b"".join(stored["code"].to_pylist()), np.uint8).reshape(stored.num_rows, -1)
                block = Block(stored["id"].to_numpy(), matrix(stored["v"]), codes, *(stored[c].to_numpy() for c in ("norm", "error", "mass")))
                asks = asks.combine_chunks()
                for at, ids, d in best_in_block(quantizer, block, asks["id"].to_numpy(), matrix(asks["v"]), asks["limit"].to_numpy(), k, rerank):
                    at = pa.array(at)
                    found.append(pa.table([asks["id"].take(at), asks["name"].take(at), pa.array(ids), pa.array(d)], names=["query_id", "name", "vec_id", "score"]))
            empty = pa.schema([("query_id", pa.int64()), ("name", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64())])
            return pa.concat_tables(found) if found else empty.empty_table()

        def searched(asks: DataFrame, later: bool) -> DataFrame:
            key = ["cell", "block", "part"]
            to = asks.mapInArrow(visits(later), "id long, name binary, v array<double>, limit double, cell int, block int, part int")
            return placed.groupBy(*key).cogroup(to.groupBy(*key)).applyInArrow(search, "query_id long, name binary, vec_id long, score double")

        soon = scratch.written(searched(asked.withColumn("limit", F.lit(float("inf"))), False), "near")
        within = Window.partitionBy("query_id", "name").orderBy("score", "vec_id")
        limits = soon.withColumn("n", F.row_number().over(within)).filter(F.col("n") == k).select(F.col("query_id").alias("id"), "name", F.col("score").alias("limit"))
        bounded = asked.join(limits, ["id", "name"], "left").select("id", "name", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
        final = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = soon.unionByName(searched(bounded, True)).withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
        return written(found.select("query_id", "rank", "vec_id", "score"), "neighbours")
