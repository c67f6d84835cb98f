"""Exact top-k inner products: vectors in buckets of like length, each pruned by length or by coordinates, then verified."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage, first_rows, shared_folder
from . import texts

K = 5
STEP = 256.0  # a component is this many whole units
BUCKET = 4_096  # vectors of a bucket at most
QUERIES = 256  # queries multiplied with a bucket at once
CHUNK_BYTES = 32 * 1024 * 1024  # queries sent to all tasks at once
SEEDS = 4_096  # longest vectors every query is held against first
COORDINATES = 3  # coordinates a candidate must agree in
COORDINATES_FROM = 0.8  # local cosine threshold from which a bucket is pruned by coordinates
SLACK = 1e-9  # relative room for rounding in bounds, never in products
EXACT = 2.0**53  # products of doubles below are whole and exact


def whole_vectors(vectors: DataFrame, step: float = STEP) -> DataFrame:
    """vec_id, vector (whole components as signed 32- or 64-bit integers), width and length of every vector that takes part.

    A component is floor(step * x).  Vectors that are null or hold null or non-finite components, and rows without vec_id,
    take no part.
    """

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        lists = batch.column(1)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        scaled = np.floor(values * step)
        if len(scaled) and np.abs(scaled).max() >= 2.0**63:
            raise OverflowError("a component does not fit 64 bits")
        small = len(scaled) == 0 or np.abs(scaled).max() < 2.0**31
        blob = scaled.astype("<i4" if small else "<i8").tobytes()
        item = 4 if small else 8
        pieces = [blob[item * a : item * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        widths = np.diff(bounds)
        same = len(widths) > 0 and widths.min() == widths.max()
        rows = scaled.reshape(len(widths), -1) if same and widths[0] else (scaled[x:y] for x, y in zip(bounds[:-1], bounds[1:]))
        length = [math.sqrt(float(np.dot(row, row))) for row in rows]
        yield {"vec_id": batch.column(0), "vector": pieces, "width": widths, "length": length}

    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    taken = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & whole)
    return texts.map_batches(taken, kernel, "vec_id long, vector binary, width int, length double")


def _matrices(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each width and their vectors as 64-bit integers [rows, width]."""
    widths = table.column("width").to_numpy()
    blobs = table.column("vector").to_pylist()
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        whole = np.zeros((len(rows), width), np.int64)
        for at, row in enumerate(rows.tolist()) if width else ():
            whole[at] = np.frombuffer(blobs[row], "<i4" if len(blobs[row]) == 4 * width else "<i8")
        yield rows, whole


class Best:
    """The best ``k`` of a set of queries of one width, kept as buckets go by."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, length: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.whole, self.length, self.k = ids, whole, length, k
        self.matrix = whole.astype(np.float64)
        self.least = least.copy()  # a score that at least ``k`` candidates reach, where known
        self.scores, self.found = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.held = np.zeros(len(ids), np.int64)

    def bucket(self, ids: np.ndarray, whole: np.ndarray, length: np.ndarray) -> None:
        """Hold the queries against a bucket, longest vector first."""
        matrix = whole.astype(np.float64)
        for at in range(0, len(self.ids), QUERIES):
            rows = np.arange(at, min(at + QUERIES, len(self.ids)))
            least = self.least[rows].astype(np.float64)
            rows = rows[self.length[rows] * length[0] * (1 + SLACK) >= least]  # others cannot reach their least in this bucket
            if len(rows) == 0:
                continue
            reach = self.length[rows] * length[0]
            local = np.where(reach > 0, self.least[rows] / np.maximum(reach, 1e-300), -1.0)
            exact = reach.max() < EXACT
            hits = [self._by_length(rows[local < COORDINATES_FROM], whole, matrix, length, exact)]
            for row, cosine in zip(rows[local >= COORDINATES_FROM], local[local >= COORDINATES_FROM]):
                hits.append(self._by_coordinates(row, min(cosine, 1.0), whole, matrix, length, exact))
            row, candidate, score = (np.concatenate(x) for x in zip(*hits))
            other = ids[candidate] != self.ids[row]
            self._merge(row[other], ids[candidate[other]], score[other])

    def _by_length(self, rows, whole, matrix, length, exact):
        """Candidates long enough for any of the rows are multiplied with all of them."""
        if len(rows) == 0:
            return (np.empty(0, np.int64),) * 3
        bound = self.least[rows].astype(np.float64)
        per_row = np.where(bound > 0, bound / np.maximum(self.length[rows] * (1 + SLACK), 1e-300), -1.0)
        upto = int(np.searchsorted(-length, -per_row.min(), side="right"))
        if exact:
            product = self.matrix[rows] @ matrix[:upto].T
        else:
            product = (self.whole[rows].astype(object) @ whole[:upto].T.astype(object)).astype(np.int64)
        row, candidate = np.nonzero(product >= self.least[rows][:, None])
        return rows[row], candidate, product[row, candidate].astype(np.int64)

    def _by_coordinates(self, row, cosine, whole, matrix, length, exact):
        """Only candidates whose largest query coordinates allow the cosine are multiplied.

        A unit vector within an angle of the query's has each coordinate's angle within the same range of the query's own.
        """
        unit = self.matrix[row] / self.length[row]
        keep, angle = np.ones(len(matrix), bool), math.acos(cosine)
        for f in np.argsort(-np.abs(unit))[:COORDINATES]:
            own = math.acos(min(1.0, max(-1.0, unit[f])))
            low, high = math.cos(min(math.pi, own + angle)) - 1e-7, math.cos(max(0.0, own - angle)) + 1e-7
            x = matrix[:, f] / np.maximum(length, 1e-300)
            keep &= (x >= low) & (x <= high)
        candidate = np.flatnonzero(keep)
        if exact:
            score = (matrix[candidate] @ self.matrix[row]).astype(np.int64)
        else:
            score = (whole[candidate].astype(object) @ self.whole[row].astype(object)).astype(np.int64)
        near = score >= self.least[row]
        return np.full(near.sum(), row), candidate[near], score[near]

    def _merge(self, row: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        if len(row) == 0:
            return
        touched = np.unique(row)
        held = self.held[touched]
        old = np.repeat(touched, held)
        place = np.arange(len(old)) - np.repeat(np.cumsum(held) - held, held)
        row, found = np.concatenate((old, row)), np.concatenate((self.found[old, place], found))
        score = np.concatenate((self.scores[old, place], score))
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        kept = place < self.k
        row, found, score, place = row[kept], found[kept], score[kept], place[kept]
        self.found[row, place], self.scores[row, place] = found, score
        self.held[touched] = np.bincount(row, minlength=len(self.ids))[touched]
        full = touched[self.held[touched] == self.k]
        self.least[full] = np.maximum(self.least[full], self.scores[full, self.k - 1])


NONE = np.iinfo(np.int64).min  # no least score is known


def _least(queries: DataFrame, seeds: pa.Table, k: int) -> DataFrame:
    """``queries`` with least: the k-th best product with the seeds, a score that the whole table can only raise."""
    sides = {w.shape[1]: (rows, w) for rows, w in _matrices(seeds)}
    ids, length = seeds.column("vec_id").to_numpy(), seeds.column("length").to_numpy()
    names = queries.columns
    sent = queries.sparkSession.sparkContext.broadcast({w: (ids[rows], whole, length[rows]) for w, (rows, whole) in sides.items()})

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        least = np.full(batch.num_rows, NONE)
        for rows, whole in _matrices(batch):
            if whole.shape[1] in sent.value:
                ids, length = (batch.column(c).to_numpy()[rows] for c in ("vec_id", "length"))
                best = Best(ids, whole, length, least[rows], k)
                best.bucket(*sent.value[whole.shape[1]])
                least[rows] = best.least
        yield {name: batch.column(name) for name in names} | {"least": least}

    return texts.map_batches(queries, kernel, "vec_id long, vector binary, width int, length double, least long")


def _search(stored: DataFrame, chunk: pa.Table, first: int, k: int) -> DataFrame:
    """Best candidates of every task for the queries of a chunk: query (its number from ``first`` on), query_id, vec_id, score."""
    queries = [(rows, whole, *(chunk.column(c).to_numpy()[rows] for c in ("vec_id", "length", "least"))) for rows, whole in _matrices(chunk)]
    sent = stored.sparkSession.sparkContext.broadcast(queries)
    schema, arrow = texts.schemas("query long, query_id long, vec_id long, score long")

    def run(batches):
        best = {whole.shape[1]: (rows, Best(ids, whole, length, least, k)) for rows, whole, ids, length, least in sent.value}
        before = None
        for batch in batches:
            named = list(zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()))
            new = np.array([row != earlier for row, earlier in zip(named, [before, *named])], bool)  # equal rows lie together
            before = named[-1] if named else before
            ids, length = (batch.column(c).to_numpy() for c in ("vec_id", "length"))
            for rows, whole in _matrices(batch):
                if whole.shape[1] not in best:
                    continue
                fresh = np.flatnonzero(new[rows])
                for at in range(0, len(fresh), BUCKET):
                    part = fresh[at : at + BUCKET]
                    best[whole.shape[1]][1].bucket(ids[rows[part]], whole[part], length[rows[part]])
        for rows, kept in best.values():
            query = np.repeat(np.arange(len(kept.ids)), kept.held)
            place = np.arange(len(query)) - np.repeat(np.cumsum(kept.held) - kept.held, kept.held)
            columns = (rows[query] + first, kept.ids[query], kept.found[query, place], kept.scores[query, place])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

    return stored.mapInArrow(run, schema)


def top_products(vectors: DataFrame, is_query: Column, k: int = K, step: float = STEP) -> DataFrame:
    """The ``k`` rows with the largest inner product for every query: query_id, rank, vec_id, score.  Exact.

    ``vectors`` has vec_id and embedding; the rows where ``is_query`` (over vec_id) holds are queries, every row with another
    vec_id is a candidate.  Components are whole numbers floor(step * x).  Ties go to the smaller vec_id; with fewer than
    ``k`` candidates all are returned.

    Rows are dealt by length (and, among equal lengths, by a hash of their id), so a task's buckets hold vectors of like
    length.  For each query and bucket the best score so far gives a local cosine threshold: above one the bucket is
    skipped; from ``COORDINATES_FROM`` on candidates are pruned by the query's largest coordinates; below, by their length.
    What is left is multiplied out in whole numbers.  Thresholds start from products with the longest vectors.  Queries
    travel in chunks of about ``CHUNK_BYTES``, a job over all buckets each.

    Vectors that are null, or hold null or non-finite components, and rows without vec_id take no part.  Equal rows count
    once; rows that share a vec_id but not the vector are candidates of their own, and queries with a ranking each.
    Vectors of different widths do not meet.  Other columns are ignored; an empty table gives an empty result.  A component
    or score beyond 64 bits raises.
    """
    spark = vectors.sparkSession
    order = [F.col("length").desc(), F.xxhash64("vec_id"), F.col("vec_id"), F.col("vector")]
    taken = cut_lineage(whole_vectors(vectors, step))
    stored = cut_lineage(taken.repartitionByRange(*order[:2]).sortWithinPartitions(*order))
    queries = stored.where(is_query).distinct()
    wide = stored.agg(F.max(F.octet_length("vector")).alias("wide")).first()["wide"] or 1
    seeds = stored.orderBy(*order).limit(max(k + 1, min(SEEDS, CHUNK_BYTES // wide))).distinct().toArrow()  # bounded in rows and bytes
    seeds = seeds.sort_by([("length", "descending"), ("vec_id", "ascending")])
    queries = cut_lineage(_least(queries, seeds, k))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("vector") + 32).alias("bytes")).first()
    chunks = max(1, math.ceil((size["bytes"] or 0) / CHUNK_BYTES))
    dealt = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(chunks)))
    folder = f"{shared_folder(spark)}/top-products-{uuid.uuid4().hex}"
    for chunk in range(chunks):
        found = _search(stored, dealt.where(F.col("chunk") == chunk).drop("chunk").toArrow(), chunk << 32, k)
        best = first_rows(found, ["query"], [F.col("score").desc(), F.col("vec_id")], k, "rank")
        best.select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/{chunk}")
    return spark.read.parquet(*[f"{folder}/{chunk}" for chunk in range(chunks)])
