"""Approximate maximum inner product search: score-aware 4-bit quantisation, table scans, exact reranking."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .vectors import GROUP_ROWS, QUERY_ROWS, Block, best, bundles, dealt_queries, every, numbered, pick, search_blocks, valid

#: The codebooks are fitted on this many vectors at most, those with the smallest hashes of their ids.
SAMPLE = 8_192
#: Dimensions of a subspace, each with 16 centroids; candidates of a group that are scored exactly at least; queries scanned together.
SUB_DIM, RERANK, SCAN = 2, 128, 128
#: Inner products above this share of a vector's length are what has to be right.
THRESHOLD = 0.2
#: Candidates are scored exactly as far down as the k-th best product less so many standard deviations of the tables' error.
ERRORS = 3.0


class Codebook:
    """16 centroids a subspace, fitted so that the residual along the vector costs more than across it.

    The weight of the parallel part against the rest is that of a threshold T on the cosine: (d - 1) T^2 / (1 - T^2).
    """

    def __init__(self, sample: np.ndarray, threshold: float = THRESHOLD, sub_dim: int = SUB_DIM, rounds: int = 6, seed: int = 7):
        self.dim = sample.shape[1]
        self.sub_dim = sub_dim
        self.parts = -(-self.dim // sub_dim)
        self.parts += self.parts % 2  # two codes make a byte
        self.weight = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        x = self.padded(sample)
        rng = np.random.default_rng(seed)
        chosen = x[rng.choice(len(x), 16, replace=len(x) < 16)]
        self.centroids = np.ascontiguousarray(chosen.transpose(1, 0, 2))  # part, code, dimension
        for _ in range(rounds):
            codes = self._codes(x, sweeps=1)
            self._refit(x, codes)

    def padded(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.parts * self.sub_dim))
        out[:, : self.dim] = vectors
        return out.reshape(len(vectors), self.parts, self.sub_dim)

    def _codes(self, x: np.ndarray, sweeps: int) -> np.ndarray:
        """Start from the nearest centroids; then each part in turn takes the best code given all others."""
        n = len(x)
        square = np.maximum((x**2).sum((1, 2)), 1e-30)
        far = np.stack([((x[:, p, None, :] - self.centroids[p]) ** 2).sum(2) for p in range(self.parts)], axis=1)  # n, part, code
        along = np.stack([(x[:, p, None, :] * (x[:, p, None, :] - self.centroids[p])).sum(2) for p in range(self.parts)], axis=1)
        codes = far.argmin(2)
        row = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for p in range(self.parts):
                others = total - along[row, p, codes[:, p]]
                cost = far[:, p] + (self.weight - 1) * (others[:, None] + along[:, p]) ** 2 / square[:, None]
                codes[:, p] = cost.argmin(1)
                total = others + along[row, p, codes[:, p]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centroid minimises the cost of the vectors that use it, all other parts held."""
        square = np.maximum((x**2).sum((1, 2)), 1e-30)
        residual = x - self.centroids[np.arange(self.parts), codes]
        total = (x * residual).sum((1, 2))
        for p in range(self.parts):
            own = x[:, p]
            others = total - (own * residual[:, p]).sum(1)
            for k in range(16):
                use = codes[:, p] == k
                if not use.any():
                    continue
                v = own[use]
                lean = (self.weight - 1) / square[use]
                left = use.sum() * np.eye(self.sub_dim) + (v * lean[:, None]).T @ v
                right = v.sum(0) + (v * (lean * ((v**2).sum(1) + others[use]))[:, None]).sum(0)
                self.centroids[p, k] = np.linalg.solve(left, right)
            residual[:, p] = own - self.centroids[p, codes[:, p]]
            total = others + (own * residual[:, p]).sum(1)

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Two 4-bit codes a byte: ``(n, parts / 2)``."""
        codes = self._codes(self.padded(vectors), sweeps)
        return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all centroids, summed for the 256 values of each byte: (byte, value, query)."""
        part = np.einsum("qpd,pkd->pkq", self.padded(queries), self.centroids)
        return (part[::2, :, None] + part[1::2, None]).reshape(self.parts // 2, 256, len(queries)).astype(np.float32)

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products ``(query, candidate)``, from the tables alone."""
        tables = self.tables(queries)
        out = np.zeros((len(codes), len(queries)), dtype=np.float32)
        for byte in range(codes.shape[1]):
            out += tables[byte][codes[:, byte]]
        return np.ascontiguousarray(out.T)


def products(vecs: np.ndarray, at: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal products; in blocks."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.concatenate([(vecs[at[i : i + 2048]] * query).sum(1) for i in range(0, len(at), 2048)]) if len(at) else np.zeros(0)


def usual_length(rows: DataFrame) -> int:
    """The length that most vectors of ``rows(id, vec)`` have, the larger of equals; 0 without any."""
    row = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return row["size"] if row else 0


def nearest(vectors: DataFrame, query_rows: "F.Column", k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best inner products found for the rows of ``vectors`` that satisfy ``query_rows(id)``.

    Codebooks are fitted on a bounded sample; every row is encoded once, and the index of 4-bit codes is written with
    the vectors. In each group of candidates all are scored from tables of their codes, and the ``rerank`` best (at
    least 2k) by the exact inner product of the original vectors in double precision, so that scores are exact and only
    which rows are found is approximate. The error of the tables is taken from those; all others that tie with the last
    of them, or whose table score could reach the k-th best product within ERRORS standard deviations of it, are scored
    exactly too, however many. Ties go to the smaller id. A query is no candidate of its own; other rows of its id are,
    and each row of an id that repeats is asked. Vectors that are null, zero or hold null or non-finite components take no part; repeated vectors all take part.
    Vectors of different lengths meet as if the shorter one had zeros at its end; those of another length than most
    have no codes and are scored exactly. So is a whole group where the k-th best product overflows, or is so small that
    it may have lost digits; products that overflow to infinity tie, and those of no value (infinity less infinity) take
    no part. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = numbered(valid(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0)), "anisotropic-rows")
    dim = usual_length(rows)
    drawn = rows.where(F.size("vec") == dim).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not drawn:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total, n_queries, scale = rows.agg(F.count("*"), F.count_if(query_rows("id")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    book = Codebook(np.array([r["vec"] for r in drawn]) / scale)  # of components up to 1, whatever the vectors' size
    groups, blocks = max(1, math.ceil(total / GROUP_ROWS)), max(1, math.ceil(n_queries / QUERY_ROWS))
    wanted = max(rerank, 2 * k)

    def encode(matrix: np.ndarray) -> np.ndarray:
        return book.encode(matrix / scale) if matrix.shape[1] == dim else np.zeros((len(matrix), 0), dtype=np.uint8)

    def search(q: Block, c: Block):
        out: list[tuple] = [([], [], [])]
        coded = q.vecs.shape[1] == dim and c.codes.shape[1] > 0
        for at in range(0, len(q.ids), SCAN):
            block = q.vecs[at : at + SCAN]
            scores = book.scan(block / scale, c.codes) if coded else np.zeros((len(block), 1))
            for place, (query, table) in enumerate(zip(block, scores), at):
                others = c.rows != q.rows[place]
                found, exact = _scored(c.vecs, query, np.where(others, table, -np.inf), scale, wanted, k) if coded else (np.flatnonzero(others), None)
                if exact is None:
                    exact = products(c.vecs, found, query)
                found, exact = found[~np.isnan(exact)], exact[~np.isnan(exact)]
                best_of = pick(exact, c.ids[found], k)
                out.append((np.full(len(best_of), place), c.ids[found][best_of], exact[best_of]))
        return tuple(np.concatenate(x) for x in zip(*out))

    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    index = materialize(bundles(grouped, ["grp"], [], encode), "anisotropic-index")
    asked = bundles(dealt_queries(rows.where(query_rows("id")), blocks), ["blk"], [])
    return best(search_blocks(asked.withColumn("grps", every(groups, "grps")), index.withColumn("blks", every(blocks, "blks")), [], search, "double"), k)


def _scored(vecs: np.ndarray, query: np.ndarray, table: np.ndarray, scale: float, wanted: int, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Which candidates to score exactly, by their table scores, and their products as far as they are known."""
    n = min(wanted, len(table))
    first = np.argpartition(-table, n - 1)[:n]
    first = first[np.isfinite(table[first])]
    if not len(first):
        return first, None
    exact = products(vecs, first, query)
    worst = min(k, len(first))
    last = np.partition(exact, -worst)[-worst]
    if not 1e-290 < abs(last) < np.inf:
        return np.flatnonzero(np.isfinite(table)), None
    scaled = exact / scale / scale
    error = scaled - table[first]
    bar = min(float(table[first].min()), last / scale / scale - error.mean() - ERRORS * error.std())
    more = np.flatnonzero(table >= bar)
    return (more, None) if len(more) > len(first) else (first, exact)


def op8_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: F.col(c) % 20 == 0)


__all__ = ["Codebook", "nearest", "op8_anisotropic", "pick"]
