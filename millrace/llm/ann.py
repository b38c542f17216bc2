"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled by a power of two (exactly, so no magnitude overflows or
vanishes), then to length one, turned by a random rotation, and kept as the
signs of its coordinates (packed bits) with correction scalars: its length, the
exponent taken out, and the inner product f of the code and the turned vector.
For a query q the estimate of <q, o> is |o| <code, turned q> / f, and with high
probability it is off by at most |o| |q| sqrt((1 - f^2) / f^2) * EPSILON /
sqrt(D - 1). A candidate is reranked, in double precision, exactly if its upper
bound reaches the k-th best exact score among its block's best estimates.

All vectors are coded, none sampled. Queries and candidates meet in blocks:
a query block is paired with each candidate block, and only the k best of each
query leave the pair, packed in one row. Merging is by groups of ``FAN`` rows,
so no task holds a query's partial results from all blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, staged

#: Width of the error bound, in standard deviations of a coordinate of a random direction.
EPSILON = 3.0
#: The k-th best exact score among the FIRST * k best estimates is the floor for reranking.
FIRST = 8
SEED = 20240521
CANDIDATE_ROWS = 16_384
QUERY_ROWS = 256
FAN = 64


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for all tasks."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose largest component is 0.5 to 1, exponents of two taken out)."""
    exponent = np.frexp(np.abs(vectors).max(axis=1))[1].astype(np.int64)
    half = -exponent // 2  # in two steps, as 2^-exponent itself may be out of range
    return np.ldexp(np.ldexp(vectors, half[:, None]), (-exponent - half)[:, None]), exponent


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, lengths, f) of the rows of ``vectors``, as ``scaled`` makes them."""
    norm = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norm[:, None]) @ turn.T
    signs = turned >= 0
    f = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(signs, axis=1), norm, f


def best_first(query: np.ndarray, cand: np.ndarray, score: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """Order of (query, score * 2^exponent descending, candidate), exact at any magnitude; scores are 0 or 0.5 to 1 in size."""
    sign = np.sign(score)
    return np.lexsort((cand, -score, -sign * exponent, -sign, query))


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, exponent: np.ndarray, codes: np.ndarray, norm: np.ndarray, f: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best candidates of each query in a block: (query row, candidate id, score, its exponent), and how many pairs were reranked.

    ``vectors`` with ``exponent`` are as ``scaled`` makes them, ``queries`` as given.
    """
    queries, qexponent = scaled(queries)
    dim = queries.shape[1]
    # sizes within the block are relative to its largest exponent; what vanishes beside it has estimate and bound 0
    size = np.ldexp(norm, exponent - exponent.max())
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    turned = (queries @ rotation(dim).T).astype(np.float32)
    length = np.linalg.norm(queries, axis=1)[:, None]
    est = (turned @ signs.T) * (size / f)
    slack = size * (np.sqrt(np.maximum(1 - f * f, 0)) * epsilon / np.sqrt(max(dim - 1, 1)) + 1e-5) / f  # 1e-5: the product above is of single precision
    upper = est + slack * length
    own = query_ids[:, None] == ids[None, :]
    est[own] = -np.inf
    upper[own] = -np.inf
    n = len(ids)
    probe = FIRST * k + 1  # one more: the query itself may be among them
    if n > probe:
        # estimates that came out high are mostly too high, so the floor comes from many more than k of them
        first = np.argpartition(-est, probe - 1, axis=1)[:, :probe]
        exact = np.einsum("qd,qkd->qk", queries, vectors[first]) * np.ldexp(1.0, exponent - exponent.max())[first]
        exact[np.take_along_axis(own, first, axis=1)] = -np.inf
        kth = np.sort(exact, axis=1)[:, -k]
        floor = np.where(np.isfinite(kth), kth - 1e-9 * np.abs(kth) - 1e-12 * length[:, 0] * size[first].max(axis=1), -np.inf)
        row, col = np.nonzero((upper >= floor[:, None]) & ~own)
    else:
        row, col = np.nonzero(~own)
    score = np.empty(len(row))
    edges = np.searchsorted(row, np.arange(len(queries) + 1))
    for q in range(len(queries)):
        part = slice(edges[q], edges[q + 1])
        score[part] = vectors[col[part]] @ queries[q]
    reranked = len(row)
    if n > probe:  # only what reaches the floor again can be among the k best
        good = np.ldexp(score, exponent[col] - exponent.max()) >= floor[row]
        row, col, score = row[good], col[good], score[good]
    cand = ids[col]
    score, power = np.frexp(score)
    power = power + exponent[col] + qexponent[row]
    order = best_first(row, cand, score, power)
    row, cand, score, power = row[order], cand[order], score[order], power[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[best], cand[best], score[best], power[best], reranked


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row whose id is divisible by ``every``, against all rows.

    Order and score hold at any finite magnitude: products beyond the range of
    doubles are compared exactly, though their score shows as infinite or 0.
    Defined cases: vectors that are null, empty, zero, or hold a null, NaN or
    infinity take no part, nor do rows without an id; vectors meet only others
    of their own length; rows that repeat an id are one candidate each, and each
    repeated query row of an id counts once (the first by its vector), its own
    id never a candidate; with fewer than k candidates all are returned; an
    empty table gives an empty result; extra columns are ignored.
    """
    bad = "exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0").filter(f"not {bad}").filter("exists(v, x -> x <> 0)").withColumn("dim", F.size("v"))
    asked = F.col("vec_id") % every == 0
    # one row a vector length: how many blocks of candidates and of queries it has
    blocks = cut(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(asked.cast("int")).alias("q")).select("dim", F.ceil(F.col("n") / CANDIDATE_ROWS).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("q") / QUERY_ROWS)).cast("int").alias("qblocks")))
    most = blocks.agg(F.max("blocks").alias("b")).first()["b"] or 0
    blocks = broadcast_if_small(blocks, F.lit(16))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v, exponent = scaled(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        codes, norm, f = encode(v, rotation(v.shape[1]))
        return pd.DataFrame({"dim": [v.shape[1]], "block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "exponent": [exponent.tobytes()], "codes": [codes.tobytes()], "norm": [norm.tobytes()], "f": [f.tobytes()]})

    # rows are numbered, so that repeated rows spread over blocks as others do
    place = F.xxhash64("vec_id", F.monotonically_increasing_id())
    coded = rows.withColumn("place", place).join(blocks, "dim").withColumn("block", F.pmod("place", "blocks").cast("int")).select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, vectors binary, exponent binary, codes binary, norm binary, f binary")

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"dim": [v.shape[1]], "qblock": [pdf["qblock"].iloc[0]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "qvectors": [v.tobytes()]})

    query = rows.filter(asked).groupBy("dim", "vec_id").agg(F.min("v").alias("v")).join(blocks, "dim").withColumn("qblock", F.pmod(F.xxhash64("vec_id"), "qblocks").cast("int"))
    query = query.select("dim", "qblock", "vec_id", "v").groupBy("dim", "qblock").applyInPandas(bundle, "dim int, qblock int, qids binary, qvectors binary")
    query = query.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "qblocks")

    def meet(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                qids, ids = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                q, v = np.frombuffer(r.qvectors).reshape(len(qids), -1), np.frombuffer(r.vectors).reshape(len(ids), -1)
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1)
                row, cand, score, power, _ = search(q, qids, v, ids, np.frombuffer(r.exponent, np.int64), codes, np.frombuffer(r.norm), np.frombuffer(r.f), k, epsilon)
                yield pd.DataFrame({"dim": [r.dim], "qblock": [r.qblock], "block": [r.block], "q": [qids[row].tobytes()], "c": [cand.tobytes()], "s": [score.tobytes()], "e": [power.tobytes()]})

    packed = "dim int, qblock int, block int, q binary, c binary, s binary, e binary"
    found = staged(query.join(staged(coded, "codes").hint("shuffle_hash"), ["dim", "block"]).mapInPandas(meet, packed), "found")

    def best(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        q, c, s, e = (np.concatenate([np.frombuffer(b, t) for b in pdf[x]]) for x, t in (("q", np.int64), ("c", np.int64), ("s", np.float64), ("e", np.int64)))
        order = best_first(q, c, s, e)
        q, c, s, e = q[order], c[order], s[order], e[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = rank < k
        return q[keep], rank[keep] + 1, c[keep], s[keep], e[keep]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        q, _, c, s, e = best(pdf)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "qblock": pdf["qblock"].iloc[:1], "block": pdf["block"].iloc[:1] // FAN, "q": [q.tobytes()], "c": [c.tobytes()], "s": [s.tobytes()], "e": [e.tobytes()]})

    while most > FAN:
        found = found.groupBy("dim", "qblock", (F.col("block") / FAN).cast("int").alias("g")).applyInPandas(lambda key, pdf: merge(pdf), packed)
        most = -(-most // FAN)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        q, rank, c, s, e = best(pdf)
        return pd.DataFrame({"query_id": q, "rank": rank.astype(np.int32), "vec_id": c, "score": np.ldexp(s, e)})

    return found.groupBy("dim", "qblock").applyInPandas(finish, "query_id long, rank int, vec_id long, score double")
