"""Centroid clustering by sort-means, in exact integer arithmetic.

A round assigns every vector to its nearest centroid and moves the centroids to the
floors of their vectors' means.  For the assignment, the other centroids are sorted by
their distance from each centroid, once a round; a vector scans them in the order of the
centroid that it was assigned to, and stops at the first one that lies strictly beyond
twice its distance from that one: by the triangle inequality this and all later ones are
farther away.  Vectors of one previous centroid scan together in numpy.  Previous
assignments travel with the vectors, whose table each round writes anew in the shared
folder (the one before is deleted then); sums and counts are one aggregate of k rows,
combined before the shuffle, and alone go to the driver.  Rounds that would repeat the
same centroids are skipped: nothing can change any more.

Edge cases: null vectors, those of another length and those with a null, NaN or infinite
component are left out.  Integers are clamped to +-2^27, so that a distance fits a long; an
inertia that does not is null.  Repeated ids or rows are vectors of their own; of equal
hashes the smaller vector comes first, and vectors without an id come last.  With fewer
than k vectors there are as many centroids; equal centroids go by their number.  Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, table

#: Integers lie within this bound, so that squared distances of 64 components fit a long.
BOUND = 1 << 27
#: Vectors whose distances are computed at once.
BLOCK = 8192


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    whole = lambda x: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x.cast("double") * scale))).cast("int")
    return F.transform(vector, whole)


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, all of them finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, finite), F.lit(False))


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of every row, by scans from the rows' previous centroids."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    cluster, distance = before.astype(np.int32), np.empty(len(x), np.int64)
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        gap = x[rows] - centroids[c]
        first = np.einsum("ij,ij->i", gap, gap)
        best, at = first.copy(), np.full(len(rows), c, np.int32)
        for other in order[c]:
            if other == c:
                continue
            live = np.flatnonzero(first >= -(-apart[c, other] // 4))  # no longer strictly beyond twice the distance
            if not len(live):
                break
            gap = x[rows[live]] - centroids[other]
            d = np.einsum("ij,ij->i", gap, gap)
            closer = live[(d < best[live]) | ((d == best[live]) & (other < at[live]))]
            best[closer], at[closer] = d[np.searchsorted(live, closer)], other
        cluster[rows], distance[rows] = at, best
    return cluster, distance


def _assigned(vectors: DataFrame, centroids: np.ndarray, *keep: str) -> DataFrame:
    """The columns ``keep`` of every vector, with its cluster and distance among the centroids."""
    kinds = dict(vectors.dtypes)

    def run(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(-1, centroids.shape[1])
            before = b.column("cluster").to_numpy()
            parts = [nearest(x[i : i + BLOCK].astype(np.int64), before[i : i + BLOCK], centroids) for i in range(0, len(x), BLOCK)]
            cluster, distance = (np.concatenate(p) if parts else np.zeros(0, np.int64) for p in (zip(*parts) if parts else ((), ())))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], [*keep, "cluster", "distance"]
            )

    return vectors.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", cluster int, distance long")


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids moved to the floors of their vectors' means; those without vectors stay."""
    sums = vectors.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():  # a row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def sort_means(df: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    spark = df.sparkSession
    rows = df.where(usable(df[vector_col], dim)).select(df[id_col].alias("vec_id"), integers(df[vector_col], scale).alias("v"), F.lit(0).alias("cluster"))
    vectors = stored(rows, "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("v").orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(first) else 0):
        after = stored(_assigned(vectors, centroids, "vec_id", "v").select("vec_id", "v", "cluster"), "vectors")
        dropped(vectors)
        vectors, before, centroids = after, centroids, _moved(after, centroids)
        if np.array_equal(before, centroids):
            break
    final = stored(_assigned(vectors, centroids, "vec_id"), "clusters")
    dropped(vectors)
    inertia = {r["cluster"]: int(r["d"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a centroid
    fits = lambda n: n if n < 1 << 63 else None
    whole = fits(sum(inertia.values()))
    named = [(c, fits(d), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    told = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_centroid_clustering(spark, sf_dir):
    """Query op12: the vectors of ``embeddings`` in 8 clusters after 10 rounds."""
    return sort_means(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """The rounds as common table expressions: c<r> are centroids, a<r> assignments."""
    assign = (
        "a{r} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(k, [d, k]) AS k, min(d) AS d FROM (SELECT n, vec_id, kept.v, k, "
        "CAST(list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r}) GROUP BY n)"
    )
    move = (
        "c{s} AS MATERIALIZED (SELECT c{r}.k, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT k, list(CAST((s - (s % t + t) % t) // t AS BIGINT) ORDER BY i) AS v FROM "
        "(SELECT k, i, sum(v[i]) AS s, count(*)::HUGEINT AS t FROM a{r}, range(1, 65) AS g(i) GROUP BY k, i) GROUP BY k) AS m ON m.k = c{r}.k)"
    )
    return ", ".join(f"{assign.format(r=r)}, {move.format(r=r, s=r + 1)}" for r in range(rounds)) + ", " + assign.format(r=rounds)


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM (SELECT * FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT 8)),
{_rounds_sql(10)},
i AS (SELECT k, sum(d) AS ci FROM a10 GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(ci AS BIGINT) AS cluster_inertia, CAST((SELECT sum(ci) FROM i) AS BIGINT) AS inertia,
  sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM a10 JOIN i USING (k) JOIN c10 USING (k)
"""
