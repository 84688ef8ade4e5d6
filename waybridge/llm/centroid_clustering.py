"""Centroid clustering of integer vectors, with built-in expressions only.

A component x becomes the integer floor(64 x). Centroids are literal integer arrays inside the plan: ``zip_with``
and ``aggregate`` work out a vector's distance to each, ``array_min`` over (distance, cluster) structs takes the
nearest, and one column sum per component, folded inside every task before the shuffle, gives the next centroids. So a
round moves one row per task and cluster, whatever a cluster's share of all rows, and the driver sees the centroids only.

Defined cases: a vector that is null, has another number of components, or a null or non-finite one is left out.
Integers are held within ``MOST``, so a squared distance always fits a long (components below 2 ** 21 are exact); a sum
of distances that does not fit is null. A repeated row is one more vector; as a start, equal rows count once. Rows of one
vec_id with different vectors have one hash; the smaller vector comes first. A null vec_id has no hash, so it is
never a start. With fewer vectors than centroids each vector is a start. If there is no start, all results but vec_id
are null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from waybridge.llm.common import stored

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Largest absolute integer component: differences of 2 ** 28, squared and summed over 64, fit a long.
MOST = 1 << 27


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that are whole."""
    whole = (F.size("embedding") == dimensions) & F.forall(
        "embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    held = lambda x: F.greatest(F.lit(-MOST).cast("long"), F.least(
        F.lit(MOST).cast("long"), F.floor(x.cast("double") * F.lit(float(scale)))))
    return vectors.where(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", held).alias("v"))


def starts(vectors: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids.

    Hashes are spread evenly, so a threshold lets few rows through before anything is sorted; it is
    widened until enough of them are below.
    """
    hashed = vectors.select(
        F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), "v").where("hash is not null")
    n, wanted = vectors.count(), 4 * clusters
    while True:
        below = hashed if wanted >= n else hashed.where(F.col("hash") < f"{(wanted << 64) // n:016x}")
        found = below.distinct().orderBy("hash", "v").limit(clusters).collect()
        if len(found) == clusters or wanted >= n:
            return [list(r.v) for r in found]
        wanted *= 16


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in values])


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """(d, cluster) of the centroid next to a vector; of equally near ones the first. ``d`` lacks the vector's own square."""
    nothing = F.lit(0).cast("long")

    def distance(c: list[int]) -> Column:
        both = F.aggregate(F.zip_with(vector, _literal(c), lambda x, y: x * y), nothing, lambda s, p: s + p)
        return F.lit(sum(x * x for x in c)).cast("long") - both * 2

    return F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every vector to its centroid, every centroid that has vectors to their mean, rounded down."""
    size = len(centroids[0])
    assigned = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    sums = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(size)])
    out = list(centroids)
    for r in sums.collect():
        # one row per cluster
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
    return out


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> list[list[int]]:
    centroids = starts(vectors, clusters)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every integer vector."""
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    return vectors.select("vec_id", own.alias("own"), nearest(F.col("v"), centroids).alias("best")).select(
        "vec_id", F.col("best.cluster").alias("cluster"), (F.col("best.d") + F.col("own")).alias("distance"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Cluster and distance of every whole vector, the inertia of its cluster and of all, and its centroid's digest."""
    whole = stored(integers(vectors, dimensions, scale))
    centroids = fit(whole, clusters, rounds)
    if not centroids:
        return whole.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    assigned = stored(assign(whole, centroids))
    total = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}
    inertia = [total.get(k) for k in range(len(centroids))]
    every = None if None in total.values() or sum(total.values()) >> 63 else sum(total.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))
    return assigned.select(
        "vec_id", "cluster", "distance", of(inertia, "long").alias("cluster_inertia"),
        F.lit(every).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def _sql() -> str:
    parts = ["""
WITH whole AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
   AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64),
 flat AS MATERIALIZED (SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x
   FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM whole)),
 first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM whole),
 c0 AS MATERIALIZED (SELECT cluster, i, x FROM flat JOIN first USING (vec_id) WHERE cluster < 16)"""]
    for k in range(ROUNDS + 1):
        parts.append(f""",
 a{k} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM (
   SELECT f.vec_id, c.cluster, sum((f.x - c.x) * (f.x - c.x)) AS distance FROM flat f JOIN c{k} c USING (i) GROUP BY f.vec_id, c.cluster)
   QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if k < ROUNDS:
            parts.append(f""",
 c{k + 1} AS MATERIALIZED (SELECT o.cluster, o.i, coalesce((s - ((s % n) + n) % n) // n, o.x) AS x FROM c{k} o LEFT JOIN (
   SELECT cluster, i, sum(x) AS s, count(*) AS n FROM flat JOIN a{k} USING (vec_id) GROUP BY cluster, i) m USING (cluster, i))""")
    parts.append(f"""
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
 CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} a JOIN (SELECT cluster, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256
 FROM c{ROUNDS} GROUP BY cluster) d USING (cluster)
""")
    return "".join(parts)


SQL = _sql()
