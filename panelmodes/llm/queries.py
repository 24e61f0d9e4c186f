"""Queries of the llm operators with their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmodes.llm import match, mix, pack, similar, tokens, visual
from panelmodes.session import cut, table

# The tolerances of problem 3 and what counts as a real ratio.
TOLERANCES = {"share_grocery": 0.0012, "log_total": 0.008, "mob_logratio": 0.002}


def _profiles(spark: SparkSession, d: str) -> similar.BoxClusters:
    """Clusters of all records; a ratio that isn't real is unknown."""
    known = table(spark, d, "features_szfo_v2_final").withColumn("mob_logratio", F.when(F.expr("mob_logratio BETWEEN -2 AND 2"), F.col("mob_logratio")))
    return similar.BoxClusters(known, "feat_id", TOLERANCES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).isolated().select("first_id", F.col("id").alias("feat_id"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Every record's group; ``compared`` tells whether all three fields decided it or only the known ones."""
    return _profiles(spark, d).everyone().select(F.col("id").alias("feat_id"), F.col("cluster").alias("cluster_id"), "compared")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).medoids().select(F.col("cluster").alias("cluster_id"), "size", "typical", "spread")


def _matching(spark: SparkSession, d: str) -> match.Matching:
    return match.Matching(table(spark, d, "mo_cards"), table(spark, d, "mobility"), table(spark, d, "sdd_quarterly_szfo"))


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d).matches()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("mo_id", "area_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.sized(table(spark, d, "documents"))
    return pack.pack(cut(sizes), table(spark, d, "pack_limits"))


def p7_bins(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).drop("fill", "start_bin")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.packing_report(_packed(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.sized(table(spark, d, "documents"), keep=("source",))
    return mix.mix(cut(sizes), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(*_mix(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.look_alike_pairs(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual.visual_forms(table(spark, d, "documents")).select("doc_id", "form")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return visual.look_alike_classes(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_members, p3_clusters, p6_found, p6_matches, p7_bins, p7_report, p8_mix, p8_shares, p9_found, p9_forms, p9_classes)}

_REAL = "real AS (SELECT feat_id, round(share_grocery, 9) AS a, round(log_total, 9) AS b, round(mob_logratio, 9) AS c FROM features_szfo_v2_final WHERE mob_logratio BETWEEN -2 AND 2 AND NOT isnan(mob_logratio))"

_T = (1_200_000, 8_000_000, 2_000_000)
_NEAR = " AND ".join(f"abs({{0}}.x{i} - {{1}}.x{i}) <= {t}" for i, t in enumerate(_T))
_AWAY = " + ".join(f"abs({{0}}.x{i} - {{1}}.x{i}) / {t}.0::DOUBLE" for i, t in enumerate(_T))
# The pivots one after the other, in order of the hash: a point no pivot so far is similar to becomes one.
_PIVOTS = f"""every AS (SELECT feat_id AS id, round(share_grocery * 1e9)::BIGINT AS x0, round(log_total * 1e9)::BIGINT AS x1, CASE WHEN mob_logratio BETWEEN -2 AND 2 AND NOT isnan(mob_logratio) THEN round(mob_logratio * 1e9)::BIGINT END AS x2 FROM features_szfo_v2_final),
    pts AS (SELECT x0, x1, x2, min(id) AS id FROM every WHERE x2 IS NOT NULL GROUP BY 1, 2, 3), hashed AS (SELECT *, ('0x' || substr(md5('17-' || id), 1, 15))::BIGINT AS h FROM pts), ord AS (SELECT *, row_number() OVER (ORDER BY h, id) AS i FROM hashed),
    walk(i, pv) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x0 BIGINT, x1 BIGINT, x2 BIGINT)[] UNION ALL
      SELECT o.i, CASE WHEN len(list_filter(w.pv, lambda q: {_NEAR.format('q', 'o')})) = 0 THEN list_append(w.pv, {{'id': o.id, 'x0': o.x0, 'x1': o.x1, 'x2': o.x2}}) ELSE w.pv END FROM walk w JOIN ord o ON o.i = w.i + 1),
    pivots AS (SELECT ord.* FROM ord JOIN (SELECT unnest(pv).id AS id FROM walk WHERE i = (SELECT max(i) FROM walk)) USING (id)),
    chosen AS (SELECT p.id, arg_min(q.id, row({_AWAY.format('p', 'q')}, q.h, q.id)) AS pivot_id FROM pts p JOIN pivots q ON {_NEAR.format('p', 'q')} GROUP BY p.id),
    named AS (SELECT *, min(id) OVER (PARTITION BY pivot_id) AS cluster FROM chosen)"""

SQL: dict[str, str] = {
    # Groups as first members' neighbourhoods: all of a group's records have the same neighbours.
    "p3_found": f"""WITH {_REAL},
        near AS (SELECT x.feat_id AS i, y.feat_id AS j FROM real x JOIN real y ON abs(x.a - y.a) <= 0.0012000000001 AND abs(x.b - y.b) <= 0.0080000000001 AND abs(x.c - y.c) <= 0.0020000000001),
        hood AS (SELECT i, list_sort(list(j)) AS js FROM near GROUP BY i),
        grp AS (SELECT js, count(*) AS n, min(i) AS first_id FROM hood GROUP BY js HAVING count(*) = len(js) AND count(*) >= 4)
        SELECT first_id, unnest(js[2:]) AS feat_id FROM grp""",
    # Every record by its point, and those of unknown ratio by the first pivot of a cell of the two other fields.
    "p3_members": f"""WITH RECURSIVE {_PIVOTS}, cells AS (SELECT q.x0, q.x1, q.h, q.id, n.cluster, floor(q.x0 / {_T[0]})::BIGINT AS c0, floor(q.x1 / {_T[1]})::BIGINT AS c1 FROM pivots q JOIN named n USING (id)),
        firsts AS (SELECT c0, c1, arg_min(row(x0, x1, h, cluster), row(h, id)) AS f FROM cells GROUP BY 1, 2), flat AS (SELECT c0, c1, f[1] AS x0, f[2] AS x1, f[3] AS h, f[4] AS cluster FROM firsts),
        lone AS (SELECT e.id, arg_min(f.cluster, row(abs(e.x0 - f.x0) / {_T[0]}.0::DOUBLE + abs(e.x1 - f.x1) / {_T[1]}.0::DOUBLE, f.h, f.cluster)) AS cluster FROM every e JOIN flat f ON abs(e.x0 - f.x0) <= {_T[0]} AND abs(e.x1 - f.x1) <= {_T[1]}
          WHERE e.x2 IS NULL GROUP BY e.id)
        SELECT e.id AS feat_id, coalesce(n.cluster, l.cluster, e.id) AS cluster_id, e.x2 IS NOT NULL AS compared FROM every e LEFT JOIN pts p ON p.x0 = e.x0 AND p.x1 = e.x1 AND p.x2 = e.x2 LEFT JOIN named n ON n.id = p.id LEFT JOIN lone l ON l.id = e.id""",
}
