"""Queries of the rankers that are trained here, and SQL that trains them too.

Candidates are the lines of an order. The right one is the line of most quantity after discount and tax
(the first of equals); the rankers see the three factors apart. They are fitted on the train
split and rank all orders. The SQL repeats each round as common table expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators import lambdamart, listwise
from waymark.operators.metrics import split_of
from waymark.plans.registry import query
from waymark.sources import bindings as B

FEATURES = ["l_quantity", "l_discount", "l_tax"]
CHARGED = "round(l_quantity * (1 - l_discount) * (1 + l_tax), 6)"

ROWS = f"""lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos,
    l_quantity AS x0, l_discount AS x1, l_tax AS x2, {CHARGED} AS charged FROM lineitem
),
labelled AS MATERIALIZED (
  SELECT query_id, pos, query_id || '-' || CAST(pos AS VARCHAR) AS candidate_id, x0, x1, x2,
    CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY charged DESC, pos) = 1 THEN 1 ELSE 0 END AS gold,
    CAST('0x' || substr(md5(query_id), 1, 8) AS BIGINT) % 10 < 8 AS train
  FROM lines
)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """query_id, pos, candidate_id, FEATURES and gold (1 or 0) of every line."""
    rows = B.order_candidates(spark, d, *FEATURES)
    order = Window.partitionBy("query_id").orderBy(F.expr(CHARGED).desc(), F.asc("pos"))
    return rows.select("query_id", "pos", "candidate_id", *FEATURES, (F.row_number().over(order) == 1).cast("int").alias("gold"))


def _train(rows: DataFrame) -> DataFrame:
    return rows.where(split_of(F.col("query_id")) == "train")


# --- trees ---------------------------------------------------------------------------


def _lambdamart_sql() -> str:
    m, n = lambdamart, len(FEATURES)
    ctes = [ROWS]
    ctes.append(f"ends AS MATERIALIZED (SELECT {', '.join(f'min(x{i}) AS low{i}, max(x{i}) AS high{i}' for i in range(n))} FROM labelled WHERE train)")
    cell = lambda i: f"CAST(greatest(least(floor((x{i} - low{i}) / (high{i} - low{i}) * {m.CELLS}), {m.CELLS - 1}), 0) AS INTEGER)"
    ctes.append(f"celled AS MATERIALIZED (SELECT labelled.*, {', '.join(f'{cell(i)} AS c{i}' for i in range(n))} FROM labelled, ends)")
    for i in range(n):
        ctes.append(f"""bins{i} AS MATERIALIZED (SELECT cell, CASE WHEN seen < total THEN CAST(seen * {m.BINS} // total AS INTEGER) ELSE {m.BINS - 1} END AS b{i} FROM (
  SELECT cell, CAST(coalesce(sum(k) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seen, CAST(sum(k) OVER () AS BIGINT) AS total
  FROM (SELECT range AS cell, coalesce(k, 0) AS k FROM range({m.CELLS}) LEFT JOIN (SELECT c{i}, count(*) AS k FROM celled WHERE train GROUP BY c{i}) ON c{i} = range)))""")
    joins = " ".join(f"JOIN bins{i} ON bins{i}.cell = c{i}" for i in range(n))
    bins = ", ".join(f"b{i}" for i in range(n))
    ctes.append(f"t0 AS MATERIALIZED (SELECT query_id, pos, candidate_id, gold, train, {bins}, 0e0 AS score FROM celled {joins})")
    for r in range(m.ROUNDS):
        units = lambda x: f"CAST(floor(({x}) * {m.UNIT} + 0.5) AS BIGINT)"
        gain = lambda x: f"({math.log(2)!r} / ln(1e0 + {x}))"
        ctes.append(f"""r{r} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM t{r}),
p{r} AS MATERIALIZED (SELECT *, 1e0 / (1e0 + exp(gs - score)) AS pull, abs({gain('gr')} - {gain('rank')}) AS ch FROM (
  SELECT *, max(CASE WHEN gold = 1 THEN score END) OVER (PARTITION BY query_id) AS gs, max(CASE WHEN gold = 1 THEN rank END) OVER (PARTITION BY query_id) AS gr FROM r{r})),
u{r} AS MATERIALIZED (SELECT *, {units('pull * ch')} AS lam, {units('pull * (1e0 - pull) * ch')} AS cur FROM p{r}),
n{r}_0 AS MATERIALIZED (SELECT query_id, pos, candidate_id, gold, train, {bins}, score, 1 AS node,
  CASE WHEN gold = 1 THEN coalesce(sum(CASE WHEN gold = 0 THEN lam END) OVER (PARTITION BY query_id), 0) ELSE -lam END AS g,
  CASE WHEN gold = 1 THEN coalesce(sum(CASE WHEN gold = 0 THEN cur END) OVER (PARTITION BY query_id), 0) ELSE cur END AS h FROM u{r})""")
        for level in range(m.DEPTH):
            own = f"{r}_{level}"
            each = " UNION ALL ".join(f"SELECT node, {i} AS f, b{i} AS b, g, h FROM n{own} WHERE train" for i in range(n))
            ratio = lambda g, h: f"CAST({g} AS DOUBLE) * CAST({g} AS DOUBLE) / CAST({h} + {m.RIDGE} AS DOUBLE)"
            ctes.append(f"""h{own} AS MATERIALIZED (SELECT node, f, b, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h, count(*) AS k FROM ({each}) GROUP BY node, f, b),
c{own} AS MATERIALIZED (SELECT node, f, b, CAST(sum(g) OVER w AS BIGINT) AS gl, CAST(sum(h) OVER w AS BIGINT) AS hl, sum(k) OVER w AS kl, CAST(sum(g) OVER v AS BIGINT) AS gt, CAST(sum(h) OVER v AS BIGINT) AS ht, sum(k) OVER v AS kt
  FROM h{own} WINDOW w AS (PARTITION BY node, f ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY node, f)),
s{own} AS MATERIALIZED (SELECT node, f, b, gl, hl, gt - gl AS gright, ht - hl AS hright FROM (
  SELECT *, {ratio('gl', 'hl')} + {ratio('(gt - gl)', '(ht - hl)')} - {ratio('gt', 'ht')} AS gain FROM c{own} WHERE kl >= {m.LEAST_ROWS} AND kt - kl >= {m.LEAST_ROWS})
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)""")
            pick = "CASE s.f " + " ".join(f"WHEN {i} THEN x.b{i}" for i in range(n)) + " END"
            ctes.append(f"n{r}_{level + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (node), 2 * x.node + CASE WHEN s.f IS NULL OR {pick} <= s.b THEN 0 ELSE 1 END AS node FROM n{own} x LEFT JOIN s{own} s ON s.node = x.node)")
        ctes.append(f"""l{r} AS MATERIALIZED (SELECT node, {m.RATE}e0 * (CAST(sum(g) AS DOUBLE) / CAST(sum(h) + {m.RIDGE} AS DOUBLE)) AS v FROM n{r}_{m.DEPTH} WHERE train GROUP BY node),
t{r + 1} AS MATERIALIZED (SELECT query_id, pos, candidate_id, gold, train, {bins}, score + coalesce(v, 0e0) AS score FROM n{r}_{m.DEPTH} x LEFT JOIN l{r} ON l{r}.node = x.node)""")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT query_id, candidate_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM t{m.ROUNDS}) WHERE r = 1"


@query(_lambdamart_sql())
def ranker_lambdamart(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each order by trees fitted to NDCG."""
    rows = candidates(spark, d)
    best = lambdamart.rank(rows, lambdamart.fit(_train(rows), FEATURES))
    return best.withColumn("score", F.round("score", 6))


# --- linear -----------------------------------------------------------------------------


def _listwise_ctes() -> str:
    m, n = listwise, len(FEATURES)
    ctes = [ROWS]
    ctes.append(f"ends AS MATERIALIZED (SELECT {', '.join(f'min(x{i}) AS low{i}, max(x{i}) AS high{i}' for i in range(n))} FROM labelled WHERE train)")
    scaled = ", ".join(f"(x{i} - low{i}) / (high{i} - low{i}) AS z{i}" for i in range(n))
    ctes.append(f"scaled AS MATERIALIZED (SELECT query_id, pos, candidate_id, gold, train, {scaled} FROM labelled, ends)")
    ctes.append(f"w0 AS MATERIALIZED (SELECT {', '.join(f'0e0 AS w{i}' for i in range(n))}, 0e0 AS loss)")
    units = lambda x: f"CAST(sum(CAST(floor(({x}) * {m.UNIT} + 0.5) AS BIGINT)) AS DOUBLE) / {m.UNIT} / k"
    for t in range(m.STEPS):
        total = "0e0" + "".join(f" + z{i} * w{i}" for i in range(n))
        new = ", ".join(f"any_value(w{i}) - {m.RATE}e0 * ({units(f'pull * z{i}')}) AS w{i}" for i in range(n))
        ctes.append(f"""a{t} AS MATERIALIZED (SELECT query_id, pos, gold, {', '.join(f'z{i}' for i in range(n))}, {total} AS s FROM scaled, w{t} WHERE train),
b{t} AS MATERIALIZED (SELECT *, max(s) OVER q AS top, max(CASE WHEN gold = 1 THEN s END) OVER q AS gs, max(CASE WHEN gold = 0 THEN s END) OVER q AS os,
  row_number() OVER (PARTITION BY query_id, gold ORDER BY s DESC, pos) AS place FROM a{t} WINDOW q AS (PARTITION BY query_id)),
c{t} AS MATERIALIZED (SELECT *, sum(exp(s - top)) OVER (PARTITION BY query_id) AS z, coalesce({m.MARGIN} - gs + os, 0e0) AS short FROM b{t}),
d{t} AS MATERIALIZED (SELECT *, exp(s - top) / z - gold + CASE WHEN short > 0 AND gold = 1 THEN -{m.LAMBDA_MARGIN}e0 WHEN short > 0 AND place = 1 THEN {m.LAMBDA_MARGIN}e0 ELSE 0e0 END AS pull,
  CASE WHEN gold = 1 THEN top + ln(z) - s + {m.LAMBDA_MARGIN}e0 * greatest(short, 0e0) END AS loss, (SELECT count(*) FROM c{t} WHERE gold = 1) AS k FROM c{t}),
w{t + 1} AS MATERIALIZED (SELECT {', '.join(f'w{i} AS w{i}' for i in range(n))}, loss FROM (SELECT {new}, {units('loss')} AS loss FROM (SELECT d{t}.*, {', '.join(f'w{i}' for i in range(n))} FROM d{t}, w{t}) GROUP BY k))""")
    return "WITH " + ",\n".join(ctes)


_LISTWISE = _listwise_ctes()
_LAST = f"w{listwise.STEPS}"


@query(f"{_LISTWISE}\nSELECT query_id, candidate_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS r FROM (SELECT query_id, pos, candidate_id, 0e0{''.join(f' + z{i} * w{i}' for i in range(len(FEATURES)))} AS s FROM scaled, {_LAST})) WHERE r = 1")
def ranker_listwise(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each order by a linear score fitted to the softmax and margin losses."""
    rows = candidates(spark, d)
    best = listwise.rank(rows, listwise.fit(_train(rows), FEATURES))
    return best.withColumn("score", F.round("score", 6))


@query(f"{_LISTWISE}\n" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(low{i}, 6) AS low, round(high{i}, 6) AS high, round(w{i}, 6) AS weight, round(loss, 6) AS last_loss FROM ends, {_LAST}" for i, f in enumerate(FEATURES)))
def listwise_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """The fitted weights, and the mean training loss before the last step."""
    model = listwise.fit(_train(candidates(spark, d)), FEATURES)
    rows = model.exported(spark).withColumn("last_loss", F.lit(model.losses[-1]))
    return rows.select("feature", *(F.round(c, 6).alias(c) for c in ("low", "high", "weight", "last_loss")))
