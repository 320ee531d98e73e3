"""Queries of what a user calls: imported rows, their features, the ranker over them, evaluation and reports at every level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import features as X
from waymark.operators import losses, metrics, rank, sketches, structured
from waymark.plans import jobs
from waymark.plans.catalog import ABSTAIN, CAND, GOLD, LAMBDA_MARGIN, LAMBDA_PATCH, LOSS, MARGIN_LOSS, SPLIT, _abstaining, _best, _box, _jaccard_sql, _orders, _rounded, _scored
from waymark.plans.registry import query
from waymark.sources import bindings as B
from waymark.sources import schema, screens
from waymark.sources.scratch import drop, place

# --- structured rows ------------------------------------------------------------------

#: Size of the screen that the boxes of lines lie on.
SCREEN = (1.5, 1.0)

ROWS = f"""{CAND},
el AS (
  SELECT query_id, pos, candidate_id, p_name AS text, p_brand || '/' || p_type AS ident, p_type AS kind, l_returnflag || ' ' || l_linestatus AS parent, l_returnflag = 'A' AS clickable, l_linestatus = 'O' AS editable, l_quantity > 25 AS scrollable,
    l_quantity / 60.0 / {SCREEN[0]} AS x0, (pos - 1) / 10.0 / {SCREEN[1]} AS y0, (l_quantity / 60.0 + 0.2) / {SCREEN[0]} AS x1, pos / 10.0 / {SCREEN[1]} AS y1, l_extendedprice
  FROM cand JOIN part ON p_partkey = l_partkey
),
src AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) = 1),
met AS (
  SELECT c.query_id, c.pos, c.candidate_id, c.l_extendedprice,
    {_jaccard_sql("string_split(s.text, ' ')", "string_split(c.text, ' ')")} AS text_overlap, 1 - levenshtein(s.text, c.text) * 1e0 / greatest(length(s.text), length(c.text)) AS text_likeness,
    {_jaccard_sql("string_split_regex(s.ident, '[_/:#]')", "string_split_regex(c.ident, '[_/:#]')")} AS id_overlap, CASE WHEN s.kind = c.kind THEN 1e0 ELSE 0e0 END AS same_class,
    {_jaccard_sql("string_split(s.parent, ' ')", "string_split(c.parent, ' ')")} AS parent_overlap,
    CASE WHEN s.clickable = c.clickable THEN 1e0 ELSE 0e0 END AS clickable, CASE WHEN s.editable = c.editable THEN 1e0 ELSE 0e0 END AS editable, CASE WHEN s.scrollable = c.scrollable THEN 1e0 ELSE 0e0 END AS scrollable,
    greatest(least(s.x1, c.x1) - greatest(s.x0, c.x0), 0e0) * greatest(least(s.y1, c.y1) - greatest(s.y0, c.y0), 0e0) AS shared, (s.x1 - s.x0) * (s.y1 - s.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS areas,
    CASE WHEN least(floor((s.y0 + s.y1) / 2 * 3), 2) * 3 + least(floor((s.x0 + s.x1) / 2 * 3), 2) = least(floor((c.y0 + c.y1) / 2 * 3), 2) * 3 + least(floor((c.x0 + c.x1) / 2 * 3), 2) THEN 1e0 ELSE 0e0 END AS same_region,
    sqrt(pow((s.x0 + s.x1) / 2 - (c.x0 + c.x1) / 2, 2) + pow((s.y0 + s.y1) / 2 - (c.y0 + c.y1) / 2, 2)) AS distance
  FROM el c JOIN src s USING (query_id)
),
feat AS (SELECT *, shared / (areas - shared) AS box_overlap FROM met),
scored AS (SELECT *, {" + ".join(f"{name} * {weight}e0" for name, weight in structured.WEIGHTS.items())} AS score FROM feat)"""
NAMES = list(structured.WEIGHTS)


def queries_of(spark: SparkSession, d: str, free: Callable[[Column], Column] = F.to_variant_object) -> DataFrame:
    """Orders as query rows: parts are elements, the first one is the source; gold is the dearest line.

    Lines get their parts before they are numbered, so the shuffle that numbers them is also that of the one grouping which
    makes source, candidates and gold. A part's rows travel as one list: a key that repeats doesn't change how lines are numbered.
    `free` makes sources and metadata of structs.
    """
    part = B.table(spark, d, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.collect_list(F.struct("p_name", "p_brand", "p_type")).alias("parts"))
    lines = B.order_candidates(spark, d, "parts", "l_returnflag", "l_linestatus", "l_quantity", lines=B.table(spark, d, "lineitem").join(part, "l_partkey", "left"))
    lines = lines.where("query_id is not null").withColumn("part", F.explode("parts")).withColumn("bbox", _box())
    own = {
        "text": F.col("part.p_name"), "resource_id": F.concat_ws("/", "part.p_brand", "part.p_type"), "class": F.col("part.p_type"), "parent": F.concat_ws(" ", "l_returnflag", "l_linestatus"),
        "clickable": F.col("l_returnflag") == "A", "editable": F.col("l_linestatus") == "O", "scrollable": F.col("l_quantity") > 25,
    }
    rows = lines.select("query_id", "pos", "candidate_id", "l_extendedprice", "bbox", F.struct(*(c.alias(n) for n, c in own.items())).alias("own"))
    listed, gold = F.sort_array(F.collect_list(F.struct("pos", "candidate_id", "bbox", "own"))), F.max_by("candidate_id", F.struct("l_extendedprice", -F.col("pos")))
    nested = rows.groupBy("query_id").agg(listed.alias("c"), gold.alias("gold_candidate_id")).withColumn("first", F.get("c", 0))
    box = F.array(*(F.col("first.bbox")[c] for c in ("x0", "y0", "x1", "y1")))
    source = free(F.struct("first.own.*", box.alias("bbox"), F.array(*map(F.lit, SCREEN)).alias("screen")))
    candidates = F.transform("c", lambda c: F.struct(c["candidate_id"].alias("candidate_id"), c["bbox"].alias("bbox"), free(c["own"]).alias("metadata")))
    return nested.select("query_id", source.alias("source"), candidates.alias("target_candidates"), "gold_candidate_id")


@query(f"WITH {ROWS} SELECT query_id, candidate_id, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM feat")
def structured_features(spark: SparkSession, d: str) -> DataFrame:
    """structured.pair_features() over query rows."""
    fractions = [n for n in NAMES if n not in structured.YES_OR_NO]  # rounding goes through decimal text
    return _rounded(structured.pair_features(queries_of(spark, d)).drop("pos"), *fractions)


@query(f"""WITH {ROWS}, n AS (SELECT query_id, count(*) AS n_scores, round(max(score), 6) AS best FROM scored GROUP BY query_id)
SELECT query_id, candidate_id AS selected, n_scores, best FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) = 1) JOIN n USING (query_id)""")
def structured_predictions(spark: SparkSession, d: str) -> DataFrame:
    """StructuredRanker.predict() over query rows."""
    made = structured.StructuredRanker().predict(queries_of(spark, d))
    return made.select("query_id", F.col("selected_candidate_id").alias("selected"), F.size("scores").cast("long").alias("n_scores"), F.round(F.array_max(F.map_values("scores")), 6).alias("best"))


@query(f"""WITH {ROWS}, best AS (SELECT query_id, candidate_id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) = 1),
gold AS (SELECT query_id, candidate_id AS gold FROM el QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY l_extendedprice DESC, pos) = 1),
c AS (SELECT count(*) FILTER (WHERE candidate_id = gold) AS correct, count(*) AS total FROM best JOIN gold USING (query_id))
SELECT 'orders' AS dataset, 'parts' AS artifact, 'all' AS split, 'structured' AS matcher, 'cold' AS latency_setting, CAST(2 * correct AS BIGINT) AS correct, CAST(2 * total AS BIGINT) AS total, CAST(0 AS BIGINT) AS gold_null,
  CAST(2 * (total - correct) AS BIGINT) AS wrong_target, round((total - correct) * 1e0 / total, 6) AS wrong_target_rate, printf('%.2f%%', 100.0 * CAST(correct AS DOUBLE) / total) AS top1, CAST(0 AS BIGINT) AS violations FROM c""")
def jobs_report(spark: SparkSession, d: str) -> DataFrame:
    """Query rows written as JSON Lines, imported, evaluated with the structured ranker twice, and summarized."""
    path, out = place(spark, "rows"), place(spark, "imported")
    schema.write_jsonl(queries_of(spark, d, lambda row: row), path, "gzip")  # structs: a variant starts a JSON writer for each of its strings
    violations = jobs.import_dataset(spark, path, out).agg(F.count("*").alias("violations"))
    drop(spark, path)  # all that follows reads what was imported
    queries = spark.read.parquet(out)
    report = jobs.evaluate(queries, structured.StructuredRanker(), "orders", "all", "structured", "parts", "cold")
    total = jobs.summarize([report, report]).withColumn("violations", violations.scalar())
    return total.select(*jobs.KEY, "correct", "total", "gold_null", "wrong_target", F.round("wrong_target_rate", 6).alias("wrong_target_rate"), "top1", "violations")


# --- reports ------------------------------------------------------------------------

KEYS = ["artifact", "split", "matcher", "latency_setting"]


@query(f"""WITH {CAND}, {GOLD},
best AS (SELECT query_id, candidate_id FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) = 1),
made AS (SELECT query_id, 'linear' AS matcher, candidate_id AS selected FROM best UNION ALL SELECT query_id, 'first', candidate_id FROM cand WHERE pos = 1),
facts AS (
  SELECT o_orderstatus AS artifact, {SPLIT.replace("s < 8", "slot < 8").replace("s = 8", "slot = 8")} AS split, matcher, o_orderpriority AS latency_setting, gold, selected
  FROM (SELECT *, CAST('0x' || substr(md5(query_id), 1, 8) AS BIGINT) % 10 AS slot FROM made JOIN q USING (query_id) JOIN orders ON CAST(o_orderkey AS VARCHAR) = query_id)
)
SELECT artifact, split, matcher, latency_setting, CAST(grouping_id(artifact, split, matcher, latency_setting) AS BIGINT) AS level, count(*) AS queries, count(gold) AS positives, count(*) FILTER (WHERE selected = gold) AS correct,
  round(coalesce(count(*) FILTER (WHERE selected = gold) * 1e0 / nullif(count(gold), 0), 0e0), 6) AS top1
FROM facts GROUP BY CUBE (artifact, split, matcher, latency_setting)""")
def report_levels(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of two matchers by every subset of artifact (order status), split, matcher and latency setting (order priority)."""
    candidates, queries = _orders(spark, d)
    made = _best(candidates).select("query_id", F.lit("linear").alias("matcher"), "selected")
    made = made.unionByName(candidates.where("pos = 1").select("query_id", F.lit("first").alias("matcher"), F.col("candidate_id").alias("selected")))
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("query_id"), F.col("o_orderstatus").alias("artifact"), F.col("o_orderpriority").alias("latency_setting"))
    one = lambda c: c.cast("long")
    facts = made.join(queries, "query_id").join(orders, "query_id").select(
        "artifact", metrics.split_of(F.col("query_id")).alias("split"), "matcher", "latency_setting", F.lit(1).cast("long").alias("queries"),
        one(F.col("gold").isNotNull()).alias("positives"), F.coalesce(one(F.col("selected") == F.col("gold")), F.lit(0)).alias("correct"),
    )
    levels = metrics.report_levels(facts, KEYS, ["queries", "positives", "correct"])
    return levels.withColumn("top1", F.round(F.coalesce(F.try_divide("correct", "positives"), F.lit(0.0)), 6))


@query("""SELECT event_type, count(value) AS n, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.95), 6) AS p95_ms, true AS p95_within, true AS users_within FROM events GROUP BY event_type""")
def latency_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Percentile and users of each event type from sketches by day, and whether they are within their bounds of the exact ones."""
    events = B.table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value", "user_id")
    by_day = sketches.sketched(events, ["event_type", "day"], "value", "user_id")
    found = sketches.estimates(sketches.merged(by_day, ["event_type"]), ["event_type"], 0.95)
    met = events.join(F.broadcast(found.select("event_type", "quantile")), "event_type")  # a row for each type
    exact = met.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95_ms"),
        F.avg((F.col("value") <= F.col("quantile")).cast("double")).alias("up_to"), F.avg((F.col("value") < F.col("quantile")).cast("double")).alias("below"),
    )
    error = sketches.RANK_ERROR
    within = (F.col("up_to") >= 0.95 - error) & (F.col("below") <= 0.95 + error)
    near = F.abs(F.col("n_who") - F.col("users")) <= F.ceil(F.col("users") * sketches.DISTINCT_ERROR)
    return found.join(exact, "event_type").select("event_type", "n", "users", "p95_ms", within.alias("p95_within"), near.alias("users_within"))


UNCLEAR = 0.01


@query(f"""WITH {CAND}, {GOLD}, {ABSTAIN},
two AS (SELECT query_id, max(l_extendedprice) AS p1, max(l_extendedprice) FILTER (WHERE r = 2) AS p2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l_extendedprice DESC, pos) AS r FROM cand) GROUP BY query_id),
k AS (SELECT q.query_id, gold, selected, coalesce(p2 >= p1 * (1 - {UNCLEAR}e0), false) AS unclear FROM q JOIN sel USING (query_id) LEFT JOIN two USING (query_id)),
c AS (SELECT count(*) FILTER (WHERE gold IS NOT NULL AND NOT unclear) AS gold_concrete, count(*) FILTER (WHERE gold IS NULL) AS gold_null, count(*) FILTER (WHERE unclear) AS gold_ambiguous,
  count(*) FILTER (WHERE gold IS NULL AND selected IS NOT NULL) AS false_positive, count(*) FILTER (WHERE gold IS NULL AND selected IS NULL) AS abstain_right, count(*) FILTER (WHERE unclear AND selected IS NULL) AS ambiguous_abstained,
  count(*) FILTER (WHERE NOT unclear AND selected <> gold) AS wrong_target FROM k)
SELECT *, round(coalesce((abstain_right + ambiguous_abstained) * 1e0 / nullif(gold_null + gold_ambiguous, 0), 0e0), 6) AS abstain_accuracy FROM c""")
def safety_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Safety counts where orders whose two dearest lines differ by UNCLEAR at most are ambiguous."""
    queries, selected = _abstaining(spark, d)
    order = Window.partitionBy("query_id").orderBy(F.desc("l_extendedprice"), F.asc("pos"))
    placed = _orders(spark, d)[0].withColumn("r", F.row_number().over(order))
    two = placed.groupBy("query_id").agg(F.max("l_extendedprice").alias("p1"), F.max(F.when(F.col("r") == 2, F.col("l_extendedprice"))).alias("p2"))
    unclear = F.coalesce(F.col("p2") >= F.col("p1") * (1 - UNCLEAR), F.lit(False))
    marked = queries.join(two, "query_id", "left").withColumn("gold_kind", F.when(unclear, schema.AMBIGUOUS).otherwise(schema.gold_kind(F.col("gold"))))
    marked = marked.select("query_id", "ord", F.when(F.col("gold_kind") == schema.CONCRETE, F.col("gold")).alias("gold"), "gold_kind")
    counts, rates = metrics.safety_counts(marked, selected), metrics.safety_rates(marked, selected)
    out = counts.withColumn("abstain_accuracy", F.round(rates.select("abstain_accuracy").scalar(), 6))
    return out.select("gold_concrete", "gold_null", "gold_ambiguous", "false_positive", "abstain_right", "ambiguous_abstained", "wrong_target", "abstain_accuracy")


# --- proposal and masks ------------------------------------------------------------------


@query("""WITH l AS (SELECT page_id, unnest(range(0, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos FROM pages)
SELECT CAST(page_id AS VARCHAR) AS screen_id, '0.' || CAST(pos AS VARCHAR) AS node_id FROM l WHERE pos % 2 = 0 AND pos * 10 < 30""")
def proposal_layer(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from trees: elements that can be acted on and lie on a screen of 30 by 200."""
    at = F.col("pos") * 10
    node = F.concat(F.lit('<node clickable="'), (F.col("pos") % 2 == 0).cast("string"), F.lit('" bounds="['), at.cast("string"), F.lit(",0]["), (at + 10).cast("string"), F.lit(',20]"/>'))
    links = B.links(spark, d).select("page_id", F.struct("pos", node.alias("node")).alias("n"))
    inside = F.concat_ws("", F.transform(F.array_sort(F.collect_list("n")), lambda x: x["node"]))
    trees = links.groupBy(F.col("page_id").alias("screen_id")).agg(F.concat(F.lit('<node bounds="[0,0][30,200]">'), inside, F.lit("</node>")).alias("xml"))
    plausible = X.actionable(F.col("clickable"), F.col("editable"), F.col("scrollable")) & X.visible(F.col("bounds"), F.lit(30), F.lit(200))
    return rank.propose(screens.nodes(trees), plausible).select("screen_id", "node_id")


PATCHES = 4
_CENTER = f"(({{}} + 0.5) / {PATCHES})"


@query(f"""{LOSS},
pr AS (SELECT query_id, candidate_id, gold, pos, l_quantity / 60.0 AS x0, (pos - 1) / 10.0 AS y0, l_quantity / 60.0 + 0.2 AS x1, pos / 10.0 AS y1, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY query_id) AS p FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM sc)),
hit AS (SELECT query_id, py, px, candidate_id = gold AS own, p, {_CENTER.format('px')} BETWEEN x0 AND x1 AND {_CENTER.format('py')} BETWEEN y0 AND y1 AS held FROM pr, (SELECT unnest(range({PATCHES})) AS px), (SELECT unnest(range({PATCHES})) AS py)),
patches AS (SELECT query_id, py, px, 0.01 + 0.98 * least(sum(CASE WHEN held THEN p ELSE 0e0 END), 1e0) AS heat, max(CASE WHEN held AND own THEN 1e0 ELSE 0e0 END) AS g FROM hit GROUP BY ALL),
patch AS (SELECT query_id, avg(-(g * ln(heat) + (1 - g) * ln(1 - heat))) AS loss FROM patches GROUP BY query_id)
SELECT query_id, round(lc.loss + {LAMBDA_PATCH} * patch.loss + {LAMBDA_MARGIN} * lm.loss, 6) AS loss FROM lc JOIN lm USING (query_id) JOIN patch USING (query_id)""")
def loss_masks(spark: SparkSession, d: str) -> DataFrame:
    """The whole loss where every query has a patch mask: the heat of its candidates' boxes against the gold box."""
    candidates, _ = _orders(spark, d, "l_quantity")
    scored = B.with_gold(candidates).withColumn("bbox", _box())
    parts = losses.candidate_loss(_scored(spark, d)), losses.patch_loss(losses.patch_masks(scored, PATCHES)), losses.margin_loss(scored, MARGIN_LOSS)
    return _rounded(losses.total_loss(*parts, LAMBDA_PATCH, LAMBDA_MARGIN), "loss")
