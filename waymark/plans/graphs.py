"""Queries over trees: the elements of web pages as nodes of screens, against recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import graph
from waymark.plans.registry import query
from waymark.sources import bindings as B
from waymark.sources import screens

#: Edges between the anchor (a page's first link) and what counts as near it.
NEAR = 4

TREE = r"""RECURSIVE tok AS (
  SELECT CAST(page_id AS VARCHAR) AS screen_id, list_transform(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1), lambda t: lower(t)) AS tags FROM pages
),
run AS (
  SELECT screen_id, 0 AS i, CAST([] AS INTEGER[]) AS ids, CAST([] AS VARCHAR[]) AS names, CAST(NULL AS INTEGER) AS node, CAST(NULL AS INTEGER) AS parent, '' AS tag FROM tok
  UNION ALL
  SELECT screen_id, i + 1,
    CASE WHEN kind = 'end' THEN list_slice(ids, 1, back - 1) WHEN kind = 'empty' THEN ids ELSE list_append(base, i) END,
    CASE WHEN kind = 'end' THEN list_slice(names, 1, back - 1) WHEN kind = 'empty' THEN names ELSE list_append(base_names, t) END,
    CASE WHEN kind = 'end' THEN NULL ELSE i END, CASE WHEN kind = 'end' THEN NULL ELSE base[len(base)] END, t
  FROM (
    SELECT *, CASE WHEN closes THEN list_slice(ids, 1, len(ids) - 1) ELSE ids END AS base, CASE WHEN closes THEN list_slice(names, 1, len(names) - 1) ELSE names END AS base_names,
      CASE WHEN starts_with(t, '/') THEN 'end' WHEN t IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') THEN 'empty' ELSE 'start' END AS kind,
      CASE WHEN list_contains(names, substr(t, 2)) THEN len(names) - list_position(list_reverse(names), substr(t, 2)) + 1 ELSE len(names) + 1 END AS back
    FROM (SELECT run.screen_id, i, ids, names, tags[i + 1] AS t, tags[i + 1] IN ('li', 'p') AND len(names) > 0 AND names[len(names)] = tags[i + 1] AS closes FROM run JOIN tok ON tok.screen_id = run.screen_id WHERE i < len(tags))
  )
),
nodes AS (SELECT screen_id, node, parent, tag FROM run WHERE node IS NOT NULL),
anc AS (
  SELECT screen_id, node, node AS ancestor, 0 AS up FROM nodes
  UNION ALL
  SELECT anc.screen_id, anc.node, nodes.parent, up + 1 FROM anc JOIN nodes ON nodes.screen_id = anc.screen_id AND nodes.node = anc.ancestor WHERE nodes.parent IS NOT NULL
)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.by_screen(screens.html_nodes(B.table(spark, d, "pages").select(F.col("page_id").alias("screen_id"), "html")))


@query(f"""WITH {TREE},
depths AS (SELECT screen_id, node, max(up) AS depth FROM anc GROUP BY ALL),
anchors AS (SELECT screen_id, min(node) AS anchor FROM nodes WHERE tag = 'a' GROUP BY screen_id),
met AS (
  SELECT x.screen_id, anchor, b.node, b.ancestor, a.up AS own_up, b.up FROM anchors x JOIN anc a ON a.screen_id = x.screen_id AND a.node = anchor JOIN anc b ON b.screen_id = x.screen_id AND b.ancestor = a.ancestor
  QUALIFY row_number() OVER (PARTITION BY x.screen_id, b.node ORDER BY a.up + b.up) = 1
)
SELECT met.screen_id, met.node AS ord, tag, own_up + up AS distance, depth AS common_depth,
  CASE WHEN own_up + up = 0 THEN 'self' WHEN up = 0 THEN 'ancestor' WHEN own_up = 0 THEN 'descendant' WHEN own_up = 1 AND up = 1 THEN 'sibling' ELSE 'other' END AS relation
FROM met JOIN nodes ON nodes.screen_id = met.screen_id AND nodes.node = met.node JOIN depths ON depths.screen_id = met.screen_id AND depths.node = met.ancestor WHERE own_up + up <= {NEAR}""")
def graph_relations(spark: SparkSession, d: str) -> DataFrame:
    """Elements at most NEAR edges from the first link of their page: distance, depth of the lowest common ancestor and relation."""
    near = graph.around(_nodes(spark, d), F.col("tag") == "a", NEAR)
    return near.select("screen_id", "ord", "tag", "distance", graph.depth(F.col("ancestor_id")).alias("common_depth"), graph.relation(F.col("anchor_id"), F.col("node_id")).alias("relation"))


@query(f"""WITH {TREE}
SELECT nodes.screen_id, nodes.node AS ord, tag, count(*) - 1 AS n_below, max(up) AS height FROM anc JOIN nodes ON nodes.screen_id = anc.screen_id AND nodes.node = anc.ancestor GROUP BY ALL""")
def graph_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """How many elements are below each element of a page, and how deep they go."""
    return graph.subtrees(_nodes(spark, d), "tag", "ord").select("screen_id", "ord", "tag", "n_below", "height")
