"""What is recorded beside queries: XML trees of screens as nodes and edges, screenshots' metadata, result files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = (
    "screen_id string, node_id string, parent_id string, pos int, text string, resource_id string, class string, "
    "clickable boolean, editable boolean, scrollable boolean, bounds array<double>, error string"
)
#: Attributes of a tree's elements by column; the first that is there counts.
TEXTS = {"text": ("text", "content-desc"), "resource_id": ("resource-id", "id"), "class": ("class",)}
FLAGS = ("clickable", "editable", "scrollable")


def _rows(screen: str, body: str) -> Iterator[tuple]:
    """Nodes depth-first; a node's id is its path of places from the root (0, 0.0, 0.1, ...)."""
    nothing = (None,) * 9
    if re.search("<!DOCTYPE|<!ENTITY", body, re.IGNORECASE):
        yield screen, *nothing, None, "document types are not read"
        return
    try:
        left = [(ElementTree.fromstring(body), "0", None, 0)]
    except (ElementTree.ParseError, ValueError) as wrong:
        yield screen, *nothing, None, str(wrong)
        return
    while left:
        node, name, parent, pos = left.pop()
        texts = [next((node.get(a) for a in names if node.get(a)), None) for names in TEXTS.values()]
        flags = [node.get(f) == "true" if node.get(f) is not None else None for f in FLAGS]
        box = [float(x) for x in re.findall(r"-?[0-9]+", node.get("bounds", ""))]
        yield screen, name, parent, pos, *texts, *flags, box if len(box) == 4 else None, None
        left += [(child, f"{name}.{i}", name, i) for i, child in reversed(list(enumerate(node)))]


def nodes(trees: DataFrame) -> DataFrame:
    """Nodes of XML trees (screen_id, xml); a tree that cannot be read is one row with the error. A task holds one tree at a time."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for screen, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(_rows(screen, body or ""))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.string()] * 3, *[pa.bool_()] * 3, pa.list_(pa.float64()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])

    return trees.select(F.col("screen_id").cast("string").alias("screen_id"), F.col("xml").cast("string").alias("xml")).mapInArrow(parse, NODES)


def load_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the XML files at a path; a screen is named by its file's whole path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("screen_id"), F.col("value").alias("xml"))
    return nodes(files)


#: What is no element in a page, its tags, and elements that hold nothing or end where the next of their kind begins.
NO_TAGS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = "<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>"
EMPTY_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ENDING_TAGS = ("li", "p")


def _elements(tags: list[str]) -> Iterator[tuple[str, str | None, int, str, int]]:
    """node_id, parent_id, pos, tag and ord (place among the tags) of a page's elements; an end tag without a start counts for nothing."""
    open_: list[list] = []  # path, tag, children so far
    roots = 0
    for at, tag in enumerate(tags):
        if tag.startswith("/"):
            name = tag[1:]
            last = next((i for i in reversed(range(len(open_))) if open_[i][1] == name), None)
            if last is not None:
                del open_[last:]
            continue
        if tag in ENDING_TAGS and open_ and open_[-1][1] == tag:
            open_.pop()
        above = open_[-1] if open_ else None
        pos = above[2] if above else roots
        path = f"{above[0]}.{pos}" if above else str(pos)
        if above:
            above[2] += 1
        else:
            roots += 1
        yield path, above[0] if above else None, pos, tag, at
        if tag not in EMPTY_TAGS:
            open_.append([path, tag, 0])


def html_nodes(pages: DataFrame) -> DataFrame:
    """Elements of web pages (screen_id, html) as nodes with tag and ord. A task holds one page's tags at a time."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]
        for batch in batches:
            for screen, tags in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := [(screen, *r) for r in _elements(tags)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["screen_id", "node_id", "parent_id", "pos", "tag", "ord"])

    bare = F.regexp_replace(F.coalesce("html", F.lit("")), NO_TAGS, "")
    tags = F.transform(F.regexp_extract_all(bare, F.lit(TAG), F.lit(1)), lambda t: F.lower(t))
    return pages.select(F.col("screen_id").cast("string").alias("screen_id"), tags.alias("tags")).mapInArrow(parse, "screen_id string, node_id string, parent_id string, pos int, tag string, ord int")


def edges(found: DataFrame) -> DataFrame:
    """screen_id, a, b, relation: child (a holds b) and next (b follows a under one parent)."""
    child = found.where("parent_id is not null").select("screen_id", F.col("parent_id").alias("a"), F.col("node_id").alias("b"), F.lit("child").alias("relation"))
    before = F.lag("node_id").over(Window.partitionBy("screen_id", "parent_id").orderBy("pos"))
    follows = found.where("parent_id is not null").select("screen_id", before.alias("a"), F.col("node_id").alias("b"), F.lit("next").alias("relation")).where("a is not null")
    return child.unionByName(follows)


def parent_context(found: DataFrame) -> DataFrame:
    """Each node with its parent's text and class."""
    above = found.select("screen_id", F.col("node_id").alias("parent_id"), F.col("text").alias("parent_text"), F.col("class").alias("parent_class"))
    return found.join(above, ["screen_id", "parent_id"], "left")


def row_context(found: DataFrame) -> DataFrame:
    """Each node with its place in its container from 0 (row_pos) and how many nodes that has (row_size); containers() has their texts."""
    row = Window.partitionBy("screen_id", "parent_id")
    return found.withColumns({"row_pos": F.row_number().over(row.orderBy("pos")) - 1, "row_size": F.count("*").over(row)})


def containers(found: DataFrame) -> DataFrame:
    """screen_id, parent_id and texts (in order) of each container: one row, however many nodes share it."""
    own = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))))
    return found.where("parent_id is not null").groupBy("screen_id", "parent_id").agg(F.transform(own, lambda x: x["text"]).alias("texts"))


def relations(found: DataFrame) -> DataFrame:
    """Edges with the layout of b against a: dx and dy between centers."""
    center = lambda side: found.select("screen_id", F.col("node_id").alias(side), *(((F.get("bounds", i) + F.get("bounds", i + 2)) / 2).alias(f"{side}{c}") for i, c in enumerate("xy")))
    met = edges(found).join(center("a"), ["screen_id", "a"]).join(center("b"), ["screen_id", "b"])
    return met.select("screen_id", "a", "b", "relation", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))


def screenshots(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and time of image files; their content is never read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


RESULT = "dataset string, artifact string, split string, matcher string, latency_setting string, correct long, total long, mean_ms double, p95_ms double"


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Recorded result files, each a JSON object or an array of them over several lines; fields that are missing are null."""
    return spark.read.schema(RESULT).option("multiLine", True).option("mode", "FAILFAST").json(path)
