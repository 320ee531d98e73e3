"""Row types of queries, candidates and predictions, their JSON Lines form, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.sources.scratch import folder, save

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
#: bbox is an array in files: JSON arrays don't read into structs.
CANDIDATE_FILE = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("metadata", T.VariantType()),
    ]
)
QUERY_FILE = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("source", T.VariantType()),
        T.StructField("target_candidates", T.ArrayType(CANDIDATE_FILE)),
        T.StructField("gold_candidate_id", T.StringType()),
        T.StructField("metadata", T.VariantType()),
    ]
)
PREDICTION_FILE = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("selected_candidate_id", T.StringType()),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("metadata", T.VariantType()),
    ]
)
#: Named datasets; load_queries takes these names as well as paths.
REGISTRY: dict[str, str] = {}

CONCRETE, NULL, UNLABELED, AMBIGUOUS = "CONCRETE", "NULL", "UNLABELED", "AMBIGUOUS"


def bbox_struct(box: Column) -> Column:
    """Corners from an array of four; null for other lengths."""
    corners = F.struct(*(F.get(box, i).alias(f.name) for i, f in enumerate(BBOX)))
    return F.when(F.size(box) == 4, corners)


def load_queries(spark: SparkSession, source: str) -> DataFrame:
    """Queries from JSON Lines at a path or of a registered dataset; malformed lines raise.

    ord is the row's place by file name, then place in the file, however files are read. A gold id
    of null is an absent target, a line without the field is unlabeled, one with "ambiguous": true has no single target.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    lines = spark.read.text(REGISTRY.get(source, source)).where(F.trim("value") != "").select("value", F.struct(*place).alias("ord"))
    kinds = F.from_json("value", QUERY_FILE, {"mode": "FAILFAST"})
    rows = lines.select(kinds.alias("q"), F.parse_json("value").alias("v"), "ord").select("q.*", "ord", gold_given(F.col("v")).alias("labeled"), is_ambiguous(F.col("v")).alias("ambiguous"))
    boxed = F.transform(
        "target_candidates",
        lambda c: F.struct(c["candidate_id"].alias("candidate_id"), bbox_struct(c["bbox"]).alias("bbox"), c["metadata"].alias("metadata")),
    )
    kind = F.when(F.col("ambiguous"), AMBIGUOUS).otherwise(gold_kind(F.col("gold_candidate_id"), F.col("labeled")))
    gold = F.when(~F.col("ambiguous"), F.col("gold_candidate_id"))
    return rows.withColumns({"target_candidates": F.coalesce(boxed, F.array()), "gold_kind": kind, "gold_candidate_id": gold}).drop("labeled", "ambiguous")


def gold_given(row: Column) -> Column:
    """Whether a line (variant) has the gold field, be it null."""
    return F.variant_get(row, "$.gold_candidate_id", "variant").isNotNull()


def is_ambiguous(row: Column) -> Column:
    """Whether a line (variant) says that several candidates are as right as each other."""
    return F.coalesce(F.try_variant_get(row, "$.ambiguous", "boolean"), F.lit(False))


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_FILE).option("mode", "FAILFAST").json(path)


def gold_kind(gold: Column, labeled: Column | None = None) -> Column:
    """A gold id is concrete; without one the target is absent (NULL) if labeled, else unlabeled."""
    absent = F.lit(NULL) if labeled is None else F.when(labeled, NULL).otherwise(UNLABELED)
    return F.when(gold.isNotNull(), CONCRETE).otherwise(absent)


#: Rows in a compressed file at most: one task reads a whole one.
FILE_ROWS = 200_000


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Rows as JSON Lines, bbox structs as arrays; absent fields are left out but for the gold id, which is null unless unlabeled.

    `compression` is a codec of Spark's text files, such as gzip (at its fastest level); files then have FILE_ROWS rows at most.
    """
    options = {"compression": compression, "maxRecordsPerFile": FILE_ROWS, "zlib.compress.level": "BEST_SPEED"} if compression else {}
    if "target_candidates" in df.columns:
        flat = F.transform(
            "target_candidates",
            lambda c: F.struct(
                c["candidate_id"].alias("candidate_id"),
                F.when(c["bbox"].isNotNull(), F.array(*(c["bbox"][f.name] for f in BBOX))).alias("bbox"),
                c["metadata"].alias("metadata"),
            ),
        )
        df = df.withColumn("target_candidates", flat)
        kind = F.col("gold_kind") if "gold_kind" in df.columns else F.lit(NULL)
        line = F.to_json(F.struct(*(c for c in df.columns if c not in ("gold_kind", "ord")), F.when(kind == AMBIGUOUS, True).alias("ambiguous")))
        null = F.when(F.col("gold_candidate_id").isNull() & (kind != UNLABELED), F.concat(F.lit('{"gold_candidate_id":null,'), F.substring(line, F.lit(2), F.length(line))))
        df.select(F.coalesce(null, line)).write.mode("overwrite").options(**options).text(path)
        return
    df.write.mode("overwrite").options(**options).json(path)


def scratch_folder(spark: SparkSession) -> str:
    """The folder for files that a job writes for itself."""
    return folder(spark)


def validate_queries(queries: DataFrame, candidates: DataFrame, predictions: DataFrame) -> DataFrame:
    """Violations (query_id, violation): repeated candidate ids, a gold id or a selected id that is no candidate, repeated queries, predictions without a query. Drops nothing."""
    ids = candidates.select("query_id", "candidate_id")
    found = [
        (ids.groupBy("query_id", "candidate_id").count().where("count > 1").select("query_id"), "duplicate_candidate"),
        (queries.where("gold is not null").join(ids.withColumnRenamed("candidate_id", "gold"), ["query_id", "gold"], "left_anti").select("query_id"), "gold_not_candidate"),
        (queries.groupBy("query_id").count().where("count > 1").select("query_id"), "duplicate_query"),
        (predictions.where("selected is not null").join(ids.withColumnRenamed("candidate_id", "selected"), ["query_id", "selected"], "left_anti").select("query_id"), "selected_not_candidate"),
        (predictions.join(queries.select("query_id"), "query_id", "left_anti").select("query_id"), "unknown_query"),
    ]
    out = None
    for rows, name in found:
        part = rows.withColumn("violation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def validate_rows(queries: DataFrame) -> DataFrame:
    """validate_queries() of query rows that hold their candidates, without predictions.

    A row whose query_id no other row has is judged by itself; only rows of repeated ids are taken apart and shuffled.
    """
    ids = F.col("target_candidates.candidate_id")  # so that nothing else of a candidate is read
    rows = queries.select("query_id", F.col("gold_candidate_id").alias("gold"), ids.alias("ids"))
    twice = save(rows.groupBy("query_id").count().where("count > 1").select(F.col("query_id").alias("twice")))
    same = F.col("query_id").eqNullSafe(F.col("twice"))
    missing = F.col("gold").isNotNull() & (F.col("query_id").isNull() | ~F.coalesce(F.array_contains("ids", F.col("gold")), F.lit(False)))
    names = F.array(F.when(F.size(F.array_distinct("ids")) < F.size("ids"), "duplicate_candidate"), F.when(missing, "gold_not_candidate"))
    found = rows.join(twice, same, "left_anti").select("query_id", F.explode(F.array_compact(names)).alias("violation"))
    again = save(rows.join(twice, same, "left_semi"))
    nothing = queries.sparkSession.createDataFrame([], "query_id string, selected string")
    return found.unionByName(validate_queries(again, again.select("query_id", F.explode("ids").alias("candidate_id")), nothing))
