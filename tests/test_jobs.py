"""Files in, report out."""

import json
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import waymark
from waymark.functions import features
from waymark.operators import losses, metrics, rank, sketches
from waymark.operators.structured import YES_OR_NO, StructuredRanker, pair_features
from waymark.plans import jobs, registry, reports
from waymark.sources import schema, screens


def element(text="", ident="", kind="", clickable=True, **more):
    return {"text": text, "resource_id": ident, "class": kind, "clickable": clickable, **more}


ROWS = [
    {
        "query_id": "q1", "source": element("Save file", "app:id/save", "Button", bbox=[0, 0, 100, 50], screen=[400, 800]), "gold_candidate_id": "b",
        "target_candidates": [
            {"candidate_id": "a", "bbox": [0, 0, 100, 50], "metadata": element("Cancel", "app:id/cancel", "Button")},
            {"candidate_id": "b", "bbox": [100, 0, 200, 50], "metadata": element("Save the file", "app:id/save", "Button")},
        ],
    },
    {"query_id": "q2", "source": {}, "target_candidates": [{"candidate_id": "x", "metadata": {}}, {"candidate_id": "y", "bbox": None, "metadata": {}}], "gold_candidate_id": "y"},
    {"query_id": "q3", "source": element("Open"), "target_candidates": [], "gold_candidate_id": None},
]


def written(tmp_path, rows):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_import_evaluate_summarize(spark, tmp_path):
    schema.REGISTRY["tiny"] = written(tmp_path, ROWS)
    assert jobs.import_dataset(spark, "tiny", str(tmp_path / "out")).count() == 0
    queries = spark.read.parquet(str(tmp_path / "out"))
    made = StructuredRanker().predict(queries)
    assert {r["query_id"]: r["selected_candidate_id"] for r in made.collect()} == {"q1": "b", "q2": "x"}
    assert {r["query_id"]: set(r["scores"]) for r in made.collect()} == {"q1": {"a", "b"}, "q2": {"x", "y"}}
    report = jobs.evaluate(queries, StructuredRanker(), "tiny", "test", "structured")
    assert (report.first()["correct"], report.first()["total"]) == (1, 2)
    total = jobs.summarize([report, report]).first()
    assert (total["dataset"], total["correct"], total["total"], total["top1"]) == ("tiny", 2, 4, "50.00%")


def test_order_of_rows_does_not_depend_on_the_sizes_of_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, n in (("a", 1), ("b", 400), ("c", 3)):
        rows = [{"query_id": f"{name}{i}", "target_candidates": [], "gold_candidate_id": None} for i in range(n)] + [{"query_id": "same", "target_candidates": [], "gold_candidate_id": name}]
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    queries = schema.load_queries(spark, str(folder))
    assert [r["query_id"][0] for r in queries.where("query_id like '%0' or query_id like '%1'").orderBy("ord").collect()] == sorted(r["query_id"][0] for r in queries.where("query_id like '%0' or query_id like '%1'").collect())
    made = spark.createDataFrame([("same", "c")], "query_id string, selected string")
    assert metrics.top1_code(queries.withColumnRenamed("gold_candidate_id", "gold"), made).first()["correct"] == 1


def test_unlabeled_queries_are_no_absent_targets(spark, tmp_path):
    rows = [{"query_id": "n", "target_candidates": [], "gold_candidate_id": None}, {"query_id": "u", "target_candidates": []}, {"query_id": "c", "target_candidates": [], "gold_candidate_id": "x"}]
    queries = schema.load_queries(spark, written(tmp_path, rows))
    assert {r["query_id"]: r["gold_kind"] for r in queries.collect()} == {"n": "NULL", "u": "UNLABELED", "c": "CONCRETE"}
    schema.write_jsonl(queries, str(tmp_path / "again"))
    assert {r["query_id"]: r["gold_kind"] for r in schema.load_queries(spark, str(tmp_path / "again")).collect()} == {"n": "NULL", "u": "UNLABELED", "c": "CONCRETE"}
    made = spark.createDataFrame([("n", "x", {}), ("u", "x", {}), ("c", "x", {})], "query_id string, selected_candidate_id string, scores map<string,double>")
    row = jobs.evaluate(queries, made, "tiny", "test", "m").first()
    assert (row["correct"], row["total"], row["gold_null"], row["false_positive"], row["false_positive_rate"]) == (1, 1, 1, 1, 1.0)


def test_external_models_and_latency(spark, tmp_path):
    def model(batches):
        for batch in batches:
            ids = [[c["candidate_id"] for c in json.loads(x)] for x in batch["candidates"]]
            yield batch[["query_id"]].assign(selected_candidate_id=[i[-1] if i else None for i in ids], scores=[dict.fromkeys(i, 1.0) for i in ids])

    queries = schema.load_queries(spark, written(tmp_path, ROWS))
    took = spark.createDataFrame([(1.0,), (3.0,)], "ms double")
    report = jobs.evaluate(queries, jobs.external(model), "tiny", "test", "last", "a.json", "warm", took)
    total = jobs.summarize([report]).first()
    assert (total["correct"], total["total"], total["abstain_accuracy"], total["mean_ms"], total["latency_setting"], total["artifact"]) == (2, 2, 1.0, 2.0, "warm", "a.json")


def test_trees_screenshots_and_results(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s1.xml").write_text('<hierarchy><node text="List" bounds="[0,0][10,10]"><node text="One" resource-id="id/1" clickable="true" bounds="[0,0][4,4]"/><node content-desc="Two" bounds="[4,0][8,4]"/></node></hierarchy>')
    (tmp_path / "x" / "s2.xml").write_text("<node>")
    (tmp_path / "x" / "s3.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><node/>')
    found = screens.load_trees(spark, str(tmp_path / "x"))
    rows = {(r["screen_id"].rsplit("/", 1)[-1], r["node_id"]): r for r in screens.row_context(screens.parent_context(found)).collect()}
    one, two = rows["s1.xml", "0.0.0"], rows["s1.xml", "0.0.1"]
    assert (one["parent_text"], one["row_size"], two["row_pos"], two["text"], one["clickable"], two["clickable"]) == ("List", 2, 1, "Two", True, None)
    assert {r["parent_id"]: r["texts"] for r in screens.containers(found).collect()} == {"0": ["List"], "0.0": ["One", "Two"]}
    assert rows["s2.xml", None]["error"] and rows["s3.xml", None]["error"] == "document types are not read"
    met = {(r["a"], r["b"], r["relation"]): (r["dx"], r["dy"]) for r in screens.relations(found).collect()}
    assert met["0.0.0", "0.0.1", "next"] == (4.0, 0.0) and met["0.0", "0.0.0", "child"] == (-3.0, -3.0)
    (tmp_path / "shot.png").write_bytes(b"12345")
    assert screens.screenshots(spark, str(tmp_path / "shot.png")).first()["bytes"] == 5
    (tmp_path / "r.json").write_text('[\n {"dataset": "d",\n "correct": 3}\n]')
    assert (r := screens.load_results(spark, str(tmp_path / "r.json")).first())["correct"] == 3 and r["total"] is None


def test_the_package_exports_constructors_of_its_rows(spark):
    target = waymark.Candidate("target-1", (0.0, 1.0, 2.0, 3.0))
    one = spark.range(1).select(
        waymark.Query("q1", {"point": [1, 2]}, [target, waymark.Candidate("b", metadata={"text": "B"})]).alias("q"),
        waymark.Prediction("q1", "target-1", {"target-1": 1.0}).alias("p"),
    )
    assert [f.dataType for f in one.schema] == [schema.QUERY_FILE, schema.PREDICTION_FILE] or [f.dataType.names for f in one.schema] == [schema.QUERY_FILE.names, schema.PREDICTION_FILE.names]
    row = one.selectExpr("q.query_id", "p.selected_candidate_id = q.target_candidates[0].candidate_id AS right", "q.target_candidates[0].bbox AS box", "q.gold_candidate_id AS gold", "p.scores['target-1'] AS score", "variant_get(q.source, '$.point[1]', 'int') AS y").first()
    assert tuple(row) == ("q1", True, [0.0, 1.0, 2.0, 3.0], None, 1.0, 2)
    ids = spark.createDataFrame([("a",), ("b",)], "id string").select(waymark.Candidate(F.col("id")).alias("c"))
    assert [r["c"]["candidate_id"] for r in ids.collect()] == ["a", "b"]


def test_ambiguous_queries_count_apart(spark, tmp_path):
    rows = [
        {"query_id": "n", "target_candidates": [], "gold_candidate_id": None}, {"query_id": "a", "target_candidates": [], "gold_candidate_id": "x", "ambiguous": True},
        {"query_id": "b", "target_candidates": [], "gold_candidate_id": None, "ambiguous": True}, {"query_id": "c", "target_candidates": [], "gold_candidate_id": "x", "ambiguous": False},
    ]
    queries = schema.load_queries(spark, written(tmp_path, rows))
    kinds = {"n": "NULL", "a": "AMBIGUOUS", "b": "AMBIGUOUS", "c": "CONCRETE"}
    assert {r["query_id"]: r["gold_kind"] for r in queries.collect()} == kinds
    schema.write_jsonl(queries, str(tmp_path / "again"))
    assert {r["query_id"]: r["gold_kind"] for r in schema.load_queries(spark, str(tmp_path / "again")).collect()} == kinds
    made = spark.createDataFrame([("n", "x"), ("a", None), ("b", "x"), ("c", "x")], "query_id string, selected_candidate_id string").withColumn("scores", F.create_map())
    row = jobs.summarize([jobs.evaluate(queries, made, "tiny", "test", "m")]).first()
    assert (row["gold_null"], row["gold_ambiguous"], row["false_positive"], row["ambiguous_abstained"], row["correct"]) == (1, 2, 1, 1, 1)
    assert (row["false_positive_rate"], row["abstain_accuracy"]) == (1.0, 1 / 3)


def test_report_levels_sum_every_subset(spark):
    rows = [("a", "x", 1), ("a", "y", 2), (None, "x", 4)]
    got = {(r["level"], r["k"], r["m"]): r["n"] for r in metrics.report_levels(spark.createDataFrame(rows, "k string, m string, n long"), ["k", "m"], ["n"]).collect()}
    assert got == {(0, "a", "x"): 1, (0, "a", "y"): 2, (0, None, "x"): 4, (1, "a", None): 3, (1, None, None): 4, (2, None, "x"): 5, (2, None, "y"): 2, (3, None, None): 7}


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("kind"), (F.col("id") % 7).alias("part"), ((F.col("id") * 7919) % 50_021).cast("double").alias("ms"), (F.col("id") % 4001).alias("who"))
    rows = rows.unionByName(spark.range(5).select(F.lit(9).cast("long").alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(None).cast("double").alias("ms"), F.lit(1).cast("long").alias("who")))
    found = sketches.estimates(sketches.merged(sketches.sketched(rows, ["kind", "part"], "ms", "who"), ["kind"]), ["kind"], 0.9)
    for r in found.collect():
        if r["kind"] == 9:
            assert (r["n"], r["quantile"], r["n_who"]) == (0, None, 1)
            continue
        share = rows.where((F.col("kind") == r["kind"]) & (F.col("ms") <= r["quantile"])).count() / r["n"]
        assert abs(share - 0.9) <= sketches.RANK_ERROR + 1e-4 and abs(r["n_who"] - 4001) <= sketches.DISTINCT_ERROR * 4001


def test_patch_masks_of_boxes(spark):
    box = "struct<x0 double, y0 double, x1 double, y1 double>"
    rows = [("q", 0, "a", 0.0, "a", (0.0, 0.0, 0.5, 0.5)), ("q", 1, "b", 0.0, "a", (0.0, 0.0, 1.0, 1.0)), ("r", 0, "c", 0.0, "z", (0.0, 0.0, 1.0, 1.0))]
    found = losses.patch_masks(spark.createDataFrame(rows, f"query_id string, pos int, candidate_id string, score double, gold string, bbox {box}"), 2).collect()
    assert [r["query_id"] for r in found] == ["q"] and found[0]["gold_mask"] == [1.0, 0.0, 0.0, 0.0]
    assert [round(x, 6) for x in found[0]["predicted"]] == [0.99, 0.5, 0.5, 0.5]


def test_what_can_be_seen_and_acted_on(spark):
    rows = [([0.0, 0.0, 5.0, 5.0], True, None), ([0.0, 0.0, 0.0, 5.0], True, None), ([20.0, 0.0, 25.0, 5.0], True, None), ([-5.0, 0.0, 1.0, 5.0], False, True), (None, True, True), ([0.0, 0.0, 5.0, 5.0], None, None)]
    df = spark.createDataFrame(rows, "bounds array<double>, clickable boolean, editable boolean")
    seen = features.visible(F.col("bounds"), F.lit(10), F.lit(10)) & features.actionable(F.col("clickable"), F.col("editable"), F.lit(None).cast("boolean"))
    assert [r[0] for r in df.select(seen).collect()] == [True, False, False, True, False, False]


def test_predictions_made_elsewhere(spark, tmp_path):
    queries = schema.load_queries(spark, written(tmp_path, ROWS))
    made = tmp_path / "made.jsonl"
    made.write_text('{"query_id": "q1", "selected_candidate_id": "b", "scores": {"b": 1.0}}\n{"query_id": "q3", "selected_candidate_id": null, "scores": {}}\n')
    row = jobs.evaluate(queries, schema.load_predictions(spark, str(made)), "tiny", "test", "external").first()
    assert (row["correct"], row["total"], row["abstain_accuracy"]) == (1, 1, 1.0)


def test_features_of_missing_fields_are_zero(spark, tmp_path):
    rows = pair_features(schema.load_queries(spark, written(tmp_path, ROWS))).where("query_id = 'q2'").drop("query_id", "pos", "candidate_id")
    assert all(v == 0 for r in rows.collect() for v in r)
    same = pair_features(schema.load_queries(spark, written(tmp_path, ROWS))).where("candidate_id = 'a'").first()
    assert same["box_overlap"] == 1 and same["distance"] == 0 and same["same_region"] == 1 and same["clickable"] == 1


def test_a_matcher_runs_once_for_all_counts(spark):
    """each count of a report went through the matcher again."""
    queries = spark.createDataFrame([("a", 1, "x", "CONCRETE")], "query_id string, ord long, gold_candidate_id string, gold_kind string")
    row = jobs.evaluate(queries, lambda q: q.select("query_id", F.concat(F.lit("mark"), "query_id").alias("selected_candidate_id")), "d", "s", "m")
    assert "mark" not in row._jdf.queryExecution().optimizedPlan().toString() and row.first()["total"] == 1


def method_sizes(df):
    """Bytes of the largest method of each stage that Spark generates for a query."""
    debug = df.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(df._jdf.queryExecution().executedPlan()))]


def test_the_jvm_compiles_what_spark_generates(spark, tmp_path):
    """the features were one method of 15879 bytes; beyond 8000 the JVM interprets methods."""
    queries = schema.load_queries(spark, written(tmp_path, ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (pair_features(queries), StructuredRanker().predict(queries)):
            assert 0 < max(method_sizes(made)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_predictions_group_their_candidates_once(spark):
    """candidates were made for the selection and again for the scores."""
    nan = float("nan")
    rows = [("a", 0, "x", 1.0), ("a", 1, "y", 2.0), ("a", 2, "x", 0.5), ("a", 3, "z", 2.0), ("b", 0, "x", nan), ("b", 1, "y", None), ("b", 2, "z", -1.0), ("c", 0, "x", None), ("c", 1, "y", nan), (None, 0, "x", 1.0)]
    made = rank.predictions(spark.createDataFrame(rows, "query_id string, pos int, candidate_id string, score double"))
    got = {r["query_id"]: (r["selected_candidate_id"], {k: str(v) for k, v in r["scores"].items()}) for r in made.collect()}
    assert got == {"a": ("y", {"x": "0.5", "y": "2.0", "z": "2.0"}), "b": ("z", {"x": "nan", "y": "None", "z": "-1.0"}), "c": ("x", {"x": "None", "y": "nan"})}
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_metadata_of_other_types(spark, tmp_path):
    odd = {"text": 5, "resource_id": {"a": 1}, "clickable": "maybe", "editable": None, "bbox": [0, "5", "x"], "screen": ["10"]}
    rows = [{"query_id": "o", "source": odd, "target_candidates": [{"candidate_id": "a", "bbox": [0, 0, 1, 1], "metadata": odd}, {"candidate_id": "b", "metadata": [1]}, {"candidate_id": "c"}], "gold_candidate_id": None}, {"query_id": "p", "source": "plain", "target_candidates": [{"candidate_id": "a", "metadata": odd}], "gold_candidate_id": None}]
    for r in pair_features(schema.load_queries(spark, written(tmp_path, rows))).collect():
        alike = r["query_id"] == "o" and r["candidate_id"] == "a"
        assert {k for k in r.asDict() if k not in ("query_id", "pos", "candidate_id") and r[k]} == ({"text_overlap", "text_likeness", "id_overlap"} if alike else set())


def test_compressed_lines_keep_rows_and_their_order(spark, tmp_path, monkeypatch):
    """query rows were written uncompressed, 20 times the size of their tables."""
    monkeypatch.setattr(schema, "FILE_ROWS", 2)
    rows = ROWS + [{"query_id": "q1", "source": None, "target_candidates": [], "gold_candidate_id": None, "ambiguous": True}, {"query_id": "u", "target_candidates": []}]
    queries = schema.load_queries(spark, written(tmp_path, rows)).coalesce(1)
    plain, small = str(tmp_path / "plain"), str(tmp_path / "small")
    schema.write_jsonl(queries, plain)
    schema.write_jsonl(queries, small, "gzip")
    assert len([f for f in os.listdir(small) if f.endswith(".gz")]) == 3  # one task reads a whole one, so they are short
    as_read = lambda path: [str(r) for r in schema.load_queries(spark, path).orderBy("ord").drop("ord").collect()]
    assert as_read(small) == as_read(plain) and len(as_read(small)) == 5


def test_rows_are_validated_as_their_candidates_are(spark, tmp_path):
    """each rule shuffled all candidates."""
    one = lambda *ids: [{"candidate_id": i, "metadata": {}} for i in ids]
    rows = [
        ("fine", one("a", "b"), "a"), ("none", [], None), ("twice", one("a", "b", "a"), "b"), ("nulls", one(None, None), None), ("gone", one("a"), "z"), ("beside null", one("a", None), "z"), ("empty", [], "z"),
        ("again", one("a"), "b"), ("again", one("b"), "b"), ("across", one("a"), None), ("across", one("a"), None), ("lost", one("a"), "z"), ("lost", [], None), (None, one("a"), "a"),
    ]
    for given in (rows, rows + [(None, one("a"), None)]):
        queries = schema.load_queries(spark, written(tmp_path, [{"query_id": q, "target_candidates": c, "gold_candidate_id": g} for q, c, g in given]))
        back, nothing = queries.withColumnRenamed("gold_candidate_id", "gold"), spark.createDataFrame([], "query_id string, selected string")
        found = schema.validate_rows(queries)
        got = sorted(map(str, found.collect()))
        assert got == sorted(map(str, schema.validate_queries(back, rank.flatten(back), nothing).collect())) and len(got) == 11 + 2 * (len(given) > len(rows))
    only = schema.validate_rows(schema.load_queries(spark, written(tmp_path, ROWS)))
    assert only.count() == 0


def test_one_pass_counts_what_two_did(spark):
    """queries and predictions were shuffled and joined once for the accuracy and again for the safety counts."""
    kinds = [("a", 1, "x", "CONCRETE"), ("b", 2, "x", "CONCRETE"), ("b", 3, None, "NULL"), ("c", 4, None, "UNLABELED"), ("d", 5, "x", "AMBIGUOUS"), ("e", 6, None, "AMBIGUOUS"), ("f", 7, "x", None), ("g", 8, "x", "UNLABELED"), ("h", 9, None, "NULL"), ("i", 10, "y", "CONCRETE"), ("none", 11, "x", "CONCRETE")]
    queries = spark.createDataFrame(kinds, "query_id string, ord long, gold string, gold_kind string")
    made = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", None), ("f", "x"), ("g", "x"), ("h", None), ("i", None), ("z", "x")], "query_id string, selected string")
    for q in (queries, queries.drop("gold_kind")):
        row = metrics.report_counts(q, made).first().asDict()
        assert row == metrics.safety_counts(q, made).first().asDict() | metrics.top1_code(q, made).first().asDict()
    plan = jobs.evaluate(queries.withColumnRenamed("gold", "gold_candidate_id"), made.withColumnRenamed("selected", "selected_candidate_id"), "d", "s", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Join") == 1


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_query_rows_read_the_lines_once_and_have_the_first_known_part_as_source(spark, tmp_path):
    """lines were read, numbered and joined three times; orders whose first line has no part were dropped."""
    for name, some in (("part", "p_partkey % 3 > 0"), ("lineitem", "true")):
        spark.read.parquet(f"{DATA}/{name}.parquet").where(some).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "orders.parquet").symlink_to(f"{DATA}/orders.parquet")
    plan = reports.queries_of(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and len(re.findall(r"Relation .*l_orderkey", plan)) == 1
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("structured_features", "structured_predictions"):
        got = registry.QUERIES[name](spark, str(tmp_path)).toArrow()
        columns = ", ".join(got.column_names)
        assert sorted(map(repr, zip(*(got[c].to_pylist() for c in got.column_names), strict=True))) == sorted(map(repr, con.execute(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_query_rows_shuffle_lines_twice_and_number_them_before_parts_repeat(spark, tmp_path):
    """with parts too many to broadcast, lines were shuffled to be numbered, to be joined, and, with all their fields, to be grouped."""
    for name in ("lineitem", "orders"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
    part = spark.read.parquet(f"{DATA}/part.parquet")
    part.unionByName(part.where("p_partkey % 3 = 0")).where("p_partkey % 5 > 0").write.parquet(str(tmp_path / "part.parquet"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = reports.queries_of(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3  # lines and parts by part, lines by order
        got = registry.QUERIES["structured_features"](spark, str(tmp_path)).toArrow()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.column_names)} FROM ({registry.ORACLES['structured_features']})").fetchall()
    assert sorted(map(repr, zip(*(got[c].to_pylist() for c in got.column_names), strict=True))) == sorted(map(repr, want))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_the_report_leaves_no_lines_behind(spark):
    """the lines lay beside what was imported from them until the application ended."""
    places = []
    original = reports.place
    reports.place = lambda s, name: places.append(original(s, name)) or places[-1]
    try:
        row = registry.QUERIES["jobs_report"](spark, DATA).first()
    finally:
        reports.place = original
    folders = {p.rsplit("/", 1)[-1].split("-")[0]: p.removeprefix("file://").removeprefix("file:") for p in places}
    assert row["violations"] == 0 and not os.path.exists(folders["rows"])
    assert all(".zstd." in f for f in os.listdir(folders["imported"]) if f.endswith(".parquet"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_lines_of_structs_are_read_as_those_of_variants(spark, tmp_path):
    """a variant's text starts a JSON writer for each string in it, so the report's lines are written from structs."""
    (tmp_path / "lineitem.parquet").symlink_to(f"{DATA}/lineitem.parquet")
    part = spark.read.parquet(f"{DATA}/part.parquet")
    odd = {"p_name": F.when(F.col("p_partkey") % 7 > 0, F.concat("p_name", F.lit(' "ö\\/'))), "p_brand": F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")), "p_type": F.when(F.col("p_partkey") % 3 > 0, F.col("p_type"))}
    part.withColumns(odd).write.parquet(str(tmp_path / "part.parquet"))
    made = []
    for name, free in (("variants", F.to_variant_object), ("structs", lambda row: row)):
        schema.write_jsonl(reports.queries_of(spark, str(tmp_path), free), str(tmp_path / name), "gzip")
        queries = schema.load_queries(spark, str(tmp_path / name))
        made.append(sorted(map(str, pair_features(queries).collect())) + sorted(map(str, queries.select("query_id", "gold_candidate_id", "gold_kind", "target_candidates.bbox").collect())))
    assert made[0] == made[1] and len(made[0]) > 6000
    variants = reports.queries_of(spark, str(tmp_path))
    assert sorted(map(str, pair_features(variants).collect())) == made[0][: variants.select(F.sum(F.size("target_candidates"))).first()[0]]


def test_parts_of_ids_between_each_sign(spark):
    ids = ["a/b:c#d_e", "", "_", "//", "Brand#7/LARGE", "ö#ü", "plain", "a_:b", "#"]
    got = spark.createDataFrame([(i,) for i in ids], "a string").select("a", features.id_parts(F.col("a")).alias("p")).collect()
    assert {r["a"]: r["p"] for r in got} == {i: re.split("[_/:#]", i) for i in ids}


def test_a_candidates_texts_are_split_once(spark, tmp_path):
    """what two sets share and what they hold together split the candidate's texts anew each."""
    made = StructuredRanker().scored(schema.load_queries(spark, written(tmp_path, ROWS)))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 6  # words, ids and classes above, of both sides


def test_a_sources_texts_are_split_before_its_candidates_become_rows(spark, tmp_path):
    """they were split again for each candidate, and each pair of sets was put into three tables of hashes."""
    plan = pair_features(schema.load_queries(spark, written(tmp_path, ROWS)))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode")
    assert above.count("split(") == below.count("split(") == 3
    assert plan.count("array_except(") == 6 and "array_union" not in plan and "array_intersect" not in plan  # written twice, made once: both are in one select


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_candidates_are_made_once_where_the_same_plan_makes_them(spark):
    """Spark filtered by the size of the candidates' array first, and so made all of their variants twice."""
    plan = pair_features(reports.queries_of(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_variant_object(") == 2  # of the source and of the candidates


def test_queries_without_candidates_have_no_pairs(spark):
    nothing = "query_id string, source string, target_candidates array<struct<candidate_id string, bbox struct<x0 double, y0 double, x1 double, y1 double>, metadata string>>"
    rows = [("empty", '{"text": "a"}', []), ("null", '{"text": "a"}', None), ("hole", '{"text": "a a"}', [None, ("x", None, '{"text": "a a b"}'), ("x", None, None)]), (None, None, [("y", None, "{}")])]
    given = spark.createDataFrame(rows, nothing).withColumn("source", F.parse_json("source"))
    given = given.withColumn("target_candidates", F.transform("target_candidates", lambda c: F.when(c.isNotNull(), F.struct(c["candidate_id"].alias("candidate_id"), c["bbox"].alias("bbox"), F.parse_json(c["metadata"]).alias("metadata")))))
    got = sorted(((r["query_id"], r["pos"], r["candidate_id"], r["text_overlap"]) for r in pair_features(given).collect()), key=str)
    assert got == [("hole", 0, None, 0.0), ("hole", 1, "x", 0.5), ("hole", 2, "x", 0.0), (None, 0, "y", 0.0)]


def test_sets_without_repeats_are_compared_as_others(spark):
    sides = [["a", "b"], ["b", "c", None], [None], [], [""], None, ["ä", "a", ""]]
    pairs = spark.createDataFrame([(a, b) for a in sides for b in sides], "a array<string>, b array<string>")
    for r in pairs.select("a", "b", features.jaccard(F.col("a"), F.col("b")).alias("was"), features.jaccard(F.col("a"), F.col("b"), distinct=True).alias("now")).collect():
        assert r["was"] == r["now"], r


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_only_fractions_are_rounded(spark):
    """features that are 0 or 1 were rounded too."""
    made = registry.QUERIES["structured_features"](spark, DATA)
    assert len(re.findall(r"\bround\(", made._jdf.queryExecution().optimizedPlan().toString())) == len(reports.NAMES) - len(YES_OR_NO)
    assert made.agg(*(F.count_if(~F.col(n).isin(0.0, 1.0)).alias(n) for n in YES_OR_NO)).first() == (0,) * 5
