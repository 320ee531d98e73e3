"""The running metric equals the metric over all files."""

from waymark.operators import metrics
from waymark.sources import schema
from waymark.streaming import live_metrics


def test_running_top1_equals_batch(spark, tmp_path):
    queries = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("c", 2, None), ("a", 3, "z")], "query_id string, ord long, gold string")
    folder = tmp_path / "predictions"
    folder.mkdir()
    for i, (q, s) in enumerate([("a", "z"), ("b", "x"), ("c", "x"), ("b", "y"), ("d", "x")]):
        (folder / f"{i}.jsonl").write_text(f'{{"query_id": "{q}", "selected_candidate_id": "{s}", "scores": {{"{s}": 1.0}}}}\n')
        if i == 2:  # a first part, then the rest
            run(spark, queries, folder, tmp_path)
    run(spark, queries, folder, tmp_path)
    batch = schema.load_predictions(spark, str(folder)).withColumnRenamed("selected_candidate_id", "selected")
    assert tuple(spark.table("live").first()) == tuple(metrics.top1_code(queries, batch).first()) == (2, 3, 2 / 3)


def run(spark, queries, folder, tmp_path):
    stream = live_metrics.running_top1(queries, live_metrics.predictions_stream(spark, str(folder)))
    live_metrics.to_memory(stream, "live", str(tmp_path / "checkpoint")).awaitTermination(60)
