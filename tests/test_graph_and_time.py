"""Relations in trees and joins over time against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.operators import graph, moments
from waymark.sources import screens

START = datetime(2024, 1, 1)


def tree(seed, n):
    rng = random.Random(seed)
    paths = ["0"]
    children = {"0": 0}
    for _ in range(n - 1):
        above = rng.choice(paths)
        paths.append(f"{above}.{children[above]}")
        children[above] += 1
        children[paths[-1]] = 0
    return paths


def line(path):
    steps = path.split(".")
    return [".".join(steps[: i + 1]) for i in range(len(steps))]


def test_relations_of_all_pairs(spark):
    paths = tree(1, 25) + ["7"]  # a second root
    df = spark.createDataFrame([(a, b) for a in paths for b in paths], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", graph.common_ancestor(a, b).alias("lca"), graph.distance(a, b).alias("d"), graph.relation(a, b).alias("kind")).collect():
        both = [x for x in line(r["a"]) if x in line(r["b"])]
        assert r["lca"] == (both[-1] if both else None)
        assert r["d"] == len(line(r["a"])) + len(line(r["b"])) - 2 * len(both)
        above = lambda x: x.rpartition(".")[0]
        if r["a"] == r["b"]:
            assert r["kind"] == "self"
        elif r["a"] in line(r["b"]):
            assert r["kind"] == "descendant"
        elif r["b"] in line(r["a"]):
            assert r["kind"] == "ancestor"
        else:
            assert r["kind"] == ("sibling" if above(r["a"]) == above(r["b"]) and both else "sibling" if above(r["a"]) == above(r["b"]) == "" else "other")


@pytest.mark.parametrize("limit", [0, 1, 3, 6])
def test_nodes_near_an_anchor(spark, limit):
    screens_ = {"s": tree(2, 60), "t": tree(3, 40)}
    nodes = spark.createDataFrame([(s, p) for s, own in screens_.items() for p in own] + [("s", None), (None, "0")], "screen_id string, node_id string")
    anchors = spark.createDataFrame([("s", screens_["s"][20]), ("s", screens_["s"][0]), ("t", screens_["t"][-1]), ("u", "0")], "screen_id string, anchor_id string")
    got = sorted(tuple(r) for r in graph.within(anchors, nodes, limit).collect())
    want = []
    for s, anchor in (("s", screens_["s"][20]), ("s", screens_["s"][0]), ("t", screens_["t"][-1])):
        for p in screens_[s]:
            both = [x for x in line(anchor) if x in line(p)]
            d = len(line(anchor)) + len(line(p)) - 2 * len(both)
            if d <= limit:
                want.append((s, anchor, p, both[-1], d))
    assert got == sorted(want)


def test_subtrees(spark):
    paths = tree(4, 50)
    got = {r["node_id"]: (r["n_below"], r["height"]) for r in graph.subtrees(spark.createDataFrame([("s", p) for p in paths], "screen_id string, node_id string")).collect()}
    for p in paths:
        below = [q for q in paths if q.startswith(p + ".")]
        assert got[p] == (len(below), max((q.count(".") - p.count(".") for q in below), default=0))


def test_elements_of_pages(spark):
    html = "<!DOCTYPE html><HTML><body><!-- <b> --><ul><li>a<li>b<br></li></ul><script>'<p>'</script><p>x<b>y</p></i><p>z</body></html><p>"
    pages = spark.createDataFrame([("1", html), ("2", None), ("3", "no tags")], "screen_id string, html string")
    got = {r["node_id"]: (r["tag"], r["parent_id"], r["pos"]) for r in screens.html_nodes(pages).collect()}
    assert got == {
        "0": ("html", None, 0), "0.0": ("body", "0", 0), "0.0.0": ("ul", "0.0", 0), "0.0.0.0": ("li", "0.0.0", 0), "0.0.0.1": ("li", "0.0.0", 1), "0.0.0.1.0": ("br", "0.0.0.1", 0),
        "0.0.1": ("p", "0.0", 1), "0.0.1.0": ("b", "0.0.1", 0), "0.0.2": ("p", "0.0", 2), "1": ("p", None, 1),
    }


def test_screens_of_one_file_name_stay_apart(spark, tmp_path):
    for folder, text in (("a", "One"), ("b", "Two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "dump.xml").write_text(f'<node text="{text}"/>')
    found = screens.load_trees(spark, str(tmp_path / "*"))
    assert found.select("screen_id").distinct().count() == 2


def moments_of(seed, n, users=4):
    rng = random.Random(seed)
    out = [(i, rng.choice([0, 0, 0, 1, 2, None][: users + 2]), START + timedelta(minutes=rng.choice([rng.randrange(3000), 60, 120]))) for i in range(n)]
    return [*out, (n, 0, None), (n + 1, 9, START)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [60, 7200, 10**7])
def test_as_of_equals_brute_force(spark, strict, width):
    left, right = moments_of(1, 120), moments_of(2, 90)
    lf = spark.createDataFrame(left, "own int, k int, at timestamp").repartition(3)
    rf = spark.createDataFrame([(k, at, i) for i, k, at in right], "k int, at timestamp, event int").repartition(2)
    got = {r["own"]: (r["found"]["at"], r["found"]["event"]) if r["found"] else None for r in moments.as_of(lf, rf, "k", "at", width, strict).collect()}
    assert len(got) == len(left)
    for i, k, at in left:
        fits = [(t, e) for e, u, t in right if k is not None and u == k and t is not None and at is not None and (t < at or (t == at and not strict))]
        assert got[i] == max(fits, default=None)


def test_as_of_makes_no_pairs(spark):
    left, right = (spark.createDataFrame(moments_of(s, 50), "own int, k int, at timestamp") for s in (1, 2))
    plan = moments.as_of(left, right.select("k", "at", "own"), "k", "at", 3600)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("Join LeftOuter") == 1


def intervals(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        begin = START + timedelta(seconds=rng.choice([rng.randrange(20_000), 0, 3600, -500]))
        out.append((i, rng.choice([0, 0, 0, 1, None]), begin, begin + timedelta(seconds=rng.choice([1, 60, 3600, 9000, 0, -5]))))
    return [*out, (n, 0, None, START), (n + 1, 0, START, None), out[0], out[0]]


@pytest.mark.parametrize(("width", "hot"), [(600, 10_000), (3600, 3), (10**6, 5)])
def test_overlaps_equal_brute_force(spark, width, hot):
    a, b = intervals(3, 80), intervals(4, 70)
    kind = "own int, k int, begin timestamp, until timestamp"
    met = moments.overlaps(spark.createDataFrame(a, kind).repartition(3), spark.createDataFrame(b, kind), "k", width, hot)
    got = sorted((r["k"], r["a"]["own"], r["b"]["own"], r["begin"], r["until"]) for r in met.collect())
    fine = lambda x: None not in x and x[2] < x[3]
    want = sorted((x[1], x[0], y[0], max(x[2], y[2]), min(x[3], y[3])) for x in filter(fine, a) for y in filter(fine, b) if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 100


def test_a_hot_slot_is_dealt_out(spark):
    rows = [(i, 0, START, START + timedelta(seconds=10)) for i in range(40)]
    kind = "own int, k int, begin timestamp, until timestamp"
    df = spark.createDataFrame(rows, kind)
    met = moments.overlaps(df, df.limit(2), "k", 60, 10)
    assert met.count() == 80
    assert "share" in met._jdf.queryExecution().analyzed().toString()


def test_recently_equals_brute_force(spark):
    rows = moments_of(5, 150)
    df = spark.createDataFrame(rows, "own int, k int, at timestamp").repartition(3)
    got = {r["own"]: (r["n"], r["most"]) for r in moments.recently(df, "k", "at", {"n": F.count("*"), "most": F.max("own")}, 0.5).collect()}
    for i, k, at in rows:
        seen = [j for j, u, t in rows if u == k and at is not None and t is not None and timedelta(0) < at - t <= timedelta(days=0.5)]
        assert got[i] == (len(seen), max(seen, default=None))


def test_nothing_over_time(spark):
    none = spark.createDataFrame([], "own int, k int, at timestamp")
    assert moments.as_of(none, none.select("k", "at", "own"), "k", "at", 60).count() == 0
    empty = spark.createDataFrame([], "own int, k int, begin timestamp, until timestamp")
    assert moments.overlaps(empty, empty, "k", 60).count() == 0
    assert moments.recently(none, "k", "at", {"n": F.count("*")}, 1).count() == 0


@pytest.mark.parametrize("name", ["graph_relations", "graph_subtrees"])
def test_nodes_are_never_broadcast(spark, name, tmp_path, monkeypatch):
    """F1, F8: saved ids take so little of a file that Spark took all nodes for a small side; tasks follow the number of nodes."""
    from waymark.plans import graphs

    monkeypatch.setattr(graph, "TASK_NODES", 50)
    page = "<div><p>x</p><a href='/1'>y</a><ul><li>1<li>2</ul></div>"
    spark.createDataFrame([(i, page) for i in range(50)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = getattr(graphs, name)(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert rows.count() == 50 * 6


def test_tasks_follow_the_number_of_nodes(spark, monkeypatch):
    nodes = spark.createDataFrame([(str(i % 40), str(i)) for i in range(400)], "screen_id string, node_id string")
    monkeypatch.setattr(graph, "TASK_NODES", 50)
    dealt = graph.by_screen(nodes)
    assert dealt.rdd.getNumPartitions() == 9 and dealt.count() == 400


def test_around_equals_within(spark):
    paths = {s: tree(i, 40) for i, s in enumerate("st")}
    nodes = spark.createDataFrame([(s, p, i, i in (7, 9)) for s, own in paths.items() for i, p in enumerate(own)] + [("u", "0", 0, False), (None, "0", 0, True)], "screen_id string, node_id string, ord int, a boolean")
    anchors = spark.createDataFrame([(s, own[7]) for s, own in paths.items()], "screen_id string, anchor_id string")
    columns = ["screen_id", "anchor_id", "node_id", "ancestor_id", "distance"]
    assert sorted(graph.around(nodes, F.col("a"), 3).select(columns).collect()) == sorted(graph.within(anchors, nodes, 3).select(columns).collect())
