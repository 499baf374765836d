"""Every registered query against its SQL on the smallest tables, and the plans' shape."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.queries import QUERIES, SQL
from docloom.queries.registry import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(rows, names):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.9g}"
        return v if v is None or isinstance(v, (str, bool)) else str(v) if not isinstance(v, int) else f"{v:.9g}" if abs(v) < 2**53 else str(v)

    return sorted((tuple(one(r[n]) for n in sorted(names)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    expected = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert plain([r.asDict() for r in got.collect()], names) == plain(expected, names)


def test_entry(spark):
    assert entry.entry(spark).collect()[0]["n"] == 64
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_prune(spark, sf):
    plan = _plan(QUERIES["expr_flagship"](spark, sf))
    assert "user_id" not in plan and "Python" not in plan and "EqualNullSafe(event_type,purchase)" in plan
    for name in ("expr_arrays", "expr_objects", "path_filter", "patch_predicates", "lww_map", "type_validate", "batch_rebase"):
        if name != "expr_objects":  # jp.add takes a patch as data
            assert "Python" not in _plan(QUERIES[name](spark, sf)), name
    assert "text" not in _plan(QUERIES["join_labels"](spark, sf)).split("ReadSchema")[1]


def test_aggregations_combine_before_the_shuffle(spark, sf):
    plan = _plan(QUERIES["lww_register"](spark, sf))
    assert "partial_max_by" in plan
    assert table(spark, sf, "events").count() == 1000


def test_distinct_counts_keep_one_sketch_a_type(spark, sf):
    plan = _plan(QUERIES["agg_distinct"](spark, sf))
    sketches = [line for line in plan.split("\n") if "approx_count_distinct" in line]
    assert sketches and all("user_id" not in line.split("keys=[")[1].split("]")[0] for line in sketches)


def test_patch_diff_pairs_neighbours_over_all_partitions(spark, tmp_path):
    from docloom.queries.documents import _successive

    keys = [7, 8, 999, 1007, 5_000_000_000, 5_000_000_001, 9_000_000_000_000, -4]
    rows = ", ".join(f"({k}L, {k}L, 'O', '5-LOW')" for k in keys)
    spark.sql(f"SELECT * FROM VALUES {rows} t(o_orderkey, o_custkey, o_orderstatus, o_orderpriority)").write.parquet(f"{tmp_path}/orders.parquet")
    lines = ", ".join(f"({k}L, {n}, {n}D, 'A')" for k in keys if k != 999 for n in (2, 1))
    spark.sql(f"SELECT * FROM VALUES {lines} t(l_orderkey, l_linenumber, l_quantity, l_returnflag)").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = _successive(spark, str(tmp_path))
    key = lambda doc: int(doc.split(":")[1].split(",")[0])
    own = sorted(k for k in keys if k != 999)
    assert sorted((key(r["doc"]), key(r["dst"])) for r in pairs.collect()) == list(zip(own, own[1:], strict=False))
    # patches cost time and not bytes: Spark may not join small partitions under them
    assert _plan(QUERIES["patch_diff"](spark, str(tmp_path))).split("ArrowEvalPython")[-1].split("Exchange", 1)[1].split("[plan_id")[0].endswith("REPARTITION_BY_NUM, ")


def test_runs_of_text_edits_match_single_ones():
    from docloom.operators import patch

    ops = [{"op": "str_ins", "path": "/a/0", "pos": 1, "str": "xy"}, {"op": "str_del", "path": "/a/0", "pos": 0, "len": 2}, {"op": "replace", "path": "/a/0", "value": "new"}, {"op": "str_del", "path": "/a/0", "pos": 1, "str": "e"}]
    assert patch.apply_ops({"a": ["pq"]}, ops) == ({"a": ["nw"]}, ["pq", "pxyq", "yq", "new"])
    with pytest.raises(patch.PatchError, match="INVALID_INDEX"):
        patch.apply_ops({"a": ["pq"]}, [*ops[:1], {"op": "str_del", "path": "/a/0", "pos": 3, "len": 2}])


def test_documents_stay_in_all_partitions(spark, sf):
    """Patches and paths cost time and not bytes: Spark may not join small partitions under them."""
    for name in ("patch_apply", "path_descendant", "path_wildcard_slice"):
        assert "REPARTITION_BY_NUM" in _plan(QUERIES[name](spark, sf)), name


def test_lowered_paths_read_their_array_once(spark):
    from pyspark.sql import functions as F

    from docloom.plans.jsonpath import path_value, path_values

    v = F.parse_json("d")
    docs = ['{"a":[{"q":{"r":1}},{"q":2},{"q":{"r":3}}]}', '{"a":[]}', '{"a":{"z":{"q":{"r":5}}}}', '{"a":7}', "{}"]
    rows = spark.createDataFrame([(d,) for d in docs], "d string")
    paths = {"$.a[-1].q.r": [["3"], [], [], [], []], "$.a[-4].q": [[], [], [], [], []], "$.a[*].q.r": [["1", "3"], [], ["5"], [], []], "$.a[0:2].q.r": [["1"], [], [], [], []], "$.a[2:1].q": [[], [], [], [], []], "$.a[::-1].q.r": [["3", "1"], [], [], [], []], "$.a[1:].q.r": [["3"], [], [], [], []]}
    for path, want in paths.items():
        got = rows.select(F.transform(path_values(v, path), lambda x: F.to_json(x)).alias("x"))
        assert [r["x"] for r in got.collect()] == want, path
        assert _plan(got).count("ArrayType(VariantType") <= 2, path  # the result's own cast may be the second
    one = rows.select(path_value(v, "$.a[-1].q.r", "long").alias("x"))
    assert [r["x"] for r in one.collect()] == [3, None, None, None, None] and _plan(one).count("ArrayType(VariantType") == 1


def test_descendant_names_make_nodes_only_of_what_they_find(monkeypatch):
    from docloom.plans import jsonpath

    doc = {"q": {"q": [1, {"q": 2, "z": {"y": 3}}]}, "b": [{"c": 1, "q": None}]}
    made = []
    monkeypatch.setattr(jsonpath, "Node", lambda *a, plain=jsonpath.Node: made.append(a) or plain(*a))
    found = jsonpath.evaluate(jsonpath.parse("$..q"), doc)
    assert [jsonpath.pointer(n.path) for n in found] == ["/q", "/q/q", "/q/q/1/q", "/b/0/q"]
    assert len(made) == len(found) + 1


@pytest.mark.parametrize("name", ["rga_text", "rich_text", "doc_edits", "document_forms"])
def test_documents_are_folded_in_batches_of_many(spark, sf, name):
    plan = _plan(QUERIES[name](spark, sf))
    assert "MapInArrow" in plan and "InPandas" not in plan and plan.count("MapInArrow") == 1


def test_folds_see_whole_documents_across_batches(spark):
    from docloom.operators.crdt import folded

    rows = [(None if k == 5 else k % 6, float("nan") if k % 2 else 0.0, k) for k in range(60)]
    df = spark.createDataFrame(rows, "a int, b double, x int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        own = folded(df, ["a", "b"], lambda names, held: [(len(held), sum(x for (x,) in held))], "n long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for a, b, x in rows:
        n, total = want.get((a, str(b)), (0, 0))
        want[a, str(b)] = (n + 1, total + x)
    assert {(r["a"], str(r["b"])): (r["n"], r["total"]) for r in own} == want and len(own) == len(want)


def test_event_codecs_run_in_all_partitions(spark, sf):
    """A small file is one task, whatever its rows cost."""
    for name in ("codec_round_trip", "patch_forms", "random_documents"):
        assert "REPARTITION_BY_NUM" in _plan(QUERIES[name](spark, sf)), name
