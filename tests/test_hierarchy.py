from pyspark.sql import Row

from corvane.operators import components, hierarchy
from corvane.operators.hierarchy import cycles, descendants, resolve_hierarchy

SCHEMA = "id string, name string, parent_ids array<string>, root_id string, path string"


def frame(spark, rows):
    return spark.createDataFrame([Row(id=i, name=n, parent_ids=p, root_id="x", path="y") for i, n, p in rows], SCHEMA)


def test_tree_loop_and_dirty_parents(spark):
    rows = [("a", "A", None), ("b", "B", ["a"]), ("c", None, ["b", "zz"]), ("d", "D", [" "]), ("e", "E", ["gone"]), ("f", "F", []),
            ("x", "X", ["y"]), ("y", "Y", ["z"]), ("z", "Z", ["x"]), ("t", "T", ["z"]), ("u", "U", ["t"]), ("s", "S", ["s"]),
            ("b", "B", ["a"]), (None, "N", ["a"])]
    got = {r.id: r for r in resolve_hierarchy(frame(spark, rows)).collect()}
    assert len(got) == 12
    assert got["c"].depth == 2 and got["c"].root_id == "a" and got["c"].path == "A / B / " and got["c"].path_ids == ["a", "b", "c"]
    assert all(got[i].depth == 0 and got[i].root_id == i for i in "adef")
    assert {i: r.cycle_id for i, r in got.items() if r.cycle_id} == dict.fromkeys("xyztu", "x") | {"s": "s"}
    assert {i for i, r in got.items() if r.on_cycle} == set("xyzs") and got["u"].depth is None


def test_deep_chain_and_star(spark):
    n = 300
    rows = [(f"n{i:04d}", "k", [f"n{i - 1:04d}"] if i else None) for i in range(n)] + [(f"s{i:03d}", "k", ["n0000"]) for i in range(150)]
    r = resolve_hierarchy(frame(spark, rows))
    assert r.agg({"depth": "max"}).first()[0] == n - 1
    assert descendants(r).where("ancestor_id = 'n0000'").count() == n - 1 + 150


def test_a_third_of_all_rows_under_one_parent(spark, monkeypatch):
    """Salted parents and hubs give the same result; no task of the lookup gets more than about HOT of its children."""
    monkeypatch.setattr(hierarchy, "HOT", 20)
    monkeypatch.setattr(components, "HOT", 20)
    rows = [("r", "R", None), ("h", "H", ["r"])] + [(f"k{i:03d}", "K", ["h"]) for i in range(120)] + [(f"g{i:03d}", "G", ["gone"]) for i in range(60)]
    rows += [("x", "X", ["y"]), ("y", "Y", ["x"])] + [(f"c{i:03d}", "C", ["x"]) for i in range(70)]
    f = frame(spark, rows)
    got = {r.id: r for r in resolve_hierarchy(f).collect()}
    assert len(got) == len(rows) and {r.path for i, r in got.items() if i[0] == "k"} == {"R / H / K"} and {r.depth for i, r in got.items() if i[0] == "g"} == {0}
    assert {r.folder_id for r in cycles(f).collect()} == {i for i, *_ in rows if i[0] in "xyc"}
    s = hierarchy._salted(hierarchy._first_rows(f))
    assert s.groupBy("parent", "salt").count().where("parent is not null").agg({"count": "max"}).first()[0] < 45
    comp = {r.node: r.component for r in components.connected_components(hierarchy.links(f).where("parent is not null").selectExpr("id as a", "parent as b")).collect()}
    assert {comp[i] for i, *_ in rows if i[0] == "k"} == {"h"} and comp["y"] == "c000"


def test_a_long_loop_carries_no_paths(spark):
    n = 200
    rows = [(f"n{i:03d}", "k", [f"n{(i + 1) % n:03d}"]) for i in range(n)]
    f = frame(spark, rows)
    assert {(r.folder_id, r.cycle_id) for r in cycles(f).collect()} == {(i, "n000") for i, *_ in rows}
    nodes = hierarchy._salted(hierarchy._first_rows(f))
    assert all(r.where("hop_ids is not null").isEmpty() for r in hierarchy._contract(nodes, False)[-1:])


def test_empty(spark):
    assert cycles(frame(spark, [])).collect() == []


def test_descendants_below_a_loop(spark):
    f = frame(spark, [("r", "R", None), ("s", "S", ["r"]), ("x", "X", ["y"]), ("y", "Y", ["x"]), ("t", "T", ["x"]), ("u", "U", ["t"]), ("z", "Z", ["z"]), ("w", "W", ["z"])])
    got = {tuple(r) for r in hierarchy.all_descendants(f).select("ancestor_id", "descendant_id", "distance").collect()}
    assert got == {("r", "s", 1), ("x", "t", 1), ("t", "u", 1), ("x", "u", 2), ("z", "w", 1)}
