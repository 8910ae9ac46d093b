"""Documents below folders at any depth."""

from loomgraph.operators.ingest import folder_files


def test_deep_chain_and_cycle(spark):
    nodes = [("f0", None, True)] + [(f"f{k}", f"f{k - 1}", True) for k in range(1, 5000)]
    nodes += [("top", "f0", False), ("mid", "f2500", False), ("deep", "f4999", False)]
    nodes += [("a", "b", True), ("b", "a", True), ("x", "a", False), ("y", "b", False), ("b", "c", True), ("alone", None, True)]
    table = spark.createDataFrame(nodes, "node string, parent string, is_folder boolean")
    roots = spark.createDataFrame([("f0",), ("f2501",), ("a",), ("alone",), ("f0",)], "node string")
    got = {tuple(r) for r in folder_files(table, roots).collect()}
    assert got == {("f0", "top"), ("f0", "mid"), ("f0", "deep"), ("f2501", "deep"), ("a", "x"), ("a", "y")}
    assert folder_files(table.where("false"), roots).count() == 0
