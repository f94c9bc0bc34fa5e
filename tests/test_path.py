"""A shortest path reads its edges once."""

from epistema.operators import graph


def test_edges_of_a_shortest_path_are_read_once(spark):
    rows = [("a", "b"), ("c", "b"), ("c", "d"), ("a", "x"), ("x", "d"), ("d", "e"), ("e", "f")]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    schema = "src string, dst string, predicate string"
    edges = spark.createDataFrame([(*r, "p") for r in rows], schema).mapInPandas(counted, schema)
    assert graph.shortest_path(edges, "a", "f") == ["a", "x", "d", "e", "f"]
    assert seen.value == len(rows)  # read again in each step before
    assert graph.shortest_path(edges, "a", "nowhere") == []
