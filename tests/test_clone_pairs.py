"""Clones of every two texts."""

from loomquery.operators import clones


def test_runs_do_not_depend_on_the_first_file(spark):
    lines = [f"line {i}" for i in range(20)]
    first = ["a0", *lines[7:13], "a1", *lines[7:13], "a2"]
    texts = [(1, first), (2, ["b0", *lines]), (3, ["c0", "c1", *lines]), (4, ["c0", "c1", *lines])]
    frame = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts], "id long, text string")
    got = sorted((r.key, r.source_key, r.start_line, r.source_start, r.n_lines) for r in clones.clone_pairs(frame, "id", "text").collect())
    assert got == [(2, 1, 9, 2, 6), (2, 1, 9, 9, 6), (3, 1, 10, 2, 6), (3, 1, 10, 9, 6), (3, 2, 3, 2, 20)]
    assert {r.key: r.representative for r in clones.text_classes(frame, "id", "text").collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
