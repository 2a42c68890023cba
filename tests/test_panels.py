"""Nearly empty blocks share rows, so a product's rows go by its cells."""

from arcloom.operators.dense import _panels


def test_nearly_empty_blocks_share_a_panel(spark):
    blocks = spark.range(500).selectExpr("'a' AS auto_id", "id DIV 100 AS i", "id % 100 AS j", "array(5, 70) AS cells", "array(0.5D, 0.25D) AS weights")
    panels = _panels(blocks, 64, "b").collect()
    assert len(panels) == 5 and all(len(r.b_far) == 200 for r in panels)
    assert {(r.k, n, f, w) for r in panels for n, f, w in zip(r.b_near, r.b_far, r.b_weight)} == {(k, n, j * 64 + c, w) for k in range(5) for j in range(100) for n, c, w in ((0, 5, 0.5), (1, 6, 0.25))}
