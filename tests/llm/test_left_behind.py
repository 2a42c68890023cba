"""What written tables leave on executors' disks."""

from arcloom.llm import common


def test_shuffles_go_with_the_write(spark, monkeypatch):
    during, before = [], spark.conf.get(common.CLEANUP, None)
    real = type(spark.range(1).write).parquet

    def parquet(self, *given, **more):
        during.append(spark.conf.get(common.CLEANUP, "false"))
        return real(self, *given, **more)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", parquet)
    made = spark.range(1000).repartition(3, "id")
    assert common.written(made, "left").count() == 1000
    with common.Scratch(spark) as tables:
        assert tables.written(made, "left").count() == 1000
    assert during == ["true", "true"]
    assert spark.conf.get(common.CLEANUP, None) == before
