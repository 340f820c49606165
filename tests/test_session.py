import pytest

from rillwork import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_shared_folder_is_read_from_the_session():
    shared = Fake(spark_checkpoint_dir="hdfs://h/check/", spark_master="yarn")
    assert session.work_dir(shared) == "hdfs://h/check/rillwork"
    assert session.fresh_dir(shared, "x") != session.fresh_dir(shared, "x")


def test_session_without_it_uses_its_warehouse():
    assert session.work_dir(Fake(spark_master="yarn", spark_sql_warehouse_dir="hdfs://h/wh")) == "hdfs://h/wh/rillwork"


def test_settled_frame_knows_its_size(spark):
    assert session.settle(spark.range(5)).count() == 5


def test_scratch_of_a_written_step_is_deleted(spark):
    inner = []

    def make():
        inner.append(session.settle(spark.range(3)))
        return inner[0].filter("id > 0")

    outer = session.settle(spark.range(2))
    assert session.written(spark, make, "step").count() == 2
    assert outer.count() == 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        inner[0].collect()
