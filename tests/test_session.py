import pytest

from claimgrain.session import stored, work_folder


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Fake:
    """A session whose master and settings can be chosen."""

    def __init__(self, master, **settings):
        self.conf = Conf(settings)
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: Conf(settings)})()


def test_work_folder_needs_a_shared_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            work_folder(Fake(master), "x")
        shared = Fake(master, **{"spark.checkpoint.dir": "hdfs:///work/"})
        assert work_folder(shared, "x").startswith("hdfs:///work/x-")
    assert work_folder(Fake("local[4]"), "x").startswith("file:///")


def test_stored_rows(spark):
    assert sorted(r.id for r in stored(spark.range(5), "numbers").collect()) == list(range(5))
