import pytest

from lectern import session


class Context:
    def __init__(self, master):
        self.master = master
        self.applicationId = "app"

    def getConf(self):
        return {}


class Session:
    """As much of a session as ``shared_dir`` reads."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = Context(master), {} if folder is None else {"spark.checkpoint.dir": folder}


class Conf(dict):
    def set(self, key, value):
        self[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_has_to_name_its_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(master))
    assert session.shared_dir(Session(master, "hdfs:///shared")) == "hdfs:///shared"


def test_a_local_session_gets_its_own():
    local = Session("local[2]")
    local.conf = Conf()
    assert session.shared_dir(local).startswith("/tmp/lectern-") and local.conf["spark.checkpoint.dir"]


def test_executors_import_the_package(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    session.ship_package(spark)

    def look(batches):
        import lectern.operators.chunking as c

        for b in batches:
            yield b.assign(n=len(c._runs.__name__))

    assert spark.range(3).mapInPandas(look, "id long, n int").count() == 3
