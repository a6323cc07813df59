"""The shared folder: as the session says, else temporary on one machine only."""

from types import SimpleNamespace

import pytest

from tidelog.llm.common import shared_dir


def session(master, **settings):
    conf = SimpleNamespace(get=settings.get, set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_temporary_on_one_machine(master):
    s = session(master)
    assert shared_dir(s) == shared_dir(s)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,512]", "k8s://https://host"])
def test_a_cluster_must_name_one(master):
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session(master))
    named = session(master, **{"spark.checkpoint.dir": "hdfs://shared/x/"})
    assert shared_dir(named) == "hdfs://shared/x"
