"""Where intermediate tables may go."""

import os
from types import SimpleNamespace

import pytest

from kymora.session import checkpoint_dir


def fake(master, named=None):
    state = {"dir": None}
    option = lambda: SimpleNamespace(isEmpty=lambda: state["dir"] is None, get=lambda: state["dir"])
    sc = SimpleNamespace(master=master, setCheckpointDir=lambda d: state.update(dir=d), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=option)))
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, default=None: named or default))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        checkpoint_dir(fake(master))
    assert checkpoint_dir(fake(master, "hdfs://shared/x")) == "hdfs://shared/x"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_machine_may_do_without(master):
    assert os.path.isdir(checkpoint_dir(fake(master)))


def test_own_paths_are_removed(spark):
    from kymora import session

    kept = session._OWN[:]
    session._OWN.clear()
    try:
        paths = [session.own_path(spark, "table") for _ in range(2)]
        spark.range(3).write.parquet(paths[0])
        local = [p.removeprefix("file:") for p in paths]
        assert paths[0] != paths[1] and os.path.exists(local[0])
        session.remove_own()
        assert not os.path.exists(local[0]) and not session._OWN
    finally:
        session._OWN.extend(kept)
