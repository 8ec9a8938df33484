"""The shared working folder."""

from types import SimpleNamespace

import pytest

from curatrix.session import shared_dir


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(master))
    assert shared_dir(session(master, "file:///shared")) == "file:///shared"
