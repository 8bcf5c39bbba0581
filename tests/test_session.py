"""The shared folder: named by the cluster, private only where all runs in one process."""

from types import SimpleNamespace

import pytest

from runledger.session import shared_folder


def session(master, named=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_cluster_must_name_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master), "x")
        assert shared_folder(session(master, "/shared"), "x").startswith("/shared/runledger-x-")


def test_local_session_gets_a_private_folder():
    assert "runledger-shared-" in shared_folder(session("local[4]"), "x")
