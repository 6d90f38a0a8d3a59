"""Where intermediate tables go."""

import pytest

from barriometrics import session


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):  # noqa: N802 - Spark's name
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


class _Session:
    def __init__(self, master, configured=None):
        self.sparkContext, self.configured = _Context(master), configured
        self.conf = self

    def get(self, key, default=None):
        return self.configured or default


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(_Session(master))
        assert session.shared_dir(_Session(master, "hdfs://x/y")) == "hdfs://x/y"


def test_local_mode_makes_one_folder():
    one = _Session("local[4]")
    assert session.shared_dir(one) == session.shared_dir(one)
