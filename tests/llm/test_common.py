from types import SimpleNamespace

import pytest

from difftide.llm.common import free_names, shared_folder


def _session(master, named=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(_session("spark://host:7077", "/shared/c/")) == "/shared/c"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(_session(master))
    one = _session("local[4]")
    assert shared_folder(one) == shared_folder(one)


def test_names_not_taken():
    assert free_names(["A", "b_", "c"], "a", "b", "b_", "d") == ["a_", "b", "b__", "d"]
