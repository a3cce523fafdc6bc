"""Where steps are written."""

from types import SimpleNamespace

import pytest

from threadloom.session import shared_folder


def session(master: str, folder: str | None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[0] if made else None, setCheckpointDir=made.append)
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=settings.get, set=settings.__setitem__))


def test_folder_of_the_setting():
    assert shared_folder(session("spark://host:7077", "/shared/steps")) == "/shared/steps"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_own_folder_on_one_machine_only(master):
    spark = session(master, None)
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", None)


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_no_own_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        shared_folder(session(master, None))
