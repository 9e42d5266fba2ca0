import sys
import types

import pytest

import __spark_entry__
from kelpie import scratch
from kelpie.plans import catalogue


def test_queries_and_sql_have_the_same_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_optional_parts_that_lack_a_package_are_left_out(tmp_path, monkeypatch):
    (tmp_path / "lacks_a_package.py").write_text("import a_package_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="a_package_that_is_not_there"):
        assert __spark_entry__._optional("lacks_a_package") is None
    assert __spark_entry__._optional("json") is sys.modules["json"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    session = lambda master, folder: types.SimpleNamespace(
        conf=types.SimpleNamespace(get=lambda k, d=None: folder, set=lambda k, v: None), sparkContext=types.SimpleNamespace(master=master)
    )
    with pytest.raises(ValueError):
        scratch.scratch_dir(session("spark://host:7077", None))
    assert scratch.scratch_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch.scratch_dir(session("local[2]", None)).startswith("file://")
