"""The entry points find their modules, or say what is wrong with them."""

import pytest

import __spark_entry__


def test_absent_modules_are_passed_over_and_faults_show(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "broken_part.py").write_text("import no_such_module_anywhere")
    assert __spark_entry__._if_there("not_there_at_all", "not_there_at_all") is None
    with pytest.raises(ModuleNotFoundError, match="no_such_module_anywhere"):
        __spark_entry__._if_there("broken_part", "broken_part")


def test_every_query_with_sql_is_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 10
