import importlib
import sys

import pytest


def test_entry_gives_rows(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["doc_id", "start", "score", "excerpt"] and got.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture
def without_llm(monkeypatch):
    class Refuse:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "folioscale.llm") or name.startswith("folioscale.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    held = {n: m for n, m in sys.modules.items() if n in ("__spark_entry__", "corpus_pipeline") or n.startswith("folioscale.llm")}
    for name in held:
        monkeypatch.delitem(sys.modules, name)
    import folioscale

    monkeypatch.delattr(folioscale, "llm", raising=False)
    finder = Refuse()
    sys.meta_path.insert(0, finder)
    yield
    sys.meta_path.remove(finder)
    sys.modules.pop("__spark_entry__", None)


def test_the_rest_works_without_the_subpackage(without_llm):
    entry = importlib.import_module("__spark_entry__")
    assert "bm25_best_window" in entry.queries() and not [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
