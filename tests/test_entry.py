import importlib
import sys


def test_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


def test_entry_stands_without_the_llm_subpackage(monkeypatch):
    """The driver removes the subpackage and the pipeline; the rest still imports."""
    import __spark_entry__ as e

    gone = [m for m in sys.modules if m.startswith("graphloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "graphloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.import_module("__spark_entry__")
    names = bare.queries()
    assert "hotspots" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    sys.modules["__spark_entry__"] = e


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and [r.score for r in rows] == sorted(r.score for r in rows)
