import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50


def test_library_stands_without_the_removable_parts(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("rasterbrook.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("rasterbrook.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    assert len(entry.queries()) >= 40
