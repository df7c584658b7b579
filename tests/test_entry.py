import __spark_entry__ as e


def test_entry_gives_rows(spark):
    df = e.entry(spark)
    assert df.columns == ["location_id", "location_name", "trending_score"] and df.count() > 0


def test_queries_without_the_llm_part(monkeypatch):
    monkeypatch.setattr(e, "_there", lambda module: False)
    names = set(e.queries())
    assert "b08_top_trending" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(e.oracle_sql()) <= names


def test_every_twin_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())
