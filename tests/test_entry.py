import __spark_entry__ as entry


def test_entry_and_names(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 20


def test_a_fault_inside_an_optional_part_shows(monkeypatch):
    import sys

    import pytest

    for name in [x for x in sys.modules if x.startswith("candlewick.llm") or x == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries()
    try:
        import candlewick.llm.queries  # noqa: F401
    except ModuleNotFoundError:
        return
    for name in [x for x in sys.modules if x.startswith("candlewick.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pyarrow", None)
    with pytest.raises(ModuleNotFoundError, match="pyarrow"):
        entry.queries()


def test_flagship(spark, tmp_path):
    texts = [(k, f"The first sentence and station {k}. Der Mensch und die Schule. El queso que comen.", "en", "s", 10) for k in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from candlewick.plans.catalog import flagship

    found = flagship(spark, str(tmp_path)).collect()
    assert len(found) == 5 and all(r.highlight and r.label == "s" for r in found)
