import pytest

from candlewick.config import Settings


def test_defaults_are_valid():
    s = Settings()
    s.validate()
    assert (s.min_chunk_chars, s.max_chunk_chars, s.breakpoint_percentile, s.default_top_k, s.highlight_sentences) == (200, 1200, 75.0, 5, 2)


@pytest.mark.parametrize("bad", [{"max_chunk_chars": 200}, {"min_chunk_chars": 0}, {"breakpoint_percentile": 101.0}, {"breakpoint_percentile": -1.0}, {"default_top_k": 0}, {"highlight_sentences": 0}])
def test_inconsistent_settings_raise(bad):
    with pytest.raises(ValueError):
        Settings(**bad).validate()


def test_environment(monkeypatch):
    monkeypatch.setenv("CANDLEWICK_TOP_K", "7")
    monkeypatch.setenv("CANDLEWICK_MIN_CHUNK_CHARS", "many")
    monkeypatch.setenv("CANDLEWICK_BREAKPOINT_PERCENTILE", "")
    monkeypatch.setenv("CANDLEWICK_EMBEDDING_MODEL", "")
    s = Settings()
    assert (s.default_top_k, s.min_chunk_chars, s.breakpoint_percentile, s.embedding_model_name) == (7, 200, 75.0, "")
