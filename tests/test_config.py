from corpusloom.config import EngineConfig, gate_active, parse_mode, rules_active


def test_modes_are_parsed_whatever_their_case():
    assert [parse_mode(m) for m in ("pure-semantic", "Keyword", None, "other")] == ["PURE_SEMANTIC", "KEYWORD", "ENTERPRISE", "ENTERPRISE"]
    assert rules_active("ENTERPRISE") and gate_active("ENTERPRISE") and not rules_active("KEYWORD")


def test_environment_overrides_defaults(monkeypatch):
    monkeypatch.setenv("CORPUSLOOM_TOP_K", "7")
    monkeypatch.setenv("CORPUSLOOM_HYBRID_ALPHA", "0.5")
    config = EngineConfig.from_env()
    assert (config.top_k, config.hybrid_alpha, config.rrf_k) == (7, 0.5, 60)
