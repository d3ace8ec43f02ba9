"""Names of any length are bound."""

from __future__ import annotations

from trigrid.llm import secret_scan


def test_long_dotted_keys():
    name = "com.example.platform.services.billing.gateway.production.datasource.pwd"
    assert len(name) > 64
    text = f"{name} = Xk9!v#Qz72Lm\nclient_secret = {name}\n"
    at = text.index("Xk9")
    assert secret_scan.lexed_spans(text) == [(at, 3, at + 12)]
    text = "a." * 100_000 + "pwd: Xk9!v#Qz72Lm"
    assert [text[a:b] for a, _, b in secret_scan.lexed_spans(text)] == ["Xk9!v#Qz72Lm"]
