"""Ways in which programs and settings bind a secret, each with the span that must be found."""

from __future__ import annotations

import pytest

from trigrid.llm import secret_scan

KEY = "Xk9vQz72LmR4tB8w"
OTHER = "Pn3hYc61JdW5sG0e"


def found(text):
    return [text[a:b] for a, _, b in secret_scan.lexed_spans(text)]


@pytest.mark.parametrize(
    "text",
    [
        f"run --password={KEY} --verbose", f'#define API_KEY "{KEY}"', f'#  define AUTH_TOKEN "{KEY}"', f'token <- "{KEY}"', f'set token "{KEY}"', f'setenv SECRET "{KEY}"',
        f"password: |\n  {KEY}\nuser: joe\n", f"a:\n  client_secret: >-\n    {KEY}\n  user: x\n", f'b = "{KEY}"\napi_token = f"{{b}}"', f'b = "{KEY}"\napi_token = "%s" % b', f'x, token = "foo", "{KEY}"',
        f'user, token, n = "joe", "{KEY}", 5', f'const a, apiSecret = "b", "{KEY}"',
    ],
)
def test_shapes(text):
    assert found(text) == [KEY]


def test_targets_keep_their_items():
    assert found(f'token, user = "{KEY}", "{OTHER}"') == [KEY]
    assert found(f'a, b = "{KEY}", "{OTHER}"\ntoken = b') == [OTHER]
    assert found(f'f(a, token="{KEY}")') == [KEY] and found(f'x, y = 1, 2\ntoken = "{KEY}"') == [KEY]


def test_blocks_end_with_their_indentation():
    text = f"private_key: |\n    {KEY}\n    {OTHER}\n  note: plain words here\n"
    assert found(text) == [f"{KEY}\n    {OTHER}"]
    assert found("password: |\n") == [] and found("a | b\n  c") == []


def test_blanks_only_in_passphrases():
    assert found('passphrase = "correct horse battery staple"') == ["correct horse battery staple"]
    assert found('password = "please enter at least eight characters"') == []
    assert found('b = "short"\napi_token = f"{b}{c}"') == []
