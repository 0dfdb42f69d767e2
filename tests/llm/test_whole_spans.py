"""Further personal-data spans cover whole values, whatever their length."""

from __future__ import annotations

import random
import time

import pytest

from quillspark.llm import pii

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def run(n):
    rng = random.Random(n)
    return "k7" + "".join(c + rng.choice(LETTERS[:52]) for c in rng.choices(LETTERS, k=n))[: n - 2]


@pytest.mark.parametrize("n", [20, 201, 5000])
@pytest.mark.parametrize("form", ["password: {} end", "see {} end", 'token = "{}.{}-x_y/z" end', "secret: {}= end"])
def test_secrets(n, form):
    value = run(n)
    text = form.format(value, value[::-1])
    found = pii.candidates(text, [])
    start, end = text.index(value), text.index('" end') if '"' in text else text.index(" end")
    assert [c[:3] for c in found] == [(4, start, end)]
    assert pii.redacted(text, frozenset(c[3] for c in found)) == text[:start] + "[SECRET]" + text[end:]


def test_addresses_and_names():
    for address in ("ann [at] " + " [dot] ".join("abcdefghij"), "x" * 100 + " [at] " + "y" * 100 + " [dot] org"):
        text = f"write to {address}, please"
        assert [c[:3] for c in pii.candidates(text, [])] == [(7, 9, 9 + len(address))]
    name = "Lopado" + "temacho" * 8
    assert [c[:3] for c in pii.candidates(f"Frau {name} spoke", [])] == [(8, 5, 5 + len(name))]


@pytest.mark.parametrize("text", ["a" * 200_000, "a1-" * 70_000, "a[at]b." * 30_000, "1" * 200_000 + "a", "token=" * 30_000])
def test_time_grows_with_length(text):
    begun = time.process_time()
    pii.candidates(text, [])
    assert time.process_time() - begun < 5
