"""Spans of signed tokens and keys in what may stand around them."""

from __future__ import annotations

import base64
import json

from plumbline.llm.secrets import find_spans


def test_op7_signed_tokens_at_the_end_of_sentences_and_with_pretty_headers():
    part = lambda x, indent=None: base64.urlsafe_b64encode(json.dumps(x, indent=indent).encode()).decode().rstrip("=")
    sign = "c2lnbmF0dXJlLXNpZ25hdHVyZQ"
    for indent in (None, 2):
        token = f"{part({'alg': 'HS256'}, indent)}.{part({'sub': 'a'}, indent)}.{sign}"
        for before, after in (("use ", "."), ("use ", "..."), ("use ", ". Then"), ("(", ")"), ("", "")):
            text = before + token + after
            assert ("signed_token", len(before), len(before) + len(token)) in find_spans(text), text
        assert not [s for s in find_spans(f"{token}.{sign}") if s[0] == "signed_token"]


def test_op7_base64_keys_with_words_on_the_next_lines():
    number = b"\x02\x20" + bytes(range(1, 33))
    der = b"\x30\x44" + number + number
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = field(b"ssh-ed25519") + field(bytes(range(32)))
    for key in (der, ssh):
        whole = base64.b64encode(key).decode().rstrip("=")
        for block in (whole, whole[:40] + "\n" + whole[40:]):
            for after in ("", "\nThe next line", "\r\nword\nother\n", "\n" + "x" * 40):
                assert ("key_base64", 4, 4 + len(block)) in find_spans("key " + block + after), (block, after)
            two = find_spans(block + "\n" + block)
            assert key != der or [s[1:] for s in two if s[0] == "key_base64"] == [(0, len(block)), (len(block) + 1, 2 * len(block) + 1)]
