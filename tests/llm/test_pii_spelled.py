"""Addresses with spelled-out signs, in texts without a digit or ``@``."""

import pytest
from test_llm_operators import docs

from raceframe.llm import pii


@pytest.mark.parametrize("address", ["joe at mail dot example dot com", "joe(at)mail.example.com", "joe_smith at mailing dot example dot org"])
def test_spelled_address_is_found_without_digits(address):
    far = "the order was sent to our office and will be ready " * 8
    for text in ("write to " + address + " for more details", far + "please ask " + address + ", or us. " + far):
        start = text.index(address)
        assert ("email", start, start + len(address), False) in pii.find_spans(text, pii.train())


def test_windows_reach_every_look():
    for sign in (" at ", "(at)", "[at]", " (at) ", " [at] "):
        for dot in (".", " dot ", "(dot)", " [dot] "):
            address = f"joe{sign}mail{dot}example{dot}com"
            text = "word " * 60 + address + " word" * 60
            start = text.index(address)
            assert pii.LOOKS[0][1].fullmatch(address) and any(a <= start and start + len(address) <= b for a, b in pii.windows(text))
    assert list(pii.windows("we met at noon. look at the sign on the door")) == []


def test_spelled_address_is_found_in_rows(spark):
    got = pii.find_pii(docs(spark, ["write to joe at mail dot example dot com now", "we met at noon", "", None])).collect()
    assert [len(r.spans) for r in sorted(got, key=lambda r: r.doc_id)] == [1, 0, 0, 0]
