"""No paragraph that a template confirms is passed over for lack of a telling word."""

import re

from folio.llm import license_scan


def test_pairs_without_telling_words_confirm_nothing():
    telling = set(license_scan._telling())
    for templates in license_scan._known().values():
        for pairs in templates:
            without = [p for p in pairs if not telling & set(p.split(" "))]
            assert len(without) / len(pairs) < license_scan.CONFIRM


def test_telling_words_need_no_escape():
    assert all(re.fullmatch(r"[a-z0-9]+", w) for w in license_scan._telling())
