"""Fuzzy header matching: the bound on likeness against comparing with every synonym."""

import random
from difflib import SequenceMatcher

import pytest

from sheetloom.operators import columns


def _plain(text, threshold):
    best, found = 0.0, None
    for synonym, canonical in columns.LOOKUP.items():
        if (r := SequenceMatcher(None, text, synonym).ratio()) > best:
            best, found = r, canonical
    return found if best >= threshold else None


def _headers(n):
    dice, made = random.Random(5), ["", "é", "zzzz", "q" * 300, "description of the item"]
    for _ in range(n):
        letters = list(dice.choice(list(columns.LOOKUP)))
        for _ in range(dice.randrange(4)):
            k = dice.randrange(len(letters) + 1)
            letters[k : k + dice.randrange(2)] = dice.choice(["", "a", "x", " ", "ü", "no"])
        if dice.random() < 0.1:
            dice.shuffle(letters)
        made.append("".join(letters))
    return made


@pytest.mark.parametrize("threshold", [0.0, 0.6, 0.8, columns.FUZZY_THRESHOLD, 1.0])
def test_as_comparing_with_every_synonym(threshold):
    headers = _headers(1500)
    assert columns.fuzzy_ratios(headers, threshold) == [_plain(h, threshold) for h in headers]


def test_few_synonyms_are_compared(monkeypatch):
    asked, headers = [], _headers(1500)

    class Counted(SequenceMatcher):
        def ratio(self):
            asked.append(1)
            return super().ratio()

    monkeypatch.setattr(columns, "SequenceMatcher", Counted)
    columns.fuzzy_ratios(headers)
    assert len(asked) < 0.1 * len(headers) * len(columns.LOOKUP)


def test_no_headers():
    assert columns.fuzzy_ratios([]) == []
