"""Spoken commands: likeness by a plain table, templates, slots, and what must not match."""

import random

import pytest

from lexweave.operators import commands
from lexweave.operators.commands import Matcher

CATALOGUE = (*commands.CATALOGUE, ("back", "back a paragraph"), ("mute", "mute"), ("voice", "switch to {voice}"))
SECTIONS = ("1 Introduction", "Related Work", "Methods")


def plain_kept(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_likeness_equals_a_plain_table():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randint(0, 20))) for _ in range(2))
        assert commands.kept(a, b) == plain_kept(a, b)
    assert commands.ratio("", "") == 100 and commands.ratio("abcd", "abxd") == 75
    assert commands.set_ratio("slow down a bit", "slow down") == 100 and commands.set_ratio("", "x") == 0
    assert commands.likeness("slow down a bit", "slow down") == pytest.approx(90)
    assert commands.likeness("reading", "stop reading") == pytest.approx(200 * 7 / 19)  # a fragment is only as like as its characters


@pytest.mark.parametrize("said, command, slots", [
    ("Start reading!", "play", {}), ("please stop reading", "pause", {}), ("slow down a bit", "slower", {}), ("go to section three", "goto", {"number": "3"}),
    ("go to section twenty one", "goto", {"number": "21"}), ("Speed one point five", "speed", {"number": "1.5"}), ("speed 1.2", "speed", {"number": "1.2"}),
    ("go to the related work section", "goto", {"section": "Related Work"}), ("explain the softmax function", "explain", {"term": "softmax function"}),
    ("what is attention?", "explain", {"term": "attention"}), ("switch to Emma", "voice", {"voice": "emma"}), ("mute", "mute", {}), ("nxt section", "next", {}), ("read fastr", "faster", {}),
])
def test_what_is_meant(said, command, slots):
    best = Matcher(CATALOGUE, SECTIONS).match(said)[0]
    assert (best.command, best.slots) == (command, slots) and best.method in ("template", "fuzzy")


@pytest.mark.parametrize("said", ["a", "the", "a section", "to", "reading", "", None, "go to section banana", "the weather is nice today in the whole town", "explain a"])
def test_what_is_not(said):
    found = Matcher(CATALOGUE, SECTIONS).match(said, strict=True)
    assert all(m.method == "fuzzy-weak" for m in found) and len(found) <= 2


def test_numbers():
    for said, value in {"seven": 7, "forty two": 42, "forty": 40, "12": 12, "1.25": 1.25, "two point oh": None, "zero point two five": 0.25, "twenty twenty": None, "seven three": None, "": None, "ten five": None}.items():
        assert commands.number(said) == value, said


def test_turns(spark):
    turns = [(1, 0, "start reading"), (1, 1, None), (2, 0, "go to section 4"), (2, 1, "reading"), (None, None, "mute")]
    got = {(r.conv_id, r.turn): r for r in commands.matched(spark.createDataFrame(turns, "conv_id long, turn int, text string"), CATALOGUE).collect()}
    assert len(got) == 5 and got[1, 0].command == "play" and got[1, 0].score == 1.0 and got[1, 1].method == "none" and got[1, 1].command is None
    assert got[2, 0].slots == {"number": "4"} and got[2, 1].method == "fuzzy-weak" and got[None, None].command == "mute"
    assert commands.matched(spark.createDataFrame([], "conv_id long, turn int, text string")).count() == 0
