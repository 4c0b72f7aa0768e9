"""Spoken commands: utterances matched with a catalogue by template, then by likeness, with slots filled.

A catalogue is rows (command, phrase); a phrase may have slots in braces. An utterance is normalised like phrases: small letters, letters and digits
only, fillers dropped. A template fits where the phrase's words stand in the utterance in a row; it counts by the share of the utterance that
it covers, 0.97 of that if it has slots, and 0.55 is needed. Likeness is the share of characters that an order-keeping alignment keeps
(insertions and deletions only); words of the phrase inside a longer utterance count for 0.9 of their own likeness, but only for phrases of
two words or more and utterances with as many, so that a fragment of a phrase is never taken for it.

A null or empty utterance matches nothing; one of less than three letters has no likeness. Ties fall to the earlier phrase of the catalogue.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from lexweave.operators.text import TENS, UNITS

COVERED, SLOTTED, LIKE, STRICT, WEAK = 0.55, 0.97, 82.0, 90.0, 2
FILLERS = {"please", "hey", "okay", "ok", "um", "uh", "well"}
CATALOGUE = (
    ("play", "start reading"), ("pause", "stop reading"), ("next", "next section"), ("back", "previous section"), ("faster", "read faster"), ("slower", "read slower"),
    ("slower", "slow down"), ("goto", "go to section {number}"), ("goto", "go to the {section} section"), ("repeat", "repeat that"), ("explain", "explain {term}"), ("explain", "what is {term}"), ("speed", "speed {number}"),
)
_NUMERAL = "|".join(["point", r"\d+(?:\.\d+)?", *sorted([*UNITS, *TENS], key=len, reverse=True)])
#: What a slot may hold; other slots hold as little as will do.
SLOTS = {"number": rf"(?P<number>(?:{_NUMERAL})(?: (?:{_NUMERAL}))*)", "section": r"(?P<section>.+?)", "term": r"(?P<term>.+)"}


def normal(text: str | None) -> str:
    words = re.findall(r"\d+(?:\.\d+)?|[^\W_]+", (text or "").lower())
    return " ".join(w for w in words if w not in FILLERS)


def number(text: str) -> float | None:
    """A number in figures or English words up to 99, with a decimal part after `point`."""
    whole, _, part = text.partition(" point ")
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return float(text)
    words = whole.split()
    if not words or any(w not in UNITS and w not in TENS for w in words) or len(words) > 2 or (len(words) == 2 and (words[0] not in TENS or UNITS.get(words[1], 99) > 9 or UNITS[words[1]] == 0)):
        return None
    value = float(sum(UNITS.get(w, TENS.get(w, 0)) for w in words))
    if part:
        digits = [str(UNITS.get(w, w)) for w in part.split()]
        if not all(d.isdigit() for d in digits):
            return None
        value += float("0." + "".join(digits))
    return value


def kept(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: a row of the table is one whole number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & mask
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * kept(a, b) / (len(a) + len(b)) if a or b else 100.0


def set_ratio(a: str, b: str) -> float:
    """The best likeness of what both word sets share and what either has besides."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    shared, rest_a, rest_b = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    if shared and (not rest_a or not rest_b):
        return 100.0
    full_a, full_b = f"{shared} {rest_a}".strip(), f"{shared} {rest_b}".strip()
    return max(ratio(full_a, full_b), *((ratio(shared, full_a), ratio(shared, full_b)) if shared else (0.0,)))


def likeness(said: str, phrase: str) -> float:
    plain = ratio(said, phrase)
    within = 2 <= len(phrase.split()) <= len(said.split())
    return max(plain, 0.9 * set_ratio(said, phrase)) if within else plain


class Match(NamedTuple):
    command: str
    method: str
    score: float
    slots: dict[str, str]


class Matcher:
    def __init__(self, catalogue=CATALOGUE, sections: tuple[str, ...] = (), covered: float = COVERED):
        self.sections, self.covered, self.plain, self.patterns = sections, covered, [], []
        for command, phrase in catalogue:
            parts = re.split(r"(\{\w+\})", phrase)
            slots = [p[1:-1] for p in parts if p.startswith("{")]
            pieces = [SLOTS.get(p[1:-1], rf"(?P<{p[1:-1]}>.+?)") if p.startswith("{") else re.escape(normal(p)).replace(r"\ ", " ") for p in parts if p.startswith("{") or normal(p)]
            self.patterns.append((command, re.compile(rf"(?:^|(?<= )){' '.join(pieces)}(?= |$)"), bool(slots)))
            if not slots:
                self.plain.append((command, normal(phrase)))

    def filled(self, groups: dict[str, str | None]) -> dict[str, str] | None:
        """Slots with their values; None where one has none."""
        out = {}
        for name, value in groups.items():
            value = (value or "").strip()
            if name == "number":
                if (found := number(value)) is None:
                    return None
                out[name] = f"{found:g}"
            elif name == "section":
                bare = re.sub(r"^(the|a|an) ", "", value)
                best = max(((likeness(bare, normal(s)), -i, s) for i, s in enumerate(self.sections)), default=(0.0, 0, ""))
                if best[0] < 80:
                    return None
                out[name] = best[2]
            else:
                bare = re.sub(r"^(the|a|an) ", "", value)
                if len(bare) < 2:
                    return None
                out[name] = bare
        return out

    def templates(self, said: str) -> list[Match]:
        found = []
        for command, pattern, slotted in self.patterns if said else ():
            if (m := pattern.search(said)) and (slots := self.filled(m.groupdict())) is not None:
                score = (m.end() - m.start()) / len(said) * (SLOTTED if slotted else 1.0)
                if score >= self.covered:
                    found.append(Match(command, "template", round(min(1.0, score), 3), slots))
        return self.once(found)

    def fuzzy(self, said: str, strict: bool = False) -> list[Match]:
        """Matches that are like enough; else the two likest, as weak ones."""
        if len(said.replace(" ", "")) < 3:
            return []
        found = self.once([Match(c, "fuzzy", round(likeness(said, p) / 100, 3), {}) for c, p in self.plain])
        return [m for m in found if 100 * m.score >= (STRICT if strict else LIKE)] or [m._replace(method="fuzzy-weak") for m in found[:WEAK]]

    @staticmethod
    def once(found: list[Match]) -> list[Match]:
        """Best first, each command once."""
        out: dict[str, Match] = {}
        for m in sorted(found, key=lambda m: -m.score):
            out.setdefault(m.command, m)
        return list(out.values())

    def match(self, text: str | None, strict: bool = False) -> list[Match]:
        said = normal(text)
        return self.templates(said) or self.fuzzy(said, strict)


MATCHED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("command", pa.string()), ("method", pa.string()), ("score", pa.float64()), ("slots", pa.map_(pa.string(), pa.string())), ("others", pa.list_(pa.string()))])


def matched(turns: DataFrame, catalogue=CATALOGUE, sections: tuple[str, ...] = (), strict: bool = False, covered: float = COVERED) -> DataFrame:
    """conv_id, turn, command, method, score, slots and the other commands that came near, for every turn; method `none` where nothing fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = Matcher(catalogue, sections, covered), {}
        for b in batches:
            rows = []
            for conv, turn, text in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "text")), strict=True):
                if text not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[text] = matcher.match(text, strict)
                first, *rest = known[text] or [Match("", "none", 0.0, {})]
                rows.append((conv, turn, first.command or None, first.method, first.score, list(first.slots.items()), [m.command for m in rest[:3]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MATCHED, strict=True)], schema=MATCHED) if rows else pa.RecordBatch.from_pylist([], schema=MATCHED)

    turns = turns.selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "text")
    return turns.mapInArrow(run, from_arrow_schema(MATCHED))


LIKEST = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("command", pa.string()), ("ratio", pa.float64())])


def likest(turns: DataFrame, catalogue=CATALOGUE) -> DataFrame:
    """conv_id, turn, command, ratio: the likest phrase without slots of every turn, however weak; null and 0 where a turn has no likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(catalogue)
        for b in batches:
            found = [matcher.fuzzy(normal(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], pa.array([f[0].command if f else None for f in found], pa.string()), pa.array([100 * f[0].score if f else 0.0 for f in found])], schema=LIKEST)

    turns = turns.selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "text")
    return turns.mapInArrow(run, from_arrow_schema(LIKEST))
