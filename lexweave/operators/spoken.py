"""Text as it is read aloud, with a map from every spoken character back to the source.

Rules run in order over the stretches of the source that no rule has taken yet; what a rule takes is frozen with its spoken words, and later rules don't look
inside. At the end the stretches are laid one after the other: open ones letter by letter, frozen ones as a whole, with single blanks
between words and none before a mark. Each spoken character knows the source range that it stands for: its own character, or all of what a
rule took. So ranges never run backwards, and every spoken word has one.

Rules cover formulas, links, citations, code, abbreviations, numbers with units, versions, acronyms and signs. What no rule knows is read as it stands; a
formula that can't be read is left as it is. Null and empty texts are empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from lexweave.operators import mathread


class Options(NamedTuple):
    citations: str = "skip"  # skip or read
    urls: str = "domain"  # domain, link or skip
    math: str = "verbalize"  # verbalize or skip
    acronyms: str = "auto"  # auto or spell
    heading: bool = False
    lexicon: dict[str, str] = {}


class Spoken(NamedTuple):
    text: str
    at: list[tuple[int, int]]

    def source(self, begin: int, stop: int) -> tuple[int, int] | None:
        """The source range of a spoken range; None where it has blanks only."""
        ranges = [r for c, r in zip(self.text[begin:stop], self.at[begin:stop], strict=True) if not c.isspace()]
        return (min(a for a, _ in ranges), max(b for _, b in ranges)) if ranges else None


WORDS = {"fig.": "Figure", "figs.": "Figures", "eq.": "Equation", "eqs.": "Equations", "sec.": "Section", "tab.": "Table", "alg.": "Algorithm", "e.g.": "for example", "i.e.": "that is", "vs.": "versus", "etc.": "etcetera", "dr.": "Doctor", "prof.": "Professor", "pp.": "pages", "no.": "number", "cf.": "compare", "approx.": "approximately", "w.r.t.": "with respect to", "&": "and"}
UNITS = {"gb": "gigabyte", "mb": "megabyte", "kb": "kilobyte", "tb": "terabyte", "ms": "millisecond", "hz": "hertz", "khz": "kilohertz", "mhz": "megahertz", "ghz": "gigahertz", "km": "kilometre", "cm": "centimetre", "mm": "millimetre", "kg": "kilogram"}
SCALES = {"k": "thousand", "m": "million", "b": "billion", "t": "trillion"}
LEXICON = {"SQL": "sequel", "JSON": "jay son", "GUI": "gooey", "LaTeX": "lah tek", "BLEU": "blue", "PyTorch": "pie torch", "SQLite": "sequel lite", "PostgreSQL": "postgres Q L"}
ROMAN = {"i": "one", "ii": "two", "iii": "three", "iv": "four", "v": "five", "vi": "six"}
#: A word that can be said: a beginning, vowels, an end, and perhaps once more.
_ONSET, _CODA = "(?:bl|br|cl|cr|dr|fl|fr|gl|gr|pl|pr|sc|sh|sl|sm|sn|sp|st|sw|tr|th|ch|[b-df-hj-np-tv-z])", "(?:rt|nd|nt|st|ld|mp|nk|rk|rd|[b-df-hj-np-tv-z])"
SAYABLE = re.compile(f"{_ONSET}[aeiou]{{1,2}}(?:{_CODA}(?:[aeiou]{{1,2}}{_CODA}?)?)", re.I)


def spelled(letters: str) -> str:
    return " ".join("ay" if c == "A" else c for c in letters)


def many(unit: str, count: str) -> str:
    return unit if count == "1" or unit.endswith("hertz") else f"{unit}s"


def formula(m: re.Match, o: Options) -> str | None:
    return "a formula" if o.math == "skip" else mathread.read(m[1] if m.lastindex else m[0])


def link(m: re.Match, o: Options) -> str:
    return {"skip": "", "link": "a link"}.get(o.urls, f"a link to {m[1].removeprefix('www.').replace('.', ' dot ')}")


def numbers(text: str) -> str:
    return re.sub(r"(\d)\s*[-–—]\s*(\d)", r"\1 to \2", text)


def citation(m: re.Match, o: Options) -> str:
    return f" citing {numbers(m[1])}" if o.citations == "read" else ""


def word(m: re.Match, o: Options) -> str:
    said = WORDS[m[1].lower()]
    return said[0].upper() + said[1:] if m[1][:1].isupper() and said[0].islower() and len(m[1]) > 3 and m.start() == 0 else said


def code(m: re.Match, o: Options) -> str:
    name = re.sub(r"\(\)$", "", m[0].strip("`"))
    name = re.sub(r"\.(?=\w+$)", " dot ", name)
    return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name.replace("_", " ")).lower()


def acronym(m: re.Match, o: Options) -> str:
    letters, plural, digits = m[1], m[2] or "", m[3] or ""
    if o.acronyms == "auto" and len(letters) >= 3 and SAYABLE.fullmatch(letters):
        said = letters.lower() + ("s" if plural else "")
    else:
        said = spelled(letters) + ("'s" if plural else "")
    return f"{said} {digits}".strip()


def amount(m: re.Match, o: Options) -> str:
    return f"{mathread.number(m[1])} {SCALES[m[2].lower()]}{' ' if m[3] else ''}"


Rule = tuple[str, re.Pattern, Callable[[re.Match, Options], str | None]]


def rule(name: str, pattern: str, said: Callable[[re.Match, Options], str | None] | str, flags: int = 0) -> Rule:
    return name, re.compile(pattern, flags), (lambda m, o: m.expand(said)) if isinstance(said, str) else said


N = r"(\d+(?:\.\d+)?)"
RULES: list[Rule] = [
    rule("formula", r"\$([^$\n]+)\$", formula),
    rule("code", r"`[^`\n]+`", code),
    rule("link", r"https?://([^/\s]+?)(?::\d+)?(?:/[^\s]*?)?(?=[.,;:!?)]*(?:\s|$))", link),
    rule("mail", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "an email address"),
    rule("bracket citation", r"\s*\[(\d+(?:\s*[,–-]\s*\d+)*|[A-Z][A-Za-z]*\+?\d{2}|[^\[\]]*\b(?:19|20)\d\d[a-z]?)\]", citation),
    rule("citation", r"\s*\(((?:e\.g\.,? |see |cf\. )?[A-Z][^()]*?,? (?:19|20)\d\d[a-z]?(?:; ?[^()]*)?)\)", citation),
    rule("big o", r"\b[OΘ]\((?:[^()\n]|\([^()\n]*\))*\)", formula),
    rule("given", r"\b[A-Z]\(\w+ \| \w+\)", formula),
    rule("file", r"\b[a-z]\w*\.(?:py|md|txt|json|yaml|cpp|csv)\b", code),
    rule("call", r"\b[a-z]\w*\(\)", code),
    rule("snake", r"\b[a-z]{2,}\w*_\w{2,}\b", code),
    rule("camel", r"\b[a-z]+(?:[A-Z][a-z]+)+\b", code),
    rule("equation", r"\b(Eqs?)\. ?\((\w+)\)", lambda m, o: f"Equation{'s' if m[1].endswith('s') else ''} {m[2]}"),
    rule("figure", r"\b(Figs?|Secs?|Tab|Alg)\. ?(\d+)([a-z])?\b", lambda m, o: f"{WORDS.get(m[1].lower() + '.', m[1])} {m[2]}{' ' + m[3] if m[3] else ''}"),
    rule("etcetera", r"\betc\.(?=\s*$|\s+[A-Z])", "etcetera."),
    rule("abbreviation", r"(?<![\w.])(e\.g\.|i\.e\.|w\.r\.t\.|etc\.(?=[,;)]| [a-z]|$)|vs\.|[Ff]igs?\.|[Ee]qs?\.|[Ss]ec\.|Dr\.|Prof\.|pp\.|No\.(?= ?\d)|cf\.|approx\.|&)", word, re.I),
    rule("version", r"\bv(\d+(?:\.\d+)+)\b", lambda m, o: f"version {m[1].replace('.', ' point ')}"),
    rule("money", r"[$]" + N + r"([KMBT])?\b", lambda m, o: f"{mathread.number(m[1])} {SCALES[m[2].lower()] + ' ' if m[2] else ''}dollars"),
    rule("power", N + r"e([+-]?)(\d+)\b", lambda m, o: f"{mathread.number(m[1])} times ten to the {'minus ' if m[2] == '-' else ''}{m[3]}"),
    rule("ten to", r"\b10\^(-?)(\d+)", lambda m, o: f"ten to the {'minus ' if m[1] else ''}{m[2]}"),
    rule("percent", N + r" ?%", lambda m, o: f"{mathread.number(m[1])} percent"),
    rule("by", r"\b(\d+)[x×](\d+)\b", r"\1 by \2"),
    rule("times", r"(~?)" + N + r"[x×](?![\w])", lambda m, o: f"{'approximately ' if m[1] else ''}{mathread.number(m[2])} times"),
    rule("unit", N + r" ?(GB|MB|KB|TB|kB|ms|Hz|kHz|MHz|GHz|km|cm|mm|kg)\b", lambda m, o: f"{mathread.number(m[1])} {many(UNITS[m[2].lower()], m[1])}"),
    rule("scale", N + r"([KMBT])(?:(-)(?=\w)|(?!\w))", amount),
    rule("per second", r"(?<=[a-z])/s\b", " per second"),
    rule("years", r"\b(\d+) ?[–-] ?(\d+)\b", r"\1 to \2"),
    rule("thousands", r"\b\d{1,3}(?:,\d{3})+\b", lambda m, o: m[0].replace(",", "")),
    rule("decimal", r"(?<![\w.])" + r"(\d+)\.(\d+)(?![\w])(?!\.\d)", lambda m, o: f"{m[1]} point {m[2] if len(m[2]) == 2 and m[1] != '0' else ' '.join(m[2])}"),
    rule("lexicon", rf"\b({'|'.join(sorted(LEXICON, key=len, reverse=True))})\b(?:-(\d+))?", lambda m, o: f"{LEXICON[m[1]]}{' ' + m[2] if m[2] else ''}"),
    rule("acronym", r"\b([A-Z]{2,})(s)?(?:-?(\d+))?\b", acronym),
    rule("lettered", r"\b([A-Z])(\d+)\b", r"\1 \2"),
    rule("script", r"(?<!\w)[A-Za-zα-ω](?:[_^]\w|[²³])(?:[_^]\w|[²³])*(?!\w)", formula),
    rule("greek", r"[α-ωΓΔΘΛΞΠΣΦΨΩ]", formula),
    rule("relation", r"[≤≥≠≈±×∈→]|(?<= )[+=](?= )", formula),
    rule("roman", r"\((i{1,3}|iv|vi?)\)", lambda m, o: f"{ROMAN[m[1]]},"),
    rule("dash", r"\s+[—–]\s+", ", "),
    rule("hyphen", r"(?<=\w)[–](?=\w)", " "),
]


def stretches(source: str, options: Options) -> list[tuple[int, int, str | None]]:
    """The source in parts: (start, end, words), words being None where no rule has taken it."""
    rules = RULES
    if options.lexicon:
        rules = [rule("own words", rf"(?<!\w)({'|'.join(map(re.escape, sorted(options.lexicon, key=len, reverse=True)))})(?!\w)", lambda m, o: o.lexicon[m[1]]), *RULES]
    parts: list[tuple[int, int, str | None]] = [(0, len(source), None)] if source else []
    if options.heading and (m := re.match(r"(\d+(?:\.\d+)*)\s+(?=\S)", source)):
        parts = [(0, m.end(), f"Section {m[1].replace('.', ' point ')}. "), (m.end(), len(source), None)]
    for _, pattern, said in rules:
        out = []
        for a, b, words in parts:
            at = a
            for m in pattern.finditer(source, a, b) if words is None else ():
                spoken = said(m, options) if m.end() > m.start() else None
                if spoken is not None:
                    out += [(at, m.start(), None)] * (m.start() > at) + [(m.start(), m.end(), spoken)]
                    at = m.end()
            if at < b:
                out.append((at, b, words))
        parts = out
    return parts


def speak(source: str | None, options: Options = Options()) -> Spoken:  # noqa: B008
    source = source or ""
    marked: list[tuple[str, tuple[int, int]]] = []
    for a, b, words in stretches(source, options):
        if words is None:
            own = [(source[i], (i, i + 1)) for i in range(a, b)]
        else:
            own = [(c, (a, b)) for c in words]
        if marked and own and (words is not None or marked[-1][1][1] - marked[-1][1][0] > 1) and marked[-1][0].isalnum() and own[0][0].isalnum():
            own.insert(0, (" ", own[0][1]))
        marked += own
    out: list[tuple[str, tuple[int, int]]] = []
    for c, r in marked:
        if c.isspace():
            if out and out[-1][0] not in " (":
                out.append((" ", r))
            continue
        if c in ",.;:!?)" and out and out[-1][0] == " ":
            out.pop()
        if c == "," and out and out[-1][0] == ",":
            continue
        out.append((c, r))
    while out and out[-1][0] == " ":
        out.pop()
    if options.heading and out and out[-1][0] not in ".!?":
        out.append((".", (out[-1][1])))
    return Spoken("".join(c for c, _ in out), [r for _, r in out])
