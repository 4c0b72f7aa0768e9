"""Pages, robots rules, text blocks, speech units and echo: more procedures on one text."""

from __future__ import annotations

import difflib
import re
import zlib
from collections import Counter
from html.parser import HTMLParser
from urllib.robotparser import RobotFileParser

#: Our own choice: elements whose text is not content, and elements that end a paragraph.
HIDDEN = {"script", "style", "noscript", "template", "head", "nav", "footer", "aside", "form"}
BLOCKS = {"p", "div", "article", "section", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "td", "blockquote"}


class _Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.depth = [], [], 0

    def close_block(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN
        if tag in BLOCKS:
            self.close_block()

    def handle_endtag(self, tag):
        self.depth -= tag in HIDDEN and self.depth > 0
        if tag in BLOCKS:
            self.close_block()

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def paragraphs(html: str | None) -> list[str]:
    reader = _Paragraphs()
    reader.feed(html or "")
    reader.close()
    reader.close_block()
    return reader.out


def main_text(html: str | None, least: int = 400) -> str | None:
    """The paragraphs of 40 characters or more, joined; null where they come to less than `least`."""
    text = "\n".join(p for p in paragraphs(html) if len(p) >= 40)
    return text if len(text) >= least else None


def allowed(rules: str, url: str | None, status: int = 200, agent: str = "*") -> bool:
    """What robots.txt says: 401 and 403 forbid all, other failures allow all."""
    if status in (401, 403):
        return False
    if status >= 400:
        return True
    reader = RobotFileParser()
    reader.parse(rules.splitlines())
    return reader.can_fetch(agent, url or "")


def blocks(text: str | None) -> list[dict]:
    """Headings, items and paragraphs of plain or marked-up text; fences, tables and rules are left out."""
    out, fenced = [], False
    for line in (text or "").splitlines():
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
        elif bare and not fenced and not bare.startswith("|") and not re.fullmatch(r"[-*_=]{3,}", bare):
            head, item = re.match(r"(#{1,6})\s+(.*)", bare), re.match(r"(?:[-*+]|\d+[.)])\s+(.*)", bare)
            kind, body, level = ("heading", head[2], len(head[1])) if head else ("item", item[1], 0) if item else ("paragraph", bare, 0)
            out.append({"kind": kind, "text": body, "level": level})
    return out


def units(text: str | None, most: int = 20) -> list[str]:
    """A sentence in parts of at most `most` words, cut after a ; or :, or a comma or dash, near the middle; the latter two count as if
    they stood a further 0.15 of the length away. What stands between dollar signs is not cut; what has no mark stays whole."""
    text = (text or "").strip()
    if len(text.split()) <= most:
        return [text] if text else []
    marks = [m for m in re.finditer(r"[;:,](?=\s)|\s[–—]\s", text) if text.count("$", 0, m.start()) % 2 == 0]
    if not marks:
        return [text]
    middle = len(text) // 2
    cut = min(marks, key=lambda m: abs(m.end() - middle) / len(text) + (0 if m[0] in ";:" else 0.15)).end()
    left, right = text[:cut].strip(), text[cut:].strip()
    return units(left, most) + units(right, most) if left and right else [text]


def without_echo(heard: str | None, played: str | None) -> str:
    """What was heard, without runs of two or more words that were just played; a single word is echo if it is all that was heard and
    more than three words were played."""
    a, b = (heard or "").lower().split(), (played or "").lower().split()
    least = 1 if len(a) == 1 and len(b) > 3 else 2
    gone = {i for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= least for i in range(m.a, m.a + m.size)}
    return " ".join(w for i, w in enumerate(a) if i not in gone)


def hashed_grams(text: str | None, size: int = 4096) -> list[dict]:
    """Counts of the character 1- to 3-grams of the letters, by crc32, times 50 over their number."""
    plain = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
    grams = [g for n in (1, 2, 3) for i in range(len(plain) - n + 1) if (g := plain[i : i + n]).strip()]
    counts = Counter(zlib.crc32(g.encode()) % size for g in grams)
    return [{"slot": slot, "value": 50 * n / len(grams)} for slot, n in sorted(counts.items())]
