"""When each word of a spoken text is heard: tokens with times, laid on the text.

Speech comes in chunks, each with its text, its tokens (text, white space after it, start and end within the chunk, or none) and its length
in seconds. Where the tokens joined are the text itself, their places follow. Where they are not, because the voice says words in another
way, tokens and the text's words are matched by their longest common subsequence; tokens between two matches share the words
between these in order, as evenly as goes, and where there are none they have no place. So places never run backwards.

Tokens without a letter or digit, or without times, have no span. A chunk whose text isn't found begins at the next word. Empty texts and
chunks have no spans.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: How much further than the chunk's own length its words are looked for, in characters.
FURTHER = 64
DIGITS = "zero one two three four five six seven eight nine".split()


class Token(NamedTuple):
    text: str
    space: str
    start: float | None
    end: float | None


class Chunk(NamedTuple):
    text: str
    tokens: list[Token]
    duration: float


class Span(NamedTuple):
    """A word's place in the text and when it is heard."""

    begin: int
    stop: int
    start: float
    end: float


def spoken_word(text: str) -> bool:
    return any(c.isalnum() for c in text)


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both, earliest in a."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def places(text: str, base: int, chunk: Chunk) -> list[tuple[int, int] | None]:
    """Where each token stands in the text."""
    joined = "".join(t.text + t.space for t in chunk.tokens)
    if text.startswith(joined, base):
        out, at = [], base
        for t in chunk.tokens:
            out.append((at, at + len(t.text)))
            at += len(t.text) + len(t.space)
        return out
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+(?:['’.-]\w+)*", text[: base + max(len(joined), len(chunk.text)) + FURTHER]) if m.start() >= base]
    said = [i for i, t in enumerate(chunk.tokens) if spoken_word(t.text)]
    found: list[tuple[int, int] | None] = [None] * len(chunk.tokens)
    matched = common([chunk.tokens[i].text.casefold() for i in said], [text[a:b].casefold() for a, b in words])
    last = (-1, -1)
    for i, j in [*matched, (len(said), None)]:
        if j is not None:
            found[said[i]] = words[j]
        between = range(last[1] + 1, len(words) if j is None else j)
        gap = said[last[0] + 1 : i]
        if j is None:  # behind the last match no more words than tokens
            between = between[: len(gap)]
        for k, token in enumerate(gap):
            if between:
                found[token] = words[between[k * len(between) // len(gap)]]
        last = (i, last[1] if j is None else j)
    return found


def align(text: str, chunks: list[Chunk]) -> list[Span]:
    """The spans of all chunks, one after the other."""
    out, cursor, offset = [], 0, 0.0
    for chunk in chunks:
        base = text.find(chunk.text, cursor) if chunk.text else -1
        if base < 0:
            base = cursor + len(text[cursor:]) - len(text[cursor:].lstrip())
        for token, place in zip(chunk.tokens, places(text, base, chunk), strict=True):
            if place is not None and token.start is not None and token.end is not None and spoken_word(token.text):
                out.append(Span(*place, token.start + offset, token.end + offset))
        cursor, offset = base + len(chunk.text), offset + chunk.duration
    return out


def read_aloud(texts: list[str], letter: float = 0.06) -> list[dict]:
    """The spans of texts that are read one after the other, a letter of a word in so many seconds, digits by their names."""
    chunks = []
    for text in texts:
        tokens, at = [], 0.0
        for word, space in re.findall(r"(\S+)(\s*)", text):
            said = DIGITS[int(word)] if re.fullmatch("[0-9]", word) else word
            tokens.append(Token(said, space, at, at + letter * len(said)))
            at += letter * (len(said) + 1)
        chunks.append(Chunk(text, tokens, at))
    return [s._asdict() for s in align(" ".join(texts), chunks)]
