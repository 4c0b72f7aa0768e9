"""Formulas as words: a reader of LaTeX and plain mathematical signs.

A formula is cut into tokens and read by recursive descent into words as it goes: fractions, roots, accents, scripts, sums with limits,
functions of something, conditions after a bar. What can't be read, such as braces that don't close or a command that isn't known, gives None, so that the
caller keeps the formula as it stands.
"""

from __future__ import annotations

import re

GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
#: Greek letters by their signs, and capitals that differ from Latin ones.
GREEK_SIGNS = dict(zip("αβγδεζηθικλμνξπρστυφχψω", GREEK, strict=True)) | {k.upper(): f"big {n}" for k, n in zip("γδθλξπσφψω", "gamma delta theta lambda xi pi sigma phi psi omega".split(), strict=True)}
SIGNS = {
    "=": "equals", "+": "plus", "-": "minus", "−": "minus", "*": "times", "/": "over", "<": "less than", ">": "greater than", "≤": "less than or equal to", "≥": "greater than or equal to",
    "≠": "not equal to", "≈": "approximately", "~": "approximately", "±": "plus or minus", "×": "times", "·": "times", "∈": "in", "∞": "infinity", "→": "to", "∑": "the sum", "∏": "the product", "√": "square root of", ",": ",", ".": ".", ":": ":", ";": ";", "!": "factorial", "'": "prime",
}
COMMANDS = {
    "le": "less than or equal to", "leq": "less than or equal to", "ge": "greater than or equal to", "geq": "greater than or equal to", "ne": "not equal to", "neq": "not equal to", "approx": "approximately", "sim": "approximately",
    "pm": "plus or minus", "times": "times", "cdot": "times", "in": "in", "infty": "infinity", "to": "to", "rightarrow": "to", "mid": "given", "cup": "union", "cap": "intersection", "subset": "a subset of", "forall": "for all", "exists": "there is", "partial": "partial", "nabla": "gradient of", "ldots": "and so on", "dots": "and so on", "ell": "l",
}
FUNCTIONS = {n: n for n in "log sin cos tan exp max min det dim".split()} | {"ln": "natural log", "lim": "the limit", "argmax": "arg max", "argmin": "arg min", "softmax": "softmax"}
BIG = {"sum": "the sum", "prod": "the product", "int": "the integral"}
ACCENTS = {"hat": "hat", "bar": "bar", "tilde": "tilde", "vec": "vector", "dot": "dot"}
PLAIN = {"mathbf", "mathbb", "mathcal", "mathrm", "text", "boldsymbol", "operatorname", "mathit"}
SPACES = {",", ";", "!", ":", " ", "quad", "qquad", "left", "right", "displaystyle"}
SUPERSCRIPTS = {"⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9"}
TOKEN = re.compile(r"\\([A-Za-z]+|.)|(\d+(?:\.\d+)?)|(\s+)|(.)", re.S)


class Unreadable(ValueError):
    pass


def number(text: str) -> str:
    """3.05 as 3 point 0 5."""
    whole, _, part = text.partition(".")
    return f"{whole} point {' '.join(part)}" if part else whole


class Reader:
    def __init__(self, text: str):
        for sign, digit in SUPERSCRIPTS.items():
            text = text.replace(sign, f"^{digit}")
        self.tokens = [("command", m[1]) if m[1] else ("number", m[2]) if m[2] else ("sign", m[4]) for m in TOKEN.finditer(text) if not m[3]]
        self.at = 0

    def peek(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in [("sign", w) for w in wanted]:
            self.at += 1
            return True
        return False

    def read(self) -> str:
        words = self.row(())
        if self.peek() is not None:
            raise Unreadable(self.peek()[1])
        return words

    def row(self, ends: tuple[str, ...]) -> str:
        """Items up to a sign that ends them, which stays."""
        out = []
        while (t := self.peek()) is not None and not (t[0] == "sign" and t[1] in ends):
            if t[0] == "sign" and t[1] in "})]":
                raise Unreadable(t[1])
            out.append(self.item())
        return " ".join(w for w in out if w)

    def group(self) -> str:
        """A braced row, or one item without scripts."""
        if self.take("{"):
            words = self.row(("}",))
            if not self.take("}"):
                raise Unreadable("{")
            return words
        return self.base()

    def item(self) -> str:
        if self.peek()[0] == "command" and self.peek()[1] in BIG:
            return self.big()
        base, scripts = self.base(), []
        while (mark := self.peek()) in (("sign", "^"), ("sign", "_")):
            self.at += 1
            raised = self.group()
            if mark[1] == "_":
                scripts.append(f"sub {raised}")
            else:
                scripts.append({"2": "squared", "3": "cubed", "T": "transpose", "top": "transpose", "minus 1": "inverse", "prime": "prime"}.get(raised, f"to the {raised}"))
        words = " ".join([base, *scripts])
        if self.callable and self.peek() == ("sign", "("):
            return f"{words} of {self.brackets()}"
        return words

    def big(self) -> str:
        words = BIG[self.peek()[1]]
        self.at += 1
        for mark, word in (("_", "from"), ("^", "to"), ("_", "from")):
            if self.take(mark):
                words += f" {word} {self.group()}"
        return f"{words} of"

    def brackets(self) -> str:
        close = {"(": ")", "[": "]"}[self.peek()[1]]
        self.at += 1
        ends = (close, "|") if self.bars(close) == 1 else (close,)
        words = self.row(ends)
        if self.take("|"):
            words += f" given {self.row((close,))}"
        if not self.take(close):
            raise Unreadable(close)
        return words

    def bars(self, close: str) -> int:
        """Bars before the bracket closes: one parts a condition, two stand around a size."""
        depth, count = 0, 0
        for kind, text in self.tokens[self.at :]:
            depth += (kind == "sign" and text in "([{") - (kind == "sign" and text in ")]}" and depth > 0)
            if kind == "sign" and depth == 0 and text == close:
                break
            count += kind == "sign" and depth == 0 and text == "|"
        return count

    def base(self) -> str:
        token = self.peek()
        if token is None:
            raise Unreadable("end")
        kind, text = token
        self.callable = False
        if kind == "sign" and text in "([":
            return self.brackets()
        if kind == "sign" and text == "{":
            return self.group()
        self.at += 1
        if kind == "number":
            return number(text)
        if kind == "command":
            return self.command(text)
        if text == "|":
            words = self.row(("|",))
            if not self.take("|"):
                raise Unreadable("|")
            return f"the size of {words}"
        if text == "√":
            return f"square root of {self.group()}"
        if text in SIGNS:
            return SIGNS[text]
        if text in GREEK_SIGNS or text.isalpha():
            self.callable = True
            word = text
            while text.isascii() and (t := self.peek()) and t[0] == "sign" and t[1].isascii() and t[1].isalpha() and self.named(word + t[1]):
                word += t[1]
                self.at += 1
            return GREEK_SIGNS.get(text, FUNCTIONS.get(word, word))
        raise Unreadable(text)

    def named(self, start: str) -> bool:
        """Whether the letters from here on begin the name of a function that follows whole."""
        rest = "".join(t[1] for t in self.tokens[self.at - len(start) + 1 : self.at + 8] if t[0] == "sign")
        return any(n.startswith(start) and rest.startswith(n) for n in FUNCTIONS if len(n) > 1)

    def command(self, name: str) -> str:
        if name in ("frac", "tfrac", "dfrac"):
            return f"{self.group()} over {self.group()}"
        if name == "sqrt":
            if self.peek() == ("sign", "["):
                return f"{self.brackets()} root of {self.group()}"
            return f"square root of {self.group()}"
        if name in ACCENTS:
            words = f"{self.group()} {ACCENTS[name]}"
            self.callable = True
            return words
        if name in PLAIN:
            words = self.letters() if name in ("text", "mathrm", "operatorname") else self.group()
            self.callable = True
            return words
        if name in SPACES:
            return ""
        if name.lower() in GREEK:
            self.callable = True
            return name if name.islower() else f"big {name.lower()}"
        if name in FUNCTIONS:
            self.callable = True
            return FUNCTIONS[name]
        if name == "top":
            return "top"
        if name in COMMANDS:
            return COMMANDS[name]
        if name in ("{", "}", "|"):
            return ""
        raise Unreadable(name)

    def letters(self) -> str:
        """A braced stretch as one word."""
        if not self.take("{"):
            return self.base()
        out = ""
        while (t := self.peek()) is not None and t != ("sign", "}"):
            out += t[1]
            self.at += 1
        if not self.take("}"):
            raise Unreadable("{")
        return out


def read(text: str) -> str | None:
    """The words of a formula; None where it can't be read."""
    try:
        words = Reader(text.strip()).read()
    except (Unreadable, RecursionError):
        return None
    words = re.sub(r"\b([OΘ]) of\b", lambda m: f"big {'theta' if m[1] == 'Θ' else 'O'} of", words)
    return re.sub(r" ([,.;:])", r"\1", re.sub(r"\s+", " ", words)).strip() or None
