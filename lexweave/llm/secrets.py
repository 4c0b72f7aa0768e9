"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings, in built-in expressions only.

A candidate is a run of the characters of a class: mixed base64, upper and lower hexadecimal, digits, and lower letters with digits,
each with a window and a threshold of its own. Its entropy in each window of `window` characters is log2(w) - S/w with
S = sum of c*log2(c) over the characters' counts in the window; moving the window by one changes one count down and one up, so
that S is carried along. A candidate is a secret where some window reaches the class's threshold, unless the allow list has it as a whole,
a span of a pattern overlaps it or a longer candidate that is a secret covers it.

Null and empty texts have no spans; positions are code points of the whole text, however long; spans that start together go by kind,
then by end. Each input row gives one row, repeated rows repeated ones, an empty table none; a column named `secrets` is replaced by
find_secrets and kept by masked; further columns are left aside.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import documents

#: Fixed patterns: kind, pattern, group that is measured, least length of that group.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The same runs, for a quick look whether a text has any that is long enough.
PRESENT = (PATTERNS[0][1], r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")


@dataclass(frozen=True)
class CharacterClass:
    name: str
    run: str  # a run of its characters that is long enough to be a candidate
    needs: tuple[str, ...]  # patterns that a candidate must hold
    alphabet: str
    window: int
    threshold: float  # bits a character


_HEX, _DIGITS, _SMALL = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"
_ALONE = lambda run: rf"(?<![A-Za-z0-9]){run}+(?![A-Za-z0-9])"  # noqa: E731  not within a longer word
CLASSES = (
    CharacterClass("base64", r"[A-Za-z0-9+/_=-]{20,}", ("[0-9]", "[a-z]", "[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.7),
    CharacterClass("uphex", _ALONE("[0-9A-F]{32,}"), ("[0-9]", "[A-F]"), _HEX.upper(), 32, 3.0),
    CharacterClass("lowhex", _ALONE("[0-9a-f]{16,}"), ("[0-9]", "[a-f]"), _HEX, 16, 2.9),
    CharacterClass("digits", _ALONE("[0-9]{16,}"), (), _DIGITS, 16, 2.7),
    CharacterClass("small", _ALONE("[a-z0-9]{20,}"), ("[0-9]", "[a-z]"), _SMALL, 20, 3.5),
)
#: Whole strings that look random and are public: UUIDs, words joined by signs, sample keys that end in EXAMPLE, sequences for tests.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z0-9+/_=-]*EXAMPLE(KEY)?$",
    r"^[A-Za-z]+([-_/][A-Za-z]+)+$",
    r"^(?i)(0123456789(abcdef)?|1234567890(abcdef)?)+[0-9a-f]{0,15}$",
)


KINDS = (*(kind for kind, *_ in PATTERNS), "entropy")
_SPANS = "array<struct<start:int,kind:int,end:int,string:string>>"


def _no_spans() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def with_matches(df: DataFrame, text: str, name: str, pattern: str, group: int, least: int, order: int, present: str) -> DataFrame:
    """Adds the spans of the leftmost non-overlapping matches whose group is long enough. What stands between matches gives their places;
    only texts in which `present` is found are searched."""
    has, gap, hit, part = (f"{name}_{x}" for x in ("has", "gap", "hit", "part"))
    column = F.col(text)
    df = df.withColumn(has, F.coalesce(column.rlike(present), F.lit(False)))
    df = df.withColumns({
        gap: F.when(F.col(has), F.split(column, pattern, -1)),
        hit: F.when(F.col(has), F.regexp_extract_all(column, F.lit(pattern), F.lit(0))),
        part: F.when(F.col(has), F.regexp_extract_all(column, F.lit(pattern), F.lit(group))),
    })

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x[gap])
        end = start + F.coalesce(F.length(x[hit]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), x[hit].alias("string"))
        return F.struct(end.alias("at"), F.when(F.length(x[part]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), _no_spans().alias("out"))
    spans = F.aggregate(F.arrays_zip(gap, hit, part), first, step, lambda state: state["out"])
    return df.withColumn(name, F.coalesce(spans, _no_spans())).drop(has, gap, hit, part)


def peak_entropy(string: Column, alphabet: str, window: int) -> Column:
    """The highest entropy of a window of the string, in bits a character; 0 where the string is shorter than the window."""
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c))
    moves = F.slice(F.arrays_zip(codes, F.concat(F.array_repeat(F.lit(0), window), codes)), 1, F.length(string))
    weigh = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)

    def moved(counts: Column, at: Column, by: int) -> Column:
        """One count changed, the others as they are."""
        new = F.concat(F.slice(counts, 1, at - 1), F.array(F.get(counts, at - 1) + by), F.slice(counts, at + 1, F.lit(len(alphabet)) - at))
        return F.when(at > 0, new).otherwise(counts)

    def step(state: Column, x: Column) -> Column:
        more, less = F.get(state["counts"], x["0"] - 1), F.get(state["counts"], x["1"] - 1)
        counts = F.when(x["0"] == x["1"], state["counts"]).otherwise(moved(moved(state["counts"], x["0"], 1), x["1"], -1))
        total = state["sum"] + F.when(x["0"] == x["1"], 0.0).otherwise(weigh(more + 1) - weigh(more) + F.when(x["1"] > 0, weigh(less - 1) - weigh(less)).otherwise(0.0))
        seen = state["seen"] + 1
        peak = F.when(seen >= window, F.greatest(state["peak"], F.lit(math.log2(window)) - total / window)).otherwise(state["peak"])
        return F.struct(counts.alias("counts"), total.alias("sum"), seen.alias("seen"), peak.alias("peak"))

    first = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(0.0).alias("peak"))
    return F.aggregate(moves, first, step, lambda state: state["peak"])


def _likely(c: CharacterClass, allowed: tuple[str, ...]) -> Callable[[Column], Column]:
    def fits(x: Column) -> Column:
        needed = [x["string"].rlike(p) for p in c.needs]
        known = [~x["string"].rlike(p) for p in allowed]
        return functools.reduce(lambda a, b: a & b, needed + known)

    return fits


def _random(c: CharacterClass) -> Callable[[Column], Column]:
    return lambda x: peak_entropy(x["string"], c.alphabet, c.window) >= c.threshold - 1e-9


def find_secrets(docs: DataFrame, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The rows of docs with `secrets`: array<struct<start,kind,end,string>> by start, kind; kind is a place in KINDS. A column of that
    name is replaced; others may have any name."""
    entropy, added = len(PATTERNS), []
    own = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "secrets")).alias("row"), docs[text].alias("text"))
    for order, ((kind, pattern, group, least), present) in enumerate(zip(PATTERNS, PRESENT, strict=True)):
        own = with_matches(own, "text", kind, pattern, group, least, order, present)
    own = own.withColumn("base", F.concat(*(kind for kind, *_ in PATTERNS))).drop(*(kind for kind, *_ in PATTERNS))
    for c in classes:
        own = with_matches(own, "text", c.name, c.run, 0, c.window, entropy, c.run)
        own = own.withColumn(c.name, F.filter(c.name, _likely(c, allowed)))
        own = own.withColumn(c.name, F.filter(c.name, _random(c)))
        added.append(c.name)
    own = own.withColumn("added", F.array_distinct(F.concat(*added))).drop(*added)
    own = own.withColumn("added", F.filter("added", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    longer = lambda y, x: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (x["end"] - x["start"] < y["end"] - y["start"])
    own = own.withColumn("added", F.filter("added", lambda x: ~F.exists("added", lambda y: longer(y, x))))
    return own.select("row.*", F.array_sort(F.concat("base", "added")).alias("secrets"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each secret in its text replaced by [SECRET]; overlapping secrets become one. Other texts stay as they are."""
    own = docs.select(F.struct("*").alias("row"), docs[text].alias("text"))
    found = find_secrets(own)

    def step(state: Column, x: Column) -> Column:
        at = F.greatest(state["at"], x["start"])
        piece = F.substring(F.col("text"), state["at"] + 1, at - state["at"])
        mask = F.when(x["start"] >= state["at"], F.concat(piece, F.lit("[SECRET]"))).otherwise("")
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], mask).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("secrets", first, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length(F.col("text")))))
    new = F.when(F.size("secrets") > 0, clean).otherwise(F.col("text"))
    return found.select(*((new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op9_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < len(PATTERNS))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(PATTERNS)),
        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("secrets")).alias("spans"),
    )
