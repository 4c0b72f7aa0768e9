"""One statement, two dialects: what Spark runs and what DuckDB runs beside it.

A template is SQL that both engines read, with a few named macros where they differ. Macros are written @name or @name(a | b).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.operators.text import ABBREVIATIONS
from lexweave.plans.registry import register
from lexweave.sources.index import Index

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()



def sentence_sql(words: str, joined: str, escaped) -> str:
    """Sentences from a statement that gives (doc_id, p, i, tok), tok being a word with the blanks after it. A sentence ends at a mark with
    its closers, unless a full stop stands after an abbreviation, a letter or a number, or a small letter follows."""
    mark = escaped(r"([.!?…]+)[\x22\x27”»)\]]*[ \t\r\f]*$")
    word = escaped(r"^[ \t\r\f]*(.*?)[.!?…]+[\x22\x27”»)\]]*[ \t\r\f]*$")
    edges, short = escaped(r"^[(\x22\x27]+"), escaped(r"^(\p{L}|[0-9]+)$")
    short = short.replace("{", "{{").replace("}", "}}")  # the macro is formatted
    known = ", ".join(f"'{a}'" for a in sorted(ABBREVIATIONS))
    like = f"word RLIKE '{short}'" if "listagg" in joined else f"regexp_matches(word, '{short}')"
    small = "lower(substring(nxt, 1, 1)) = substring(nxt, 1, 1) AND upper(substring(nxt, 1, 1)) <> substring(nxt, 1, 1)"
    window = "PARTITION BY doc_id, p ORDER BY i"
    read = f"SELECT doc_id, p, i, tok, regexp_extract(tok, '{mark}', 1) AS mark, regexp_replace(lower(regexp_extract(tok, '{word}', 1)), '{edges}', '') AS word, coalesce(ltrim(lead(tok) OVER ({window})), '') AS nxt FROM ({words}) _w"
    ends = f"SELECT *, CASE WHEN mark <> '' AND NOT (substring(mark, 1, 1) = '.' AND (word IN ({known}) OR {like})) AND NOT ({small}) THEN 1 ELSE 0 END AS e FROM ({read}) _r"
    numbered = f"SELECT *, CAST(coalesce(sum(e) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS j FROM ({ends}) _e"
    return f"(SELECT doc_id, p, j, {joined} AS piece FROM ({numbered}) _n GROUP BY doc_id, p, j)"


#: macro -> (Spark, DuckDB); {0}, {1}, ... are the arguments
MACROS = {
    "words": (r"regexp_extract_all(lower({0}), '\\p{{L}}+', 0)", r"regexp_extract_all(lower({0}), '\p{{L}}+')"),
    "all": ("regexp_extract_all({0}, {1}, {2})", "regexp_extract_all({0}, {1}, {2})"),
    "each": ("explode({0})", "unnest({0})"),
    "at": ("element_at({0}, CAST({1} AS INT))", "{0}[{1}]"),
    "size": ("CAST(size({0}) AS BIGINT)", "CAST(len({0}) AS BIGINT)"),
    "rr": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "join": ("listagg({0}, {1}) WITHIN GROUP (ORDER BY {2})", "string_agg({0}, {1} ORDER BY {2})"),
    "range": ("sequence({0}, {1})", "range({0}, {1} + 1)"),
    "like": ("{0} RLIKE {1}", "regexp_matches({0}, {1})"),
    "xor": ("({0} ^ {1})", "xor({0}, {1})"),
    "distinct": ("array_distinct({0})", "list_distinct({0})"),
    "int": ("CAST({0} AS INT)", "CAST({0} AS BIGINT)"),
    "long": ("CAST({0} AS BIGINT)", "CAST({0} AS BIGINT)"),
    "dot": ("aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)", "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"),
    "json": ("get_json_object({0}, {1})", "json_extract_string({0}, {1})"),
    "hash": ("CAST(conv(substring(md5(CAST({0} AS STRING)), 1, 8), 16, 10) AS BIGINT)", "CAST(('0x' || substring(md5(CAST({0} AS VARCHAR)), 1, 8)) AS BIGINT)"),
    "second": ("CAST(unix_micros(CAST({0} AS TIMESTAMP)) / 1000000 AS BIGINT)", "CAST(floor(epoch_us({0}) / 1000000.0) AS BIGINT)"),
    "text": ("CAST({0} AS STRING)", "CAST({0} AS VARCHAR)"),
    # the sentences of a text by the rules of operators/text.py, each with the blanks after it: none is left out, so that lengths give places
    "pieces": (
        sentence_sql(
            r"SELECT doc_id, p, i, tok FROM documents LATERAL VIEW posexplode(split(text, '\\n')) a AS p, par LATERAL VIEW posexplode(regexp_extract_all(par, '[ \\t\\r\\f]*[^ \\t\\r\\f]+[ \\t\\r\\f]*|[ \\t\\r\\f]+', 0)) b AS i, tok",
            "listagg(tok) WITHIN GROUP (ORDER BY i)",
            lambda pattern: pattern.replace("\\", "\\\\"),
        ),
        sentence_sql(
            r"SELECT doc_id, p, unnest(range(len(ts))) AS i, unnest(ts) AS tok FROM (SELECT doc_id, p, regexp_extract_all(par, '[ \t\r\f]*[^ \t\r\f]+[ \t\r\f]*|[ \t\r\f]+') AS ts FROM (SELECT doc_id, unnest(range(len(pars))) AS p, unnest(pars) AS par FROM (SELECT doc_id, string_split(text, chr(10)) AS pars FROM documents)))",
            "string_agg(tok, '' ORDER BY i)",
            lambda pattern: pattern,
        ),
    ),
    "six": ("format_string('%.6f', CAST({0} AS DOUBLE))", "printf('%.6f', CAST({0} AS DOUBLE))"),
    "part": ("slice({0}, CAST({1} AS INT), CAST({2} AS INT))", "list_slice({0}, {1}, {1} + {2} - 1)"),
    "joined": ("array_join({0}, ' ')", "array_to_string({0}, ' ')"),
    "sorted": ("array_sort({0})", "list_sort({0})"),
    "common": ("array_intersect({0}, {1})", "list_intersect({0}, {1})"),
    "except": ("array_except({0}, {1})", "list_filter({0}, lambda _x: NOT list_contains({1}, _x))"),
    "tokens": (
        r"(SELECT doc_id, pos, term FROM documents LATERAL VIEW posexplode(regexp_extract_all(lower(text), '\\p{{L}}+', 0)) t AS pos, term WHERE length(term) >= 2)",
        r"(SELECT doc_id, pos, term FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents)) WHERE length(term) >= 2)",
    ),
}
_USE = re.compile(r"@(\w+)(\()?")


def render(template: str, dialect: int) -> str:
    """The statement in dialect 0 (Spark) or 1 (DuckDB)."""
    out, place = [], 0
    plain = (lambda part: part.replace("\\", "\\\\")) if dialect == 0 else str  # Spark's literals have escapes
    while found := _USE.search(template, place):
        out.append(plain(template[place : found.start()]))
        body, place = MACROS[found[1]][dialect], found.end()
        args: list[str] = []
        if found[2]:
            depth, start = 1, place
            while depth:
                c = template[place]
                if c == "'":
                    place = template.index("'", place + 1)
                depth += (c == "(") - (c == ")")
                if (c == "|" and depth == 1 and template[place - 1] == " " and template[place + 1] == " ") or not depth:
                    args.append(template[start:place].strip())
                    start = place + 1
                place += 1
        out.append(body.format(*(render(a, dialect) for a in args)))
    return "".join(out) + plain(template[place:])


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that a statement names."""
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


#: Parts of templates that Spark reads from the stored index instead: the first of them stands for all.
STORED: dict[str, str] = {}


#: Views that a query makes of the tables before its statement, by the name that stands for them there.
MADE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def add(name: str, template: str, own: str | None = None) -> None:
    """Registers a template as a query with its SQL. The SQL derives counts and weights from the texts; the query reads them from the
    stored index where the template has the standard counts. own: another statement for the query, of views in MADE."""
    own = template if own is None else own
    indexed = bool(STORED) and next(iter(STORED)) in template
    for derived, stored in STORED.items() if indexed else ():
        own = own.replace(derived, stored)
    made = [view for view in MADE if re.search(rf"\b{view}\b", own)]
    spark_sql = render(own, 0)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, spark_sql)
        if indexed:
            Index.of(spark, sf_dir).views()
        for view in made:
            MADE[view](spark, sf_dir).createOrReplaceTempView(view)
        return spark.sql(spark_sql)

    register(name, query, render(template, 1))
