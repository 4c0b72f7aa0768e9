"""The filter audit against a walk of every order, document by document."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb

from lexweave.llm import audit
from tests.llm.fixtures import SCHEMA, corpus, frame, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def truth(rows, labels):
    least, out = {}, defaultdict(Counter)
    for row in rows:
        if row[0] is not None:
            least[row[1] or ""] = min(row[0], least.get(row[1] or "", row[0]))
    good, toxic = ({d for d, *y in labels if y[i] == 1 and d is not None} for i in (0, 1))
    for order in map("".join, permutations("ABCDE")):
        for i, text, lang, *_ in rows:
            text = text or ""
            words = WORD.findall(text)
            fails = {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)),
                "E": i is not None and i > least[text],
            }
            gone = False
            for step, f in enumerate(order, start=1):
                c = out[lang or "", order, step]
                removed = fails[f] and not gone
                c.update(kept=not gone and not removed, removed=removed, redundant=fails[f] and gone, unique_fails=fails[f] and sum(fails.values()) == 1)
                c.update(good_lost=removed and i in good, toxic_lost=removed and i in toxic)
                gone = gone or removed
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    return {(part, order, step): (*(int(c[k]) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[part, order[step - 1]]) for (part, order, step), c in out.items()}


def case():
    r = random.Random(6)
    rows = corpus()
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long + " #", long.upper(), "aa bb " * 150, "AA | " * 120, "", None, "short"]
    for i in range(80):
        rows.append((200 + i, r.choice(texts), r.choice(["en", "de", None, ""]), None, None, None, None, None, None))
    rows += [(None, long, "en", *[None] * 6), (None, long, "de", *[None] * 6), (None, None, None, *[None] * 6)]
    rows += [rows[-20], rows[-20]]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, 2, None])) for i in range(0, 260, 2)] + [(10, 1, 0), (10, 0, 1), (None, 1, 1)]
    return rows, labels


def test_audit(spark, tmp_path):
    rows, labels = case()
    folder = write(spark, tmp_path, frame(spark, rows), labels)
    got = audit.op13_filter_audit(spark, folder)
    assert [c for c, t in got.dtypes if t == "bigint"] == ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(got.dtypes)["step"] == "int"
    found = [tuple(r) for r in got.collect()]
    assert {r[:3]: r[3:] for r in found} == truth(rows, labels) and len(found) == 600 * 3
    base = duckdb.connect()
    for t in ("documents", "labels"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert sorted(base.execute(audit.OP13_SQL).fetchall()) == sorted(found)


def test_audit_of_nothing(spark, tmp_path):
    assert audit.op13_filter_audit(spark, write(spark, tmp_path, spark.createDataFrame([], SCHEMA))).count() == 0


def test_audit_has_no_python(spark, tmp_path):
    rows, labels = case()
    plan = audit.op13_filter_audit(spark, write(spark, tmp_path, frame(spark, rows), labels))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
