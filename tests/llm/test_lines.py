"""Line labelling: base counts against plain scans, the field against walks over all labellings, the query on held-out documents."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from lexweave.llm import lines
from tests.llm.fixtures import SCHEMA, corpus, frame, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 5)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def texts():
    r = random.Random(12)
    out = [row[1] for row in corpus()] + ["a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e g a b c d", "one\n\ntwo\none\n one\none", "ä é ß x \x1c \x85 y", "#*$%&|<> & |", "\r\nA\r\nA\r\n", "é" * 5000 + " " + "w " * 9]
    for _ in range(150):
        out.append("".join(r.choice("ab \n") for _ in range(r.randint(0, 120))))
        out.append(" ".join(r.choice("uvwxyz") for _ in range(r.randint(0, 60))))
    return out


def test_base_counts():
    for text in texts():
        x = lines.read(text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(text), text
        assert x.words.sum() == x.n_words and len(x.features) == len(x.at) == sum(bool(WORD.search(s)) for s in (text or "").split("\n"))


def score(field, features, labels):
    return sum((features[i] @ field.line) * y for i, y in enumerate(labels)) + sum(field.step[a, b] for a, b in itertools.pairwise(labels))


def test_decoding_and_probabilities_are_those_of_all_labellings():
    r = np.random.default_rng(5)
    documents = [r.standard_normal((n, lines.FEATURES)) for n in (1, 2, 3, 7, 5, 1)]
    field = lines.Field(r.standard_normal(lines.FEATURES) / 3, r.standard_normal((2, 2)))
    chains = lines.Chains(documents)
    log_p, by_line, by_step = chains.moments(field)
    for place, i in enumerate(chains.order):
        x = documents[i]
        every = {y: score(field, x, y) for y in itertools.product((0, 1), repeat=len(x))}
        assert tuple(lines.decode(field, x)) == max(every, key=every.get)
        log_z = np.logaddexp.reduce(list(every.values()))
        assert np.isclose(log_p[place], every[(0,) * len(x)] - log_z)
        e = 1e-5
        for k in (0, 4):  # the gradient, by differences
            up = lines.Field(field.line + e * np.eye(lines.FEATURES)[k], field.step)
            assert np.isclose((chains.moments(up)[0][place] - log_p[place]) / e, by_line[place, k], atol=1e-3)
        for a, b in itertools.product((0, 1), repeat=2):
            step = field.step.copy()
            step[a, b] += e
            assert np.isclose((chains.moments(lines.Field(field.line, step))[0][place] - log_p[place]) / e, by_step[place, a, b], atol=1e-3)
    assert lines.decode(lines.Field(np.zeros(lines.FEATURES), np.zeros((2, 2))), documents[3]) == [0] * 7  # ties


def marked(n=400):
    """Good documents of sentences; bad ones hold lines of menus, shouting or signs in random places."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(r.randint(4, 12))).capitalize() + "."
    junk = [lambda: " | ".join(word() for _ in range(20)), lambda: " ".join(word().upper() + "!!" for _ in range(20)), lambda: " ".join(word() + r.choice(["$$$", "###"]) for _ in range(20))]
    rows, labels, truth = [], [], {}
    for i in range(n):
        own = [(line(), True) for _ in range(r.randint(2, 8))]
        if i % 4 == 0:
            kind = r.choice(junk)
            own += [(kind(), False) for _ in range(r.randint(3, 6))]
            r.shuffle(own)
        rows.append((i, "\n".join(t for t, _ in own), *[None] * 7))
        labels.append((i, int(i % 4 > 0), 0))
        truth[i] = own
    return rows, labels, truth


def test_lines_and_documents_out_of_the_sample(spark, tmp_path):
    rows, labels, truth = marked()
    folder = write(spark, tmp_path, frame(spark, rows), labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    field = lines.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    again = lines.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert (field.line == again.line).all() and (field.step == again.step).all()
    right = total = 0
    for r in lines.label_lines(docs, field).collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            right += sum(x.content == y for x, (_, y) in zip(r.lines, truth[r.doc_id], strict=True))
            total += len(r.lines)
    assert right > 0.97 * total
    found = {r.doc_id: r for r in lines.op11_line_labelling(spark, folder).collect()}
    for i, text, *_ in rows:
        x, share = found[i], sum(len(t.split()) for (t, _), y in zip(truth[i], lines.decode(field, lines.read(text).features), strict=True) if not y) / len(text.split())
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(text)
        assert np.isclose(x.content_share, share) and x.kept == (not x.base_failed and share >= lines.KEEP)
        assert x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    kept = {i for i, x in found.items() if x.held_out and x.kept}
    assert sum((i % 4 > 0) == (i in kept) for i, x in found.items() if x.held_out) > 0.97 * sum(x.held_out for x in found.values())


def test_edges(spark, tmp_path):
    folder = write(spark, tmp_path, frame(spark), [(1, None, 0), (2, 1, 1), (None, 0, 0)])  # one class only: all lines are content
    found = lines.op11_line_labelling(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=str) == sorted(((row[0], *base(row[1])) for row in corpus()), key=str)
    assert all(r.kept == (not r.base_failed) for r in found)
    empty = tmp_path / "none"
    assert lines.op11_line_labelling(spark, write(spark, empty, spark.createDataFrame([], SCHEMA))).count() == 0
    assert lines.decode(lines.OPEN, np.zeros((0, lines.FEATURES))) == []
