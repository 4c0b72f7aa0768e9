"""Operators over single texts against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import public_tokenizers

from lexweave.llm import bpe, lm, media, quality, secrets, toxicity
from tests.llm.fixtures import corpus, frame, write


def test_bpe_equals_the_library():
    own = bpe.coder()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(1)
    texts = [row[1] or "" for row in corpus()] + ["a" * 3000, " " * 500 + "x", "<|endoftext|>", "\n \n", "it's 'quoted'"]
    texts += ["".join(r.choice(r.choice(["abth ", "éß", "  \n\t ", "!?-", "日本", "012"])) for _ in range(40)) for _ in range(500)]
    for text in texts:
        ids = own.encode(text)
        assert ids.tolist() == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_op6(spark, tmp_path):
    rows = {r.doc_id: r for r in bpe.op6_byte_bpe(spark, write(spark, tmp_path, frame(spark))).collect()}
    for row in corpus():
        text = row[1] or ""
        got = rows[row[0]]
        assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        ids = np.array(bpe.coder().encode(text), "<u4")
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
    empty = write(spark, tmp_path / "none", frame(spark, []))
    assert bpe.op6_byte_bpe(spark, empty).count() == 0
    assert bpe.encode_documents(frame(spark)).where("decoded = 'One two'").count() == 1


def test_media_round_trip_and_carving():
    for text in (None, "", "a" * 191, "é" * 96, "RIFF BM \x89PNG GIF89a" * 40):
        size, payload = media.payload_of(text)
        assert size == len((text or "").encode()) and len(payload) % 192 == 0 and payload
        for kind in media.STORED_AS:
            blob = media.store(payload, kind)
            assert [(m.offset, m.length, m.kind) for m in media.sniff(blob)] == [(0, len(blob), kind)]
            assert media.samples(blob, media.sniff(blob)[0]) == payload
            assert media.corrected_type(blob, "image/gif") == kind
            mixed = b"BM junk " + blob + b"RIFF...." + blob[:-1]
            assert [(m.offset, m.kind) for m in media.sniff(mixed)] == [(8, kind)]
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0, 0x2C, 0, 0, 0, 0, 1, 0, 1, 0, 0, 2, 2, 0x44, 1, 0, 0x3B])
    jpeg = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01\x01\x11\x00\xff\xda\x00\x02\x11\x22\xff\xd9"
    assert [m.detail for m in media.sniff(gif + jpeg)] == ["1x1", "3x2"]
    assert media.sniff(None) == [] and media.corrected_type(b"BM", "x") == "x"


def test_op7(spark, tmp_path):
    rows = media.op7_media_sniffing(spark, write(spark, tmp_path, frame(spark))).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(corpus())
    for row in corpus():
        size, payload = media.payload_of(row[1])
        got = by_id[row[0]]
        assert (got.n_bytes, got.payload_bytes, got.tail_crc32) == (size, len(payload), zlib.crc32(payload[-16:]))
        assert got.payload_sha256 == hashlib.sha256(payload).hexdigest()
    blobs = media.media_of_texts(frame(spark))
    assert media.sniffed(blobs, "media", "doc_id").count() == len(corpus())
    assert blobs.where("declared = type").count() == 0


ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    found = []
    for kind, (name, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))):
        found += [(m.start(), kind, m.end(), name) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


@pytest.mark.parametrize("text", ["token: secret: abcdefghijk", "é password='abcdefgh' x", "API_KEY=short", "apikey : aaaaaaaa.bbb=", "AKIA1234", "f" * 31 + " " + "f" * 40])
def test_secret_patterns(spark, text):
    df = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    base = [s for s in df.first()["secrets"] if s["kind"] < 3]
    assert ",".join(f"{secrets.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in base) == plain_secrets(text)


def plain_peak(s, window):
    best = 0.0
    for i in range(len(s) - window + 1):
        counts = Counter(s[i : i + window]).values()
        best = max(best, -sum(c / window * math.log2(c / window) for c in counts))
    return best


def test_entropy_and_masks(spark):
    from pyspark.sql import functions as F

    strings = ["Zx9Kq2Lm8Vb4Tn7Rw3Yp6Hc1", "aaaaaaaaaaaaaaaaaaaaaaaaaa1Ab", "short", "AbCdEfGh0123AbCdEfGh0123"]
    alphabet = secrets.CLASSES[0].alphabet
    df = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.peak_entropy(F.col("s"), alphabet, 20).alias("h"))
    for r in df.collect():
        assert abs(r.h - plain_peak(r.s, 20)) < 1e-9
    texts = ["key Zx9Kq2Lm8Vb4Tn7Rw3Yp6Hc1 end", "id 123e4567-e89b-12d3-a456-426614174000 x", "nothing here", None, "Zx9Kq2Lm8Vb4Tn7Rw3Yp6EXAMPLE"]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    found = {r.doc_id: r for r in secrets.find_secrets(docs.drop("secrets")).collect()}
    assert [len(found[i].secrets) for i in range(5)] == [1, 0, 0, 0, 0]
    assert found[0].secrets[0]["string"] == "Zx9Kq2Lm8Vb4Tn7Rw3Yp6Hc1"
    clean = {r.doc_id: r for r in secrets.masked(docs.drop("secrets")).collect()}
    assert clean[0].text == "key [SECRET] end" and clean[2].text == "nothing here" and clean[3].text is None


def test_added_spans_equal_a_plain_scan(spark):
    r = random.Random(12)
    pieces = ["0123456789abcdef", "9807915762804490", "1111222211112222", "deadbeefdeadbeef0", "x9kq2lm8vb4tn7rw3yp6hc1", "Zx9Kq2Lm8Vb4Tn7Rw3Yp6Hc1", "F00DBABE12345678F00DBABE9ABCDEF0", "word", "long-words-joined", "0123456789" * 4]
    pieces += ["".join(r.choices(a, k=r.randint(14, 44))) for a in (secrets._HEX, secrets._DIGITS, secrets._SMALL, secrets.CLASSES[0].alphabet) for _ in range(25)]
    texts = ["é ".join(r.choices(pieces, k=r.randint(1, 9))) for _ in range(120)] + [None, "", "token=" + pieces[5]]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    got = {x.doc_id: x for x in secrets.find_secrets(docs).collect()}
    masks = {x.doc_id: x for x in secrets.masked(docs).collect()}
    added = 0
    for i, text in enumerate(texts):
        base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in plain_secrets(text or "").split(",") if x)]
        found = set()
        for c in secrets.CLASSES:
            for m in re.finditer(c.run, text or ""):
                listed = any(re.search(p.replace("^(?i)", "(?i)^"), m[0]) for p in secrets.ALLOWED)
                if all(re.search(p, m[0]) for p in c.needs) and not listed and plain_peak(m[0], c.window) >= c.threshold - 1e-9:
                    found.add(m.span())
        found = {x for x in found if not any(x[0] < b and a < x[1] for a, b in base)}
        found = {x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found)}
        assert {(x["start"], x["end"]) for x in got[i].secrets if x["kind"] == 3} == found, text
        added += len(found)
        clean, at = "", 0
        for a, b in sorted([*base, *found]):
            clean, at = clean + text[at:a] + "[SECRET]" if a >= at else clean, max(at, b)
        assert masks[i].text == (None if text is None else clean + text[at:]) and masks[i].secrets == "own"
    assert added > 60 and secrets.find_secrets(docs.limit(0)).count() == 0


def test_op9(spark, tmp_path):
    rows = {r.doc_id: r for r in secrets.op9_secret_entropy(spark, write(spark, tmp_path, frame(spark))).collect()}
    for row in corpus():
        base = plain_secrets(row[1] or "")
        assert rows[row[0]].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert rows[row[0]].n_hex == base.count("hex:")


def labelled(spark, tmp_path, n=360):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 6 == 0, i % 5 == 0
        words = [r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(60)]
        if toxic:
            words[r.randrange(60)] = "vile"
            words[r.randrange(60)] = "vileness"
        words = [w.upper() + "!!" if bad else w for w in words]
        rows.append((i, ". ".join(" ".join(words[k : k + 10]) for k in range(0, 60, 10)), "en", "a", 1, "9", "x", 1, 7))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, None, None, None, "9", "x", 1, 7), (1001, "", None, None, None, "9", "x", 1, 7), (1002, "long. " * 20_000, None, None, None, "9", "x", 1, 7)]
    labels += [(5000, 1, 1), (None, 1, 0), (1, None, None)]
    return write(spark, tmp_path, frame(spark, rows), labels)


def test_toxicity(spark, tmp_path):
    folder = labelled(spark, tmp_path)
    rows = {r.doc_id: r for r in toxicity.op5_noisy_or_toxicity(spark, folder).collect()}
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == 363
    out = [r for i, r in rows.items() if r.held_out and i < 1000]
    assert out and all(r.predicted == int(r.doc_id % 6 == 0) for r in out)
    assert [rows[i].predicted for i in (1000, 1001, 1002)] == [0, 0, 0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    found = toxicity.offending(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i in range(360) if i % 6 == 0}
    assert all("vile" in r.sentence.lower() for r in found)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 303
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.weights == {}


def test_noisy_or_is_the_product():
    own = toxicity.Scorer(toxicity.Model(-2.0, {f: 3.0 for f in toxicity.features("bad")}, -4.0))
    p = lambda z: 1 / (1 + math.exp(-z))
    assert abs(own.score("good. fine. bad") - (1 - (1 - p(-4)) ** 2 * (1 - p(1)))) < 1e-12
    assert abs(own.score(None) - p(-4)) < 1e-12
    assert own.judged("good. bad")[1] == [(5, 9, p(1))] and own.judged("bad. fine", 0.9)[1] == []


def test_toxicity_of_the_query_equals_plain_python(spark, tmp_path):
    folder = labelled(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.op5_noisy_or_toxicity(spark, folder).collect()
    chance = lambda z: 1 / (1 + math.exp(-z))
    for r, doc in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        clean, carried, text = 1.0, [], doc.text or ""
        spans = [m.span() for m in re.finditer(r"[^.!?\n]+", text) if m[0].strip()] or [(0, 0)]
        for a, b in spans:
            known = {f for w in text[a:b].split() for f in toxicity.features(w) if f in model.weights}
            p = chance(model.bias + sum(model.weights[f] for f in known)) if known else chance(model.clean)
            clean *= 1 - p
            carried += [f"{a}:{b}"] if p >= 0.5 else []
        assert abs(r.score - (1 - clean)) < 1e-9 and r.offending == ",".join(carried)
    again = docs.union(docs)
    twice = toxicity.score_documents(again, model).collect()
    assert len(twice) == 2 * len(rows) and len({(r.doc_id, r.score, r.offending) for r in twice}) == len(rows)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_quality_of_the_query_equals_plain_python(spark, tmp_path):
    import zstandard

    folder = labelled(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r.doc_id: r.score for r in quality.op8_compression_quality(spark, folder).collect()}
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for doc in docs.collect():
        data = (doc.text or "").encode()
        good, bad = (sum(len(p.compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK)) for p in packers)
        x = (bad - good) / (bad + good) if data else 0.0
        assert abs(rows[doc.doc_id] - 1 / (1 + math.exp(-(model.slope * x + model.offset)))) < 1e-9
    again = quality.score_documents(docs.union(docs), model).collect()
    assert len(again) == 2 * docs.count() and len({(r.doc_id, r.score) for r in again}) == docs.count()
    assert quality.score_documents(docs.limit(0), model).count() == 0
    assert quality.spread([b"a", b"b", b"c", b"d"], 2) == [b"a", b"c"] and quality.dictionary([b"xy"]) == b"xy"


def test_quality(spark, tmp_path):
    folder = labelled(spark, tmp_path)
    rows = {r.doc_id: r for r in quality.op8_compression_quality(spark, folder).collect()}
    out = [r for i, r in rows.items() if r.held_out and i < 1000]
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[1000].score == rows[1001].score
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.createDataFrame([], "doc_id long, quality int"))
    assert abs(1 / (1 + math.exp(-model.offset)) - 0.5) < 1e-9


def test_lm_base_and_score(spark, tmp_path):
    rows = {r.doc_id: r for r in lm.op4_context_mixing(spark, write(spark, tmp_path, frame(spark))).collect()}
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter()
    for row in corpus():
        if zlib.crc32(str(row[0]).encode()) % 7 != 2:
            counts.update(tokens(row[1]))
    n, v = sum(counts.values()), len(counts)
    for row in corpus():
        got, own = rows[row[0]], tokens(row[1])
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert abs(got.base_score - sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)) < 1e-6 * len(own)
        assert got.score < 0 and math.isfinite(got.score) and math.isfinite(got.bits_per_byte)
    assert lm.score_documents(frame(spark, [])).count() == 0


def test_lm_is_near_the_best_on_independent_words(spark):
    r = random.Random(6)
    parts = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ou", "ti"]
    vocabulary = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(3000)]
    chance = [1 / (i + 1) for i in range(3000)]
    docs = [(i, " ".join(r.choices(vocabulary, chance, k=150))) for i in range(400)]
    out = [x for x in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect() if x.held_out]
    assert sum(x.score for x in out) > 1.02 * sum(x.base_score for x in out)  # words drawn one by one: the base is the best there is
    assert 1 < sum(x.bits_per_byte for x in out) / len(out) < 3
