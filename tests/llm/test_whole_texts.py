"""The language model over whole texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexweave.llm import lm

SCHEMA = "doc_id long, text string"


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 7 == 2


def test_lm_scores_depend_on_the_order_of_words(spark):
    r = random.Random(1)
    docs = []
    for i in range(60):
        start = r.randrange(26)
        docs.append((i, " ".join(chr(97 + (start + k) % 26) * 2 for k in range(60))))
    mixed = docs[0][1].split()
    r.shuffle(mixed)
    docs += [(1000, docs[0][1]), (1000, " ".join(mixed))]  # held out, the same words
    rows = lm.score_documents(spark.createDataFrame(docs, SCHEMA)).where("doc_id = 1000").collect()
    assert all(x.held_out for x in rows) and abs(rows[0].base_score - rows[1].base_score) < 1e-9
    assert max(x.score for x in rows) > min(x.score for x in rows) / 5
    assert max(x.spelled_score for x in rows) > min(x.spelled_score for x in rows) / 2


def test_lm_unseen_words_score_by_their_spelling(spark):
    docs = [(i, "running jumping singing walking") for i in range(40)] + [(1000, "linking"), (1000, "xqzvkwj")]
    rows = lm.score_documents(spark.createDataFrame(docs, SCHEMA)).where("doc_id = 1000").collect()
    assert all(x.n_known == 1 for x in rows) and abs(rows[0].score - rows[1].score) > 1


def test_lm_texts_that_occur_twice_score_apart(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(400)]
    docs = [(i, " ".join(r.choices(vocabulary, k=80))) for i in range(150)]
    docs += [(1000 + i, text) for i, text in docs[:15]]
    rows = lm.score_documents(spark.createDataFrame(docs, SCHEMA)).collect()
    twice = [x.bits_per_byte for x in rows if x.doc_id % 1000 < 15 and not (held(x.doc_id % 1000) and held(x.doc_id % 1000 + 1000)) and not (not held(x.doc_id) and held((x.doc_id + 1000) % 2000))]
    once = [x.bits_per_byte for x in rows if 15 <= x.doc_id < 1000]
    assert max(twice) < 0.7 * min(once)


def test_lm_blocks_make_no_difference(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcde", k=r.randint(1, 4))) for _ in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(80)]
    docs += [(200, "x" * 20_000), (201, None), (None, "a b c"), (202, " ".join(r.choices(vocabulary, k=9000)))]
    frame = spark.createDataFrame(docs, SCHEMA)
    whole = {r.doc_id: r for r in lm.score_documents(frame).collect()}
    for name, value in (("BLOCK", 3_000), ("WINDOWS", 9_000), ("PAIRS", 20_000), ("WORDS", 20_000), ("CHUNK", 500)):
        monkeypatch.setattr(lm, name, value)
    dealt = {r.doc_id: r for r in lm.score_documents(frame).collect()}
    assert dealt.keys() == whole.keys()
    for i, a in whole.items():
        b = dealt[i]
        assert (a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens) and abs(a.base_score - b.base_score) < 1e-6
        assert abs(a.spelled_score - b.spelled_score) < 1e-3 * abs(a.spelled_score)
        assert abs(a.score - b.score) < 0.1 * abs(a.score) + 1  # a block sends two successors only


def plain_windows(stream):
    data = b" " * 5 + stream
    return [data[i - 5 : i + 1] for i in range(5, len(data))]


def plain_contexts(window):
    before = window[:5]
    word = before[before.rfind(b" ") + 1 :] if b" " in before else before
    return [(k, before[5 - k :]) for k in (1, 2, 3, 4, 5)] + [(0, word)] if word and len(word) > 1 else [(k, before[5 - k :]) for k in (1, 2, 3, 4, 5)] + [(1, before[4:])]


def test_lm_inputs_and_bits_equal_a_plain_mixer():
    r = random.Random(5)
    streams = [lm.stream(["".join(r.choices("abc", k=r.randint(1, 7))).encode() for _ in range(12)]) for _ in range(20)]
    counts = Counter(w for s in streams for w in plain_windows(s))
    window = np.unique(lm.windows(streams))
    c = np.array([counts[int(w).to_bytes(6, "big")] for w in window], np.int64)
    assert sum(counts.values()) == c.sum() and len(counts) == len(window)
    table = defaultdict(Counter)
    for w, times in counts.items():
        for key in set(plain_contexts(w)):
            table[key][w[5]] += times
    pairs = np.zeros(1 << 16, np.int64)
    np.add.at(pairs, (window & np.uint64(0xFFFF)).astype(np.int64), c)

    def sums(f):
        return sum(f(x, gate, bit, node, c / c.sum()) for x, gate, bit, node in lm.predicted(window, c, pairs, True))

    model = lm.learned(lm.untrained(), sums)
    logs = lm.byte_logs(window, c, pairs, model)
    for i in r.sample(range(len(window)), 60):
        raw = int(window[i]).to_bytes(6, "big")
        for row, leave in enumerate((1, 0)):
            log = 0.0
            for k in range(8):
                bit, x, sure = raw[5] >> (7 - k) & 1, [], []
                for key in plain_contexts(raw):
                    n = [sum(t for b, t in table[key].items() if b >> (7 - k) == (raw[5] >> (8 - k) << 1 | v)) for v in (0, 1)]
                    n[bit] -= leave
                    x.append(math.log((n[1] + 0.02) / (n[0] + 0.02)))
                    sure.append(sum(n))
                gate = sum(sure[4] >= g for g in lm.GATES_5) * 4 + sum(sure[2] >= g for g in lm.GATES_3)
                z = sum(a * b for a, b in zip([*x, 0.3], model.weights[gate], strict=True))
                p = min(max(1 / (1 + math.exp(-z)), 1e-6), 1 - 1e-6)
                at = min(max((math.log(p / (1 - p)) + 12) * 32 / 24, 0), 32 - 0.001)
                cells = model.refined[1 << k | raw[5] >> (8 - k)]
                p = (p + cells[int(at)] * (1 - at % 1) + cells[int(at) + 1] * (at % 1)) / 2
                log += math.log(p if bit else 1 - p)
            assert abs(log - logs[row, i]) < 1e-6


def test_lm_bytes_are_a_distribution():
    seen = lm.windows([lm.stream([b"ab", b"abc", b"b"] * 3)])
    keys, c = np.unique(seen, return_counts=True)
    every = np.arange(256, dtype=np.uint64) | np.uint64(int.from_bytes(b"   ab", "big") << 8)
    window = np.unique(np.r_[keys, every])
    counts = np.zeros(len(window), np.int64)
    counts[np.searchsorted(window, keys)] = c
    pairs = np.zeros(1 << 16, np.int64)
    np.add.at(pairs, (keys & np.uint64(0xFFFF)).astype(np.int64), c)
    logs = lm.byte_logs(window, counts, pairs, lm.untrained())
    assert abs(np.exp(logs[1, np.searchsorted(window, every)]).sum() - 1) < 1e-9


def test_lm_repeats_equal_plain_counts():
    r = random.Random(6)
    texts = [" ".join(r.choices("abcd", k=r.randint(0, 30))) for _ in range(12)]
    out = np.array([i % 4 == 1 for i in range(12)])
    own = lm.Block(texts, out)
    _, which, words, counts, total = own.pairs()
    gate, hit = lm.foretold((own.word >> np.uint64(48)).astype(np.uint32), words[which], counts[which], total[which], own.own)
    after, places = defaultdict(list), []
    for i, text in enumerate(texts):
        tokens = [*text.split(), "\n"]
        for k, w in enumerate(tokens):
            key = tuple([None, None, *tokens][k : k + 2])
            places.append((i, key, w))
            if not out[i]:
                after[key].append(w)
    hashes = {w: int(lm.Block([w], np.zeros(1, bool)).word[0]) >> 48 for w in [*"abcd", "\n"]}
    for n, (i, key, w) in enumerate(places):
        seen = Counter(after[key])
        top = sorted(seen, key=lambda x: (-seen[x], hashes[x]))[:2]
        if not out[i]:
            seen[w] -= 1
        best = max(top, key=lambda x: (seen[x], -top.index(x)), default=None)
        if best is None or seen[best] == 0:
            assert gate[n] == lm.NO_GATE and not hit[n]
            continue
        times, whole = seen[best], sum(seen.values())
        assert gate[n] == (sum(times >= s for s in lm.SEEN) - 1) * 3 + (2 * times > whole) + (times == whole), (n, key, w)
        assert hit[n] == (best == w)
    every = lm.hit_counts(counts, total)
    mine = own.own == 1
    assert np.array_equal(every[0], np.bincount(gate[mine], minlength=lm.NO_GATE + 1))
    assert np.array_equal(every[1], np.bincount(gate[mine], hit[mine], minlength=lm.NO_GATE + 1))


def test_lm_counts_of_repeats_are_whole():
    """Counts over a byte in a block and over two bytes in the corpus come back as they are."""
    text = "p q r " * 70_000 + "p q s " * 400 + "u v w " * 300
    texts = [pa.table({"block": [i], "doc_id": [i], "held": [False], "text": [text]}) for i in range(2)]
    back = lm._answered_pairs(pa.concat_tables([lm._sent(t, (1, 1, 1)) for t in texts]).filter(pc.field("kind") == 1))
    keys, _, words, counts, total = lm._block(texts[0]).pairs()
    (told,) = [c for block, c in zip(back["block"].to_pylist(), lm.blobs(back, "counts"), strict=True) if block == 0]
    size = -(-len(keys) // 8)
    at = np.unpackbits(np.frombuffer(told, np.uint8, size))[: len(keys)] > 0
    numbers = lm.unplaned(told[size:], 4, np.uint32).reshape(3, -1).T.astype(int).tolist()
    assert numbers == [[2 * t, 2 * a, 2 * b] for t, (a, b) in zip(total[at].tolist(), counts[at].tolist(), strict=True)]
    assert [140_800, 140_000, 800] in numbers and [600, 598, 2] in numbers or [600, 600, 0] in numbers


def test_lm_online_update_equals_a_plain_loop():
    r = np.random.default_rng(7)
    texts = [" ".join("w" for _ in range(n)) for n in (0, 5, 15, 16, 70)]
    own = lm.Block(texts, np.zeros(5, bool))
    n = len(own.word)
    gate = r.choice([0, 4, lm.NO_GATE], n)
    hit = (r.random(n) < 0.5) & (gate != lm.NO_GATE)
    chance, frequency, spelled = r.random(lm.NO_GATE + 1), r.random(n), np.log(r.random(n))
    got, at = lm.coded(own, gate, hit, chance, frequency, spelled, 0.7), 0
    for i, size in enumerate(own.sizes.tolist()):
        bias = total = 0.0
        weight = math.log(0.7 / 0.3)
        for start in range(0, size, lm.STRIDE):
            pull = lean = 0.0
            for k in range(at + start, at + min(size, start + lm.STRIDE)):
                p = 1 / (1 + math.exp(-(math.log(chance[gate[k]] / (1 - chance[gate[k]])) + bias)))
                a, both = 1 / (1 + math.exp(-weight)), None
                if gate[k] != lm.NO_GATE:
                    total += math.log(p if hit[k] else 1 - p)
                    pull += hit[k] - p
                if not hit[k]:
                    both = a * frequency[k] + (1 - a) * math.exp(spelled[k])
                    total += math.log(both)
                    lean += a * frequency[k] / both - a
            bias, weight = bias + lm.BIAS_RATE * pull, weight + lm.WEIGHT_RATE * lean
        at += size
        assert abs(total - got[i]) < 1e-4 * max(1, abs(total))


def test_lm_empty_tables(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = lm.score_documents(spark.createDataFrame([(1000, "all held out")], SCHEMA)).collect()
    assert row.held_out and row.train_tokens == 0 and math.isfinite(row.score)
    assert lm._table([], lm._OUT).num_rows == 0 and isinstance(lm._table([], lm._SENT), pa.Table)


def test_toxicity_remembers_a_bounded_number_of_words():
    from lexweave.llm import toxicity

    known = toxicity.features("bad")[0]
    scorer = toxicity.Scorer(toxicity.Model(-2.0, {known: 5.0}, -4.0))
    text = ". ".join(f"word{i}" for i in range(150_000)) + ". bad"
    assert scorer.logits(text) == (150_000, [(len(text) - 4, len(text), 3.0)])
    assert len(scorer.known) <= 1 << 16
    assert len({id(x) for w, x in scorer.known.items() if w != "bad"}) == 1


def test_how_texts_are_dealt_changes_no_score(spark, monkeypatch):
    """A word that is third after two others in each block can be the commonest of all."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "c", "d", "e"], 30))) for i in range(60)], SCHEMA).cache()
    one = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK", 300)
    monkeypatch.setattr(lm, "PAIRS", 1000)
    many = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    assert len(one) == 60 and all(abs(one[i] - many[i]) < 1e-6 for i in one)
