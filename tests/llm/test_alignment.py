"""Alignment of two tokenizers against a walk over tokens, group by group."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, decoders

from lexweave.llm import alignment
from tests.llm.fixtures import corpus, frame

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTER = {}
for byte in range(256):  # the letter of each byte, found by encoding it
    printable = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
    LETTER[chr(byte) if printable else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174) for x in range(byte)))] = byte


def b_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def groups_of(text):
    """A list of (A ids, B ids), or nothing where a tokenizer doesn't spell the text."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spell_a, spell_b = [bytes(LETTER[c] for c in A.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
    whole = (" " + text).encode()
    if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
        return []
    out, i, j, at_a, at_b, one, two = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if j == len(b) or i < len(a) and at_a <= at_b:
            one.append(a[i])
            at_a += len(spell_a[i])
            i += 1
        else:
            two.append(b[j])
            at_b += len(spell_b[j])
            j += 1
        if at_a == at_b and one and two:
            out.append((one, two))
            one, two = [], []
    return out


def truth(rows):
    found = [groups_of(r[1]) for r in rows]
    held = Counter(p for groups in found for p in {(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for r, groups in zip(rows, found, strict=True):
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((r[0], sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


ODD = ["x", " lead", "two  blanks   three", "▁ a piece mark", "<|endoftext|> and <0x41> <s>", "nul \x00 here", "中文字符 and 🙂🙃", "é ä", "a" * 3000, " " * 500, "9" * 700, "\n\n\t\r\n", "=" * 900 + "x", "ﬁ ½ Ⅳ", "  ​", "tail ", "don't we'll I'm"]


def cases():
    r = random.Random(4)
    rows = corpus()
    odd = [*ODD, *("".join(r.choice("ab \n\té中🙂<0x>▁'1") for _ in range(r.randint(1, 200))) for _ in range(60))]
    return rows + [(300 + i, t, *[None] * 7) for i, t in enumerate(odd)] + [(None, "no id", *[None] * 7), (None, None, *[None] * 7)]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_alignment(spark):
    rows = cases()
    for block in (alignment.BLOCK, 4096):
        assert order(alignment.aligned(frame(spark, rows), block=block).collect()) == order(truth(rows))


def test_alignment_of_nothing(spark):
    assert alignment.aligned(frame(spark, [])).count() == 0
    empty = alignment.aligned(frame(spark, [(1, None, *[None] * 7), (2, "", *[None] * 7)])).collect()
    assert order(empty) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_slices_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 300)
    own, rows = alignment.Block(7), cases()
    for i in range(0, len(rows), 9):
        own.add([r[0] for r in rows[i : i + 9]], [r[1] for r in rows[i : i + 9]], 1, alignment.tokenizers())
    (batch,) = own.rows()
    *docs, last = batch.to_pylist()
    keys = last["keys"]
    for row, d in zip(rows, docs, strict=True):
        links = Counter((x, y) for a, b in groups_of(row[1]) for x in a for y in b)
        place = alignment.unpacked(d["places"]).cumsum()
        assert {divmod(keys[p], alignment.SHIFT): t for p, t in zip(place, alignment.unpacked(d["times"]), strict=True)} == links


def test_large_groups_are_linked_as_small_ones(monkeypatch):
    pair, texts = alignment.tokenizers(), [t for t in ODD if t]
    usual = alignment.align(texts, pair)
    monkeypatch.setattr(alignment, "MANY", 0)
    for x, y in zip(usual, alignment.align(texts, pair), strict=True):
        assert list(x) == list(y)


def test_letters_are_those_of_the_decoder():
    assert alignment.byte_letters() == LETTER
    assert all(decoders.ByteLevel().decode([c]) == chr(b) for c, b in LETTER.items() if b < 128)
