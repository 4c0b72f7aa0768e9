"""Byte-level BPE encoding and decoding.

Each pre-token's bytes are mapped to Latin-1 characters, so that one pass of an Aho-Corasick automaton over the vocabulary
lists every token that starts at every byte. The encoding is then found by taking the longest token at each place and stepping
back where two neighbours could not stand side by side: two tokens are compatible when merging their joined bytes by rank
gives exactly these two again. A sequence whose neighbours are all compatible is the encoding, each prefix has just one, and so
a place that was left once is never entered again: the search is linear. Compatibility and whole pre-tokens are memoised.

Null texts are encoded like empty ones: no ids. Texts are never cut, very long ones and long pre-tokens included. Ties don't arise: each
text has one encoding. An empty table gives an empty result. Repeated rows give repeated results; further columns of the
input are ignored by `encode_documents`.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
from array import array

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.common import documents, map_batches, remembers

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks and token pairs kept in memory by one worker; beyond that the memory is emptied and filled again.
LOOSE_BLANK = re.compile(r" (?:\s|\Z)")
PIECES, PAIRS = 500_000, 1_000_000


class Chunks(dict):
    """The ids of chunks of text as native 32-bit integers, found where they are asked for first. before: what stands in front."""

    def __init__(self, coder: BytePairCoder, before: str = ""):
        super().__init__()
        self.coder, self.before = coder, before

    def __missing__(self, chunk: str) -> bytes:
        pieces = self.coder.split(self.before + chunk)
        ids = array("I", [i for piece in pieces for i in self.coder.piece_ids(piece.encode("utf-8"))]).tobytes()
        if len(self) >= PIECES:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class BytePairCoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.plain, self.spaced = Chunks(self), Chunks(self, " ")
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Merges by rank, lowest first and leftmost among equals: the definition, for short inputs."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [rank(data[i : i + 2], sys.maxsize) for i in range(len(data) - 1)]
        while joined:
            best = min(joined)
            if best == sys.maxsize:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], sys.maxsize)
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], sys.maxsize)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def piece_ids(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if not data:
            return []
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, found in self.automaton.iter(data.decode("latin-1")):  # ends ascend, and so do the lengths at a start
            starts[end - found[0] + 1].append(found)
        left_once, path, at, choice = bytearray(size + 1), [], 0, len(starts[0]) - 1
        while at < size:
            while choice >= 0:
                length, rank = starts[at][choice]
                if not left_once[at + length] and (not path or self.compatible(path[-1][1], rank)):
                    break
                choice -= 1
            if choice >= 0:
                path.append((at, rank, choice))
                at += length
                choice = len(starts[at]) - 1 if at < size else -1
            elif path:
                left_once[at] = 1
                at, _, choice = path.pop()
                choice -= 1
            else:
                raise ValueError(f"no token sequence spells {data[:40]!r}: the vocabulary lacks single bytes")
        return [rank for _, rank, _ in path]

    def encode(self, text: str) -> array:
        """A blank in front of something else than white space starts a pre-token wherever it stands, so a text in which each blank is of
        that kind is encoded blank by blank; any other text is split as a whole."""
        if LOOSE_BLANK.search(text):
            found = [self.plain[piece] for piece in self.split(text)]
        else:
            first, *rest = text.split(" ")
            found = [self.plain[first], *map(self.spaced.__getitem__, rest)]
        return array("I", b"".join(found))

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(2)
def coder(vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> BytePairCoder:
    """The coder of a vocabulary file; one per worker process."""
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return BytePairCoder({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


remembers(__name__, coder.cache_clear)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>) and the decoded text, decoded from the ids."""

    def make():
        own = coder(vocabulary)

        def run(batch):
            ids = [own.encode(t or "") for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "ids": [x.tolist() for x in ids], "decoded": [own.decode(x).decode("utf-8") for x in ids]}

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: `encode_documents` with its results reduced to digests where they arise."""

    def make():
        own = coder(vocabulary)
        swap = sys.byteorder != "little"

        def run(batch):
            out = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch["text"]:
                ids = own.encode(text or "")
                out["n_tokens"].append(len(ids))
                out["decoded_sha256"].append(hashlib.sha256(own.decode(ids)).hexdigest())
                if swap:
                    ids.byteswap()
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            return out

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir))
