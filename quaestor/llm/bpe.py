"""Byte-pair encoding by backtracking, decoding by an offset table.

A piece of text is scanned once by an Aho-Corasick automaton of all tokens, which gives the longest token at every
byte. The encoder takes the longest token, checks that it may follow the previous one (a pair is compatible if the
merges of its joined bytes end in that very pair), else tries the next shorter prefix, else takes one step back;
a byte from which no way led on is never entered again, so the work is linear. Pieces repeat, so each worker keeps
a bounded memo of pieces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quaestor.llm.common import gathered, slices, text_bounds

#: Entries of a worker's memo of pieces and of its table of token pairs; a full one is begun anew.
MEMO_ENTRIES = 400_000
#: A longer piece is encoded each time.
MEMO_CHARS = 48
#: The pieces within which bytes are merged (fixed value of byte-level vocabularies).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Tokens of a byte-level vocabulary file: exact encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()
        vocabulary = described["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[x] for x in token)
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, i in vocabulary.items():
            self.tokens[i] = token.encode() if token in self.special else as_bytes(token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.merged, self.parts = {}, {}
        for rank, pair in enumerate(described["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            joined = vocabulary[left + right]
            self.merged[vocabulary[left], vocabulary[right]] = (rank, joined)
            self.parts[joined] = (rank, vocabulary[left], vocabulary[right])
        plain = {token: i for i, token in enumerate(self.tokens) if token and i not in self.special.values() and (len(token) == 1 or i in self.parts)}
        self.shorter = {i: next((plain[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in plain), -1) for token, i in plain.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in plain.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = [len(token) for token in self.tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PIECES)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo = _Memo(self)
        self.offsets, self.blob = _offset_table(self.tokens)
        self.number_offsets, self.numbers = _offset_table([b"%d," % i for i in range(size)])

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the joined bytes of two tokens end in these two tokens.

        They don't if some merge across the boundary comes before both of its sides are taken up by merges of their
        own token: before the left side is, and not after the right side is (of equal merges the leftmost comes first).
        """
        known = self.pairs.get((left, right))
        if known is None:
            known = True
            for a, a_taken in self._edge(left, 2):
                for b, b_taken in self._edge(right, 1):
                    rank = self.merged.get((a, b), (b_taken + 1,))[0]
                    if rank < a_taken and rank <= b_taken:
                        known = False
            if len(self.pairs) >= MEMO_ENTRIES:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _edge(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """The tokens that stand at one edge while a token is put together, and the rank of the merge that takes each up."""
        taken = len(self.merged)
        while True:
            yield token, taken
            if token not in self.parts:
                return
            taken, token = self.parts[token][0], self.parts[token][side]

    def encode_piece(self, piece: bytes) -> list[int]:
        longest = [-1] * len(piece)
        lengths = self.lengths
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token
        closed = bytearray(len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            if token < 0:  # no token leads on from here: one step back
                closed[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = self.shorter[token]
                continue
            end = at + lengths[token]
            if not closed[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            else:
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> np.ndarray:
        found, last = [], 0
        for mark in self.marks.finditer(text) if self.marks else ():
            found += [*map(self.memo.__getitem__, self.pieces.findall(text[last : mark.start()])), _packed([self.special[mark[0]]])]
            last = mark.end()
        found += map(self.memo.__getitem__, self.pieces.findall(text[last:] if last else text))
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return gathered(self.blob, self.offsets, ids)[0].tobytes().decode("utf-8", "replace")


class _Memo(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        out = _packed(self.codec.encode_piece(piece.encode()))
        if len(piece) <= MEMO_CHARS:
            self[piece] = out
        return out


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _offset_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(x) for x in entries])]).astype(np.int64), np.frombuffer(b"".join(entries), np.uint8)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path)


def _coded(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(text_bounds(texts)):
            ids = [own.encode(x or "") for x in texts[low:high].to_pylist()]
            flat, counts = np.concatenate(ids), np.array([len(x) for x in ids])
            ends = np.cumsum(counts)
            digits, digit_ends = gathered(own.numbers, own.number_offsets, flat)
            decoded, decoded_ends = gathered(own.blob, own.offsets, flat)
            columns = {"doc_id": batch.column("doc_id")[low:high], "n_tokens": counts, "ids_sha256": [], "decoded_sha256": []}
            written, read = 0, 0
            for end in ends:
                to = int(digit_ends[end - 1]) if end else 0
                columns["ids_sha256"].append(hashlib.sha256(digits[written : max(written, to - 1)]).hexdigest())
                written = to
                to = int(decoded_ends[end - 1]) if end else 0
                columns["decoded_sha256"].append(hashlib.sha256(decoded[read:to].tobytes().decode("utf-8", "replace").encode()).hexdigest())
                read = to
            if with_ids:
                columns["input_ids"] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)


def encoded(documents: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Tokens of every whole text: number, digest of the ids, digest of the text decoded from them; ``with_ids`` adds the ids.

    ``vocabulary`` is the path of a byte-level vocabulary file, readable on every executor. A null or empty text has
    no tokens; a null doc_id stays null; repeated rows give repeated results. Only doc_id and text are read.
    """
    schema = ENCODED + (", input_ids array<int>" if with_ids else "")
    return documents.select("doc_id", "text").mapInArrow(lambda batches: _coded(batches, vocabulary, with_ids), schema)
