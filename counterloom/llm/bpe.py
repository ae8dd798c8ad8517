"""Exact byte-pair encoding by backtracking over longest matches, and decoding by offsets.

The vocabulary is a tokenizer file with byte-level merges. All tokens go into an
Aho-Corasick automaton. A piece of text is encoded from left to right with the
longest token that matches; a token is accepted if it is compatible with the one
before it, that is if merging the two tokens' bytes from scratch would not have
joined bytes across their border. If not, the next shorter token that is a prefix
of it is tried, and if there is none, the last accepted token is taken back and
the position marked as dead, so that no position is tried twice: linear time, and
the merges of the original algorithm. Compatibility is worked out by undoing
merges and kept in a table. Pieces are cut as the vocabulary's own pattern cuts
them; frequent ones are kept with their ids, in a table of bounded size.

Decoding copies byte ranges out of one buffer by a table of offsets.

Defined cases: a null or empty text has no ids and decodes to an empty text.
Special tokens in a text become their ids, as in the original. Bytes that are not
UTF-8 after decoding become U+FFFD.
"""

import hashlib
import json
import re
import struct
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterloom.llm.ship import ship

KEPT_PIECES = 200_000
KEPT_PAIRS = 300_000

# Fixed values of the tokenizer format: how byte-level tokenizers cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Cuts that depend on nothing outside the run: a word with the blank before it,
# or white space. What PATTERN does inside a run does not depend on its neighbours.
_RUNS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The format's letter for every byte: itself if visible, else a letter from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in visible]
    letters = {chr(byte): byte for byte in visible}
    return letters | {chr(256 + i): byte for i, byte in enumerate(hidden)}


class Encoder:
    """Tables of one vocabulary; built once per worker process and file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()

        def plain(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, number in vocabulary.items():
            if token not in self.special:
                self.bytes[number] = plain(token)
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            pair = (vocabulary[left], vocabulary[right])
            whole = vocabulary[left + right]
            self.merge_rank[pair] = rank
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = pair, rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs: dict[str, tuple[str, bytes]] = {}
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self._cut = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, names)) or "(?!)")
        self._index()
        for token, number in self.special.items():
            self.bytes[number] = token.encode()
        self.buffer = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])

    def _index(self) -> None:
        """The automaton of all tokens that merging can produce, and their prefixes."""
        self.automaton = ahocorasick.Automaton()
        known = {}
        for number in sorted(range(len(self.bytes)), key=self.rank.__getitem__):
            token, parts = self.bytes[number], self.parts[number]
            if token and (parts is None or self._stable(*parts, self.rank[number])):
                known[token] = number
                self.automaton.add_word(token.decode("latin-1"), (number, len(token)))
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.bytes)
        for token, number in known.items():
            ends = (n for n in range(len(token) - 1, 0, -1) if token[:n] in known)
            self.shorter[number] = known[token[: next(ends)]] if len(token) > 1 else -1

    def _stable(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge across the border comes before ``limit`` or the tokens' own merges.

        Merges are undone from the latest on. Of equal merges the left one comes
        first, so one across the border also wins against an equal one to its right.
        """
        while True:
            if self.merge_rank.get((left, right), limit) < limit:
                return False
            if self.rank[left] > self.rank[right]:
                limit, left = self.rank[left], self.parts[left][1]
            elif self.parts[right] is not None:
                limit, right = self.rank[right] + 1, self.parts[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            found = self._stable(left, right, float("inf"))
            if len(self.pairs) < KEPT_PAIRS:
                self.pairs[left, right] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        # Matches come by their ends, so the last one seen at a start is the longest.
        longest = [-1] * (len(piece) + 1)
        for end, (number, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = number
        if len(self.bytes[longest[0]]) == len(piece):
            return [longest[0]]
        alive = bytearray(b"\1") * (len(piece) + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + len(self.bytes[token])
            if alive[end] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                alive[at] = 0
                token = tokens.pop()
                at -= len(self.bytes[token])
        return tokens

    def _run(self, run: str) -> tuple[str, bytes]:
        """Ids of a run as text and as 32-bit numbers."""
        known, fresh = self.pieces.get, self._piece
        found = [known(piece) or fresh(piece) for piece in self._cut.findall(run)]
        joined = ",".join([names for names, _ in found]), b"".join([ids for _, ids in found])
        if len(self.runs) < KEPT_PIECES:
            self.runs[run] = joined
        return joined

    def _piece(self, piece: str) -> tuple[str, bytes]:
        ids = self.encode_piece(piece.encode())
        found = (",".join(map(str, ids)), struct.pack(f"<{len(ids)}I", *ids))
        if len(self.pieces) < KEPT_PIECES:
            self.pieces[piece] = found
        return found

    def _runs(self, text: str) -> list[tuple[str, bytes]]:
        out, at = [], 0
        for match in [*self._special.finditer(text), None]:
            stop = match.start() if match else len(text)
            known, fresh = self.runs.get, self._run
            out += [known(run) or fresh(run) for run in _RUNS.findall(text[at:stop])]
            if match:
                number = self.special[match[0]]
                out.append((str(number), struct.pack("<I", number)))
                at = match.end()
        return out

    def encode(self, text: str | None) -> tuple[str, np.ndarray]:
        """The ids of a whole text, joined by commas and as numbers."""
        runs = self._runs(text or "")
        joined = ",".join([names for names, _ in runs])
        return joined, np.frombuffer(b"".join([packed for _, packed in runs]), dtype="<u4")

    def decode(self, ids: np.ndarray, slice_ids: int = 1 << 18) -> str:
        """The text of ids: byte ranges gathered from the buffer, slice by slice."""
        parts = []
        for first in range(0, len(ids), slice_ids):
            some = ids[first : first + slice_ids]
            starts = self.offsets[some]
            sizes = self.offsets[some.astype(np.int64) + 1] - starts
            before = np.cumsum(sizes) - sizes
            places = np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
            parts.append(self.buffer[places].tobytes())
        return b"".join(parts).decode("utf-8", errors="replace")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(text: Column, path: str) -> Column:
    """Ids of whole texts as an array; ``path``: a vocabulary file on every executor."""

    def encoded(texts: pa.Array) -> pa.Array:
        ids = [encoder(path).encode(value.as_py())[1].astype(np.int32) for value in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate([*ids, np.empty(0, np.int32)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return F.arrow_udf(encoded, T.ArrayType(T.IntegerType()))(text)


def decode(ids: Column, path: str) -> Column:
    """Texts of id arrays; null ids give an empty text."""

    def decoded(lists: pa.Array) -> pa.Array:
        texts = []
        for value in lists:
            numbers = value.values.to_numpy() if value.is_valid else np.empty(0, np.int32)
            texts.append(encoder(path).decode(numbers))
        return pa.array(texts, pa.string())

    return F.arrow_udf(decoded, T.StringType())(ids)


_ROUND_TRIP = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes every whole text."""
    ship(docs.sparkSession)

    def trip(texts: pa.Array) -> pa.Array:
        coder, rows = encoder(path), []
        for value in texts:
            joined, ids = coder.encode(value.as_py())
            decoded = coder.decode(ids).encode()
            digests = [hashlib.sha256(x).hexdigest() for x in (joined.encode(), decoded)]
            rows.append((len(ids), *digests))
        columns = [list(c) for c in zip(*rows)] or [[], [], []]
        arrays = [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])]
        return pa.StructArray.from_arrays(arrays, _ROUND_TRIP.names)

    tripped = F.arrow_udf(trip, _ROUND_TRIP).asNondeterministic()(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), tripped.alias("t")).select("doc_id", "t.*")
