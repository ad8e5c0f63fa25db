"""Byte-level BPE with the tokenizers library over Arrow batches, and its inverse.

A rank file is turned into a model of the library: bytes become characters by the usual table, and
every way to put a token together from two others becomes a merge, in the order of the ranks.

Texts are cut before blanks that follow something else than white space. The pattern never matches
across such a place, and what follows it never decides a match before it, so the pieces encode
alone as they do in the text. A worker asks the library for each distinct piece once and keeps the
answer in a table; when that is full, it is put aside, and what is still wanted of it comes back. A new piece
of plain letters, digits and signs is cut at the matches of the pattern, and the library's model gives
the ids of each match that is new. Other new pieces go to the library many at a time as one
text: each begins with the only token of it that begins with a blank, which is where the answer is cut
apart again. Texts with white space before a blank go to the library whole.

Memory is a slice of texts and the table, whatever a task holds; nothing is shuffled, so no key can be
hot. A text that is one long piece is encoded by itself and is not kept.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import arrow_type, map_texts

# White space before a blank, by Python's definition, which holds all of the library's.
_JOINED = re.compile(r"\s ")
_ASCII_JOINED = tuple(f"{c} " for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f ")


def _joined(text: str) -> bool:
    return any([j in text for j in _ASCII_JOINED]) if text.isascii() else _JOINED.search(text) is not None

#: Pieces and characters that a worker's two tables may hold: when the newer has half of them, it replaces the older.
KEPT_PIECES = 800_000
KEPT_CHARS = 12_000_000

#: New pieces that are sent to the library as one text, and the longest piece that is kept.
JOINED_PIECES = 500
LONG_PIECE = 1_000

# Marks that a letter is never joined with; alike in all patterns of this kind.
_MARKS = frozenset(".,;:!?")

# The pattern on characters that are letters, digits or signs in every version of Unicode that a library may have.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԣא-תء-غف-يぁ-ゔァ-ヺ一-龥가-힣"
_MATCHES = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+|(?<=\\S)\n(?=\\S)"
).findall

# A tokenizer that cuts this text as _MATCHES does has the pattern.
_PROBE = " aBÉ'sx'lle'x 'd91234a.b.'s $漢\nC (d"


def byte_alphabet() -> list[str]:
    """A printable character for every byte: itself where it has one, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(others)) for b in range(256)]


_SHOWN = dict(enumerate(byte_alphabet()))


def _shown(match: str) -> str:
    """A match of the pattern in the characters of the byte table."""
    if match.isascii():
        return match.replace(" ", _SHOWN[0x20]).replace("\n", _SHOWN[0x0A])
    return match.encode().decode("latin-1").translate(_SHOWN)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_tokenizer(path: str, pattern: str):
    """A tokenizer of the library that merges by the ranks of a file."""
    from tokenizers import Regex, Tokenizer, decoders, pre_tokenizers
    from tokenizers.models import BPE

    ranks, chars = read_ranks(path), byte_alphabet()
    shown = {token: "".join([chars[b] for b in token]) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        halves = [(token[:i], token[i:]) for i in range(1, len(token))]
        halves = [(a, b) for a, b in halves if a in ranks and b in ranks]
        halves.sort(key=lambda h: (ranks[h[0]], ranks[h[1]]))
        merges += [(shown[a], shown[b]) for a, b in halves]
    model = BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(False, use_regex=False)]
    )
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


@lru_cache(maxsize=4)
def load_tokenizer(path: str, pattern: str | None = None):
    """The tokenizer of a library file (.json), or of a rank file and its pattern."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core already
    tokenizer = rank_tokenizer(path, pattern) if pattern else Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@lru_cache(maxsize=4)
def token_bytes(path: str, pattern: str | None = None) -> list[bytes]:
    """The bytes of every id: the characters of its token through the byte table backwards."""
    tokenizer = load_tokenizer(path, pattern)
    back = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        known = all(c in back for c in token)
        table[i] = bytes([back[c] for c in token]) if known else token.encode()
    return table


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``table`` is ``token_bytes`` of the tokenizer.
    """

    def __init__(self, tokenizer, table: list[bytes]):
        self.tokenizer = tokenizer
        self.begins = np.array([t.startswith(b" ") for t in table], bool)
        self.marks = dict(zip(sorted(_MARKS), self._ask(sorted(_MARKS))))
        cut = tokenizer.pre_tokenizer.pre_tokenize_str(_PROBE) if tokenizer.pre_tokenizer else []
        self.plain = tokenizer.normalizer is None and [m for m, _ in cut] == [_shown(m) for m in _MATCHES(_PROBE)]
        self.model = tokenizer.model
        # Pieces that follow a blank, and matches that do not with a blank behind them.
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _model_ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _match(self, key: str, match: str) -> bytes:
        ids = self.older.get(key) or self._model_ids(_shown(match))
        self.table[key] = ids
        self.chars += len(key)
        return ids

    def _cut(self, text: str) -> bytes | None:
        """Ids of a text by its matches; None where they are not sure, or the text is long."""
        if not self.plain or len(text) > LONG_PIECE:
            return None
        matches = _MATCHES(text)
        if "".join(matches) != text:
            return None
        keys = [m[1:] if m[0] == " " else m + " " for m in matches]
        get = self.table.get
        return b"".join([get(key) or self._match(key, m) for key, m in zip(keys, matches)])

    def _learn(self, pieces: set[str]) -> None:
        """Put pieces that follow a blank into the table."""
        table, older, blank = self.table, self.older, _SHOWN[0x20]
        others = set()
        for piece in pieces:
            ids = older.get(piece)
            if ids is None:
                if self.plain and piece.isascii() and piece.isalpha() and len(piece) <= LONG_PIECE:
                    ids = self._model_ids(blank + piece)
                else:
                    ids = self._cut(" " + piece)
            if ids:
                table[piece] = ids
                self.chars += len(piece)
            else:
                others.add(piece)
        if others:
            self._learn_joined(others)

    def _learn_joined(self, pieces: set[str]) -> None:
        table = self.table
        ends = {p for p in pieces if p and p[-1] in _MARKS and p[:-1].isalpha()}
        stems = {p[:-1] for p in ends}.difference(table)
        asked = [*(pieces - ends), *(stems - pieces)]
        # A blank after white space would be read together with it.
        left = [p for p in asked if not p or p[-1].isspace() or len(p) > LONG_PIECE]
        joined = [*set(asked).difference(left)] if left else asked
        groups = [joined[i : i + JOINED_PIECES] for i in range(0, len(joined), JOINED_PIECES)]
        for group, ids in zip(groups, self._ask([" " + " ".join(g) for g in groups])):
            starts = np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])
            if len(starts) == len(group):
                at = [*(4 * starts).tolist(), len(ids)]
                table.update(zip(group, [ids[a:b] for a, b in zip(at, at[1:])]))
            else:
                left += group
        table.update(zip(left, self._ask([" " + p for p in left])))
        table.update([(p, table[p[:-1]] + self.marks[p[-1]]) for p in ends])
        self.chars += sum(map(len, asked)) + sum(map(len, ends))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _joined(text):
            return self._ask([text])[0]
        if len(self.table) > KEPT_PIECES // 2 or self.chars > KEPT_CHARS // 2:
            self.older, self.table, self.chars = self.table, {}, 0
        # The first piece has no blank before it and is no key of the table.
        first, *rest = text.split(" ")
        head = (self._cut(first) or self._ask([first])[0]) if first else b""
        table = self.table
        found = list(map(table.get, rest))
        new = {p for p, ids in zip(rest, found) if ids is None}
        if new:
            self._learn(new)
            found = [table[p] if ids is None else ids for p, ids in zip(rest, found)]
        return head + b"".join(found)


@lru_cache(maxsize=2)
def load_encoder(path: str, pattern: str | None = None) -> Encoder:
    """One encoder for all tasks of a worker, so that a task knows the pieces of those before it."""
    return Encoder(load_tokenizer(path, pattern), token_bytes(path, pattern))


def encode_texts(
    docs: DataFrame, path: str, pattern: str | None = None, key: str = "doc_id", text: str = "text",
    offsets: bool = False, decoded: bool = False,
) -> DataFrame:
    """key and ids (array<int>) of every row, whole texts; a null or empty text has no ids.

    With ``decoded`` also the bytes of the ids, as :func:`decode_ids` gives them, in the same pass.
    With ``offsets`` also ``ends`` (array<int>): how many characters of the text have begun when a
    token ends; the tokens of a character that is split have the same value. One row per input row, in any order:
    repeated rows are encoded as often as they occur, a null key stays null, an empty table gives
    an empty result; other columns are not read.
    """
    if array("I").itemsize != 4:
        raise RuntimeError("unsigned ints of four bytes are needed")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        table = token_bytes(path, pattern)
        encode = Encoder(load_tokenizer(path, pattern), table)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [encode(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
            ids = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
            columns = [batch.column("key"), pa.ListArray.from_arrays(ends, ids)]
            names = ["key", "ids"]
            if decoded:
                columns.append(pa.array([bytes_of(np.frombuffer(f, "<u4").tolist(), table) for f in found], pa.binary()))
                names.append("decoded")
            if offsets:
                places = [_character_ends(t, f, table) for t, f in zip(texts, found)]
                columns.append(pa.array(places, pa.list_(pa.int32())))
                names.append("ends")
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    schema = f"key {arrow_type(docs, key)}, ids array<int>" + ", decoded binary" * decoded + ", ends array<int>" * offsets
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_texts(slim, make, schema).withColumnRenamed("key", key)


def bytes_of(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def _character_ends(text: str, ids: bytes, table: list[bytes]) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    begun = np.cumsum((data & 0xC0) != 0x80)  # characters that have begun up to a byte
    at = np.cumsum([len(table[i]) for i in np.frombuffer(ids, "<u4")], dtype=np.int64)
    return begun[at - 1].astype(np.int32) if len(at) else np.zeros(0, np.int32)


def decode_ids(rows: DataFrame, path: str, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids, a character split over tokens being whole again.

    Null ids give null; an id outside the vocabulary fails the job, for it was not written by
    this tokenizer. A column ``decoded`` of the input is replaced.
    """
    schema = rows.drop("decoded").schema.add("decoded", "binary")

    def run(batches):
        table = token_bytes(path, pattern)
        for batch in batches:
            back = []
            for row in batch.column(ids):
                found = row.values
                back.append(None if found is None else bytes_of(found.to_pylist(), table))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(back, pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    return rows.drop("decoded").mapInArrow(run, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = encode_texts(docs, path, pattern, decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
