"""BPE encoding and decoding with a word-end vocabulary file of the `tokenizers` library.

Each word is a contiguous row of part ids with the merge rank of every adjacent pair beside it. The row is scanned for
its least rank (leftmost if equal), the boundary between the two parts is deleted, and the ranks to the left and right
of the new part are refreshed, until no pair has a rank. Words of one length form a matrix, and each loses one boundary
in a scan, so all of them are scanned together. Words longer than LONG use a heap of ranks instead, as repeated scans
would grow with the square of the length; both give the same parts.

Text is prepared as the vocabulary file says: special tokens are cut out of the raw text, the rest is normalised (NFC),
lower-cased and split by the pattern; white space is dropped. Decoding joins the token texts with one space.

Defined cases: null or empty text has no tokens and decodes to an empty text; ids of null decode to an empty text;
repeated rows are each encoded; other columns pass unchanged, a column named like a result is replaced. Letters that
Unicode has assigned since version 16 may be split otherwise than by a library with older tables.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from tideline.llm.common import appended, int_lists

SLICE_BYTES = 1 << 20
LONG = 1024
#: Distinct chunks that a task keeps encoded; the store starts anew beyond.
KNOWN_CHUNKS = 400_000
#: Largest vocabulary that is sent to the tasks.
MAX_VOCABULARY = 1 << 20
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """The tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        if self.size > MAX_VOCABULARY:
            raise ValueError(f"the vocabulary has {self.size} entries; at most {MAX_VOCABULARY} are sent to the tasks")
        self.texts = [""] * self.size
        for text, k in [*ids.items(), *self.special.items()]:
            self.texts[k] = text
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.final = np.array([ids[x + suffix] for x in letters], np.int64)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in model["merges"]], np.int64)
        self.merged = np.array([ids[a + b] for a, b in model["merges"]], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)


def scan_words(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Token ids (bytes of 32-bit integers) of words of one length."""
    parts = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
    ids = np.concatenate([vocabulary.inner[parts[:, :-1]], vocabulary.final[parts[:, -1:]]], axis=1)
    ranks = vocabulary.ranks(ids[:, :-1], ids[:, 1:])
    out: list = [b""] * len(words)
    place = np.arange(len(words))

    def put(at: np.ndarray, rows: np.ndarray) -> None:
        block, width = rows.astype(np.int32).tobytes(), 4 * rows.shape[1]
        for k, row in enumerate(at.tolist()):
            out[row] = block[k * width : (k + 1) * width]

    while ranks.shape[1]:
        least = ranks.argmin(1)
        best = ranks[np.arange(len(ids)), least]
        ended = best == _NONE
        if ended.any():
            put(place[ended], ids[ended])
            ids, ranks, place, least, best = ids[~ended], ranks[~ended], place[~ended], least[~ended], best[~ended]
            if not len(ids):
                return out
        rows, at = np.arange(len(ids)), least[:, None]
        ids[rows, least] = vocabulary.merged[best]
        column = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, column + (column > at), 1)
        column = column[:-1]
        ranks = np.take_along_axis(ranks, column + (column >= at), 1)
        left = np.flatnonzero(least > 0)
        ranks[left, least[left] - 1] = vocabulary.ranks(ids[left, least[left] - 1], ids[left, least[left]])
        right = np.flatnonzero(least < ids.shape[1] - 1)
        ranks[right, least[right]] = vocabulary.ranks(ids[right, least[right]], ids[right, least[right] + 1])
    put(place, ids)
    return out


def heap_word(vocabulary: Vocabulary, word: bytes) -> bytes:
    """Token ids (bytes of 32-bit integers) of one long word."""
    raw = np.frombuffer(word, np.uint8)
    ids = np.append(vocabulary.inner[raw[:-1]], vocabulary.final[raw[-1:]])
    ranks = vocabulary.ranks(ids[:-1], ids[1:])
    heap = [(int(r), k) for k, r in enumerate(ranks.tolist()) if r != _NONE]
    heapq.heapify(heap)
    ids, current = ids.tolist(), ranks.tolist()
    current.append(int(_NONE))
    before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
    table = dict(zip(vocabulary.keys.tolist(), vocabulary.rank.tolist()))
    while heap:
        rank, k = heapq.heappop(heap)
        if ids[k] is None or current[k] != rank:
            continue
        gone = after[k]
        ids[k], ids[gone] = int(vocabulary.merged[rank]), None
        after[k] = after[gone]
        if after[k] < len(ids):
            before[after[k]] = k
        for a, b in ((before[k], k), (k, after[k])):
            if a >= 0:
                current[a] = table.get(ids[a] * vocabulary.size + ids[b], int(_NONE)) if b < len(ids) else int(_NONE)
                if current[a] != _NONE:
                    heapq.heappush(heap, (current[a], a))
    return np.array([x for x in ids if x is not None], np.int32).tobytes()


def encoder(vocabulary: Vocabulary) -> Callable[[list[bytes]], list[np.ndarray]]:
    """A function from UTF-8 texts to their token ids; it keeps the chunks between white space that it has met.

    No piece of the pattern holds white space, so a chunk can be normalised, split and merged on its own.
    """
    pieces = regex.compile(vocabulary.pattern).findall
    cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else None
    special = {x: np.int32(k).tobytes() for x, k in vocabulary.special.items()}
    controls = regex.compile("[\x1c-\x1f]").search  # white space for str.split, not for the pattern
    chunks = regex.compile(r"[^\s]+").findall
    known: dict[str, bytes] = {}

    def words_of(text: str) -> list[str]:
        if text.isascii():
            return pieces(text.lower())
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()  # no final sigma: letters are lower-cased one by one
        return pieces(text)

    def learn(new: list[str]) -> None:
        split = [(x, [w.encode() for w in words_of(x)]) for x in new]
        by_length: dict[int, list[bytes]] = {}
        for word in {w for _, words in split for w in words}:
            by_length.setdefault(len(word), []).append(word)
        ids: dict[bytes, bytes] = {}
        for length, group in by_length.items():
            ids.update(zip(group, scan_words(vocabulary, group) if length <= LONG else [heap_word(vocabulary, x) for x in group]))
        known.update((x, b"".join(map(ids.__getitem__, words))) for x, words in split)

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        if len(known) > KNOWN_CHUNKS:
            known.clear()
        docs = []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            parts = cut(text) if cut and "<" in text else [text]
            docs.append([x if k % 2 else chunks(x) if controls(x) else x.split() for k, x in enumerate(parts)])
        learn(list({w for doc in docs for words in doc[::2] for w in words if w not in known}))
        return [np.frombuffer(b"".join(special[x] if k % 2 else b"".join(map(known.__getitem__, x)) for k, x in enumerate(doc)), np.int32) for doc in docs]

    return encode


def decoded(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    return " ".join(map(vocabulary.texts.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, text: str = "text", decode: bool = False) -> DataFrame:
    """`docs` with token_ids and, if asked for, decoded_text. The file is read on the driver; its tables have a checked size."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def prepare() -> Callable[[list], list]:
        vocabulary = shared.value
        run = encoder(vocabulary)

        def work(texts: list) -> list:
            ids = run(texts)
            out = [int_lists(np.concatenate(ids), np.array([len(x) for x in ids]), pa.int32())]
            return out + [pa.array([decoded(vocabulary, x) for x in ids], pa.string())] if decode else out

        return work

    return appended(docs, prepare, "token_ids array<int>" + ", decoded_text string" * decode, SLICE_BYTES, text)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """`tokens` with decoded_text from a column of token ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path))
    base = tokens.drop("decoded_text")
    schema = T.StructType([*base.schema.fields, T.StructField("decoded_text", T.StringType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [decoded(shared.value, np.array(x.as_py() or [], np.int64)) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded_text"])

    return base.mapInArrow(run, schema)
