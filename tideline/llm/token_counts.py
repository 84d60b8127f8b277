"""Token counts of sections by offset-mapped attribution.

Each document is encoded once as a whole. The byte lengths of its tokens add up to their spans, and the spans are
interval-joined to the sections (by default the lines, each with its line break) by binary search over the section
ends. A token that crosses a boundary is counted by an explicit rule:

* "majority" (default): in the section that holds most of its bytes, the earlier one if equal;
* "first": in the section of its first byte.

`token_share` divides it by bytes instead, so that shares of a document add up to its tokens. Sections are given as
character offsets, end exclusive.

Defined cases: null or empty text has one empty section without tokens; repeated rows give their sections each; an empty
table gives an empty result; only key and text are read. Invalid UTF-8 can't occur in a string column; characters that a
token splits (multi-byte ones) count by bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tideline.llm.common import identified_bytes, slices

SLICE_BYTES = 4 << 20
RULES = ("majority", "first")
MAX_VOCABULARY = 1 << 20
_built: dict[int, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(data: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a rank file and the byte length of each token; built once a process."""
    name = hash((data, pattern))
    if name not in _built:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"the vocabulary has {len(ranks)} entries; at most {MAX_VOCABULARY} are sent to the tasks")
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            sizes[k] = len(token)
        _built[name] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _built[name]


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Byte ends of the lines of a text."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attributed(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, by bytes, and how many of its tokens cross a boundary."""
    n = len(section_ends)
    begins = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, begins, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    inside = first == last
    counts = np.bincount(first[inside], minlength=n)
    share = counts.astype(np.float64)
    crossing = np.zeros(n, np.int64)
    many = np.flatnonzero(~inside)
    if len(many):
        width = last[many] - first[many] + 1
        row = np.repeat(np.arange(len(many)), width)
        section = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[many], width)
        low = np.maximum(np.concatenate([[0], section_ends])[section], begins[many][row])
        overlap = np.minimum(section_ends[section], token_ends[many][row]) - low
        np.add.at(share, section, overlap / (token_ends - begins)[many][row])
        np.add.at(crossing, section, 1)
        if rule == "first":
            chosen = first[many]
        else:
            order = np.lexsort((section, -overlap, row))
            chosen = section[order[np.cumsum(width) - width]]
        counts = counts + np.bincount(chosen, minlength=n)
    return counts, share, crossing


def section_counts(docs: DataFrame, path: str, pattern: str, rule: str = "majority", ends: Callable[[np.ndarray], np.ndarray] = line_ends, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section (from 0), char_start, char_end, n_tokens, token_share, n_crossing: a row for each section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoding(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, batch.column(1), SLICE_BYTES):
                blocks = []
                for data in part.column(1).to_pylist():
                    raw = np.frombuffer(data, np.uint8)
                    cuts = ends(raw)
                    token_ends = np.cumsum(sizes[np.array(encode.encode_ordinary(data.decode()), np.int64)])
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[np.concatenate([[0], cuts])]
                    blocks.append((np.arange(len(cuts)), chars[:-1], chars[1:], *attributed(token_ends, cuts, rule)))
                each = np.array([len(b[0]) for b in blocks])
                columns = [np.concatenate([b[k] for b in blocks]) for k in range(6)]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(blocks)), each)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[key, "section", "char_start", "char_end", "n_tokens", "token_share", "n_crossing"])

    return identified_bytes(docs, key, text).mapInArrow(run, f"{key} long, section long, char_start long, char_end long, n_tokens long, token_share double, n_crossing long")
