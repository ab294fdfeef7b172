"""Tokenising and sum-of-squares packing of documents into sequences.

Tokens come from a byte-level BPE vocabulary in the ``tokenizers`` format.  Its merges
are in id order (checked when the tables are built), which makes merging by rank the
same as merging by the file's merge list, so the repeated units of a text are encoded
once in a worker and kept in a bounded cache.  Texts with runs of white space are encoded
whole, and texts with a special token's string by the library itself.

Packing: an open sequence has a residual gap; N(g) counts open sequences with gap g.
Each piece goes where the sum of N(g) squared becomes smallest, into an open sequence or
a new one; equal sums go to the tightest gap.  Pieces come longest first.  What that leaves
open is then packed again by the same rule and order, together with some full sequences drawn
at random, for a few rounds; a round counts if it needs fewer sequences.  Pieces are dealt to
groups of about ``group_pieces`` by hash, each packed by itself, so a group never grows with
the input; what all groups leave open is packed once more.

Defined results: a null or empty text is one piece that holds only the end id; a
document above ``capacity`` is cut into pieces of that length, the first may be shorter;
equal rows are all packed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import bounded, ship, stored

_RUN = re.compile(r"\s\s")
#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others take the code points from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokens(dict):
    """Maps a unit (a word with the space before it, or a newline) to its ids as
    little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, most_units: int = 400_000, longest_kept: int = 64):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.most_units, self.longest_kept = most_units, longest_kept
        spec = json.loads(vocabulary)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE":
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError("merges aren't in id order")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.engine = tiktoken.Encoding("unit", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, unit: str) -> bytes:
        ids = np.asarray(self.engine.encode_ordinary(unit), dtype="<u4").tobytes()
        if len(unit) <= self.longest_kept:
            if len(self) >= self.most_units:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _RUN.search(text) or text[0].isspace() or text[-1].isspace():
            return np.asarray(self.engine.encode_ordinary(text), dtype="<u4").tobytes()
        # Every white space stands alone between two words: it belongs to the word after
        # it if it is a space and is a unit of its own if it is a newline.
        first, *rest = text.replace("\n", " \n").split(" ")
        look = self.__getitem__
        head = look(first)
        return head + b"".join([look("\n") + look(u[1:]) if u[0] == "\n" else look(" " + u) for u in rest])


_TOKENS: dict[str, Tokens] = {}


def tokens_for(vocabulary: str) -> Tokens:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(vocabulary)
    return _TOKENS[key]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, but for a shorter first."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def pieces(documents: DataFrame, vocabulary_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces of every whole document with a checksum of their ids: ``PIECES``."""
    spark = documents.sparkSession
    ship(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_for(vocabulary.value)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in bounded(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokens.encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int, order: np.ndarray) -> tuple[np.ndarray, int]:
    """(sequence number of each length, number of sequences), lengths taken in ``order``."""
    bins = np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # N(g); the last stands for a new sequence
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in order.tolist():
        size = int(lengths[i])
        if size >= capacity:
            bins[i], made = made, made + 1
            continue
        # Change of the sum when a gap g becomes g - size; gap 0 is closed and uncounted.
        leaves = 1 - 2 * count[size:]
        leaves[-1] = 0  # a new sequence leaves no gap behind
        enters = 2 * count[: capacity + 1 - size] + 1
        enters[0] = 0
        change = np.where(count[size:] > 0, leaves, np.iinfo(np.int64).max // 4)
        change[-1] = 0
        gap = size + int(np.argmin(change + enters))
        if gap == capacity:
            number, made = made, made + 1
        else:
            number = open_at[gap].pop()
            count[gap] -= 1
        bins[i] = number
        left = gap - size
        if left:
            open_at[left].append(number)
            count[left] += 1
    return bins, made


def improved(lengths: np.ndarray, capacity: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Sequence numbers of lengths, longest first, after rounds of packing open ones again."""
    bins, made = sum_of_squares(lengths, capacity, np.argsort(-lengths, kind="stable"))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        fill = np.bincount(bins, weights=lengths, minlength=made)
        opened, full = np.flatnonzero(fill < capacity), np.flatnonzero(fill == capacity)
        if made * capacity - fill.sum() < capacity:
            break  # one sequence less couldn't hold everything
        again = np.zeros(made, bool)
        again[opened] = again[rng.choice(full, min(3 * len(opened), len(full)), replace=False)] = True
        some = np.flatnonzero(again[bins])
        new, needed = sum_of_squares(lengths[some], capacity, np.argsort(-lengths[some], kind="stable"))
        if needed < again.sum():
            numbers = np.cumsum(~again) - 1
            bins = numbers[bins]
            made = int((~again).sum()) + needed
            bins[some] = new + made - needed
    return bins


def offsets(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Places of the lengths in their sequences, one behind the other."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.searchsorted(bins[order], bins[order])
    out = np.zeros(len(lengths), np.int64)
    out[order] = ends - lengths[order] - (ends - lengths[order])[first]
    return out


def pack(pieces_df: DataFrame, capacity: int = 1024, group_pieces: int = 65_536) -> DataFrame:
    """Give every piece a sequence and an offset in it.

    What the groups leave open is packed once more in groups of its own, so that groups cost
    little; its new sequences have negative numbers.
    """
    fields = f"{PIECES}, sequence_id long, offset long"

    def placed(pdf: pd.DataFrame, bins: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        pdf["sequence_id"], pdf["offset"] = ids, offsets(pdf["length"].to_numpy(), bins)
        return pdf.drop(columns="packing_group")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins = improved(lengths, capacity)
        out = placed(pdf, bins, (pdf["packing_group"].to_numpy().astype(np.int64) << 32) + bins)
        out["full"] = (np.bincount(bins, weights=lengths) == capacity)[bins]
        return out

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"], ignore_index=True)
        ids, old = np.unique(pdf["sequence_id"].to_numpy(), return_inverse=True)
        bins = improved(pdf["length"].to_numpy(), capacity)
        if bins.max() + 1 >= len(ids):
            return placed(pdf, old, ids[old])
        return placed(pdf, bins, -1 - (pdf["packing_group"].to_numpy().astype(np.int64) << 32) - bins)

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        groups = max(1, -(-df.count() // group_pieces))
        return df.withColumn("packing_group", F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int")).groupBy("packing_group")

    table = stored(pieces_df, "pieces")
    once = stored(dealt(table, "doc_id", "piece").applyInPandas(first, f"{fields}, full boolean"), "packed")
    again = dealt(once.where("NOT full").drop("full"), "sequence_id").applyInPandas(second, fields)
    return once.where("full").drop("full").unionByName(again)
