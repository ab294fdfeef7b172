"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs.  All adjacent pairs that form
a piece wait in the agenda, best score first and leftmost first among equals; the top pair
is merged and its new neighbours join the agenda until it is empty.  The agendas of many
short units are rows of one numpy matrix, which holds the rank of each pair by score, and
take a step together; a long unit's agenda is a heap.

No piece of such a vocabulary holds the word mark after another character (this is
checked when the tables are built), and none holds a newline, so merges never cross
those places and the agenda may run on one unit at a time.  Units repeat, so a worker
keeps their ids in a bounded cache.  Every unit that an agenda encodes is compared
with the sentencepiece library, one bulk call for each part of an Arrow batch.

Defined results: a null or empty text has no ids; very long texts are encoded whole;
any further columns of the input are ignored; rows with equal ids are all returned.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.runtime import bounded, ship

MARK = "▁"  # SentencePiece's visible space
SHORT, ROWS = 64, 8192  # longest unit in a matrix of agendas, and rows of a matrix
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Codec(dict):
    """Maps a token, a word after a space or a newline and the word after it, to its ids as
    b"1,2,".  ``apart`` does so for the units of texts whose white space isn't as plain."""

    def __init__(self, model: bytes, most_units: int = 1_600_000, longest_kept: int = 64):
        super().__init__()
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.most_units, self.longest_kept = most_units, longest_kept
        size = lib.get_piece_size()
        special = [i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)]
        names = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in special if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        hidden = set(special)
        self.ids = {names[i]: i for i in range(size) if i not in hidden}
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Rank of every piece by score, the best first; equal scores share a rank.
        self.ranks = {p: place[s] for p, s in scores.items()}
        self.unknown = lib.unk_id()
        self.digits = [b"%d," % i for i in range(size)]
        self.bytes_of = [bytes([self.byte_of[i]]) if i in self.byte_of else names[i].replace(MARK, " ").encode() for i in range(size)]
        #: Characters that stand side by side in some piece: merges cross no other place.
        self.joins = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.stretches: dict[str, list[int]] = {}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece holds the word mark or a newline inside; units can't be told apart")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        probe = lib.encode("  a  ")
        if "".join(names[i] for i in probe) != f"{MARK * 3}a{MARK * 2}":
            raise ValueError("the vocabulary normalises white space; only identity normalisation is supported")
        self.apart: dict[str, bytes] = {}
        self.unchecked: list[tuple[str, list[int]]] = []
        self._pair_table(size, place)

    def _pair_table(self, size: int, place: dict[float, int]) -> None:
        """Ranks of all pairs of pieces that form a piece, sorted by the pair's number."""
        ids = self.ids
        #: In a matrix a rank must name one piece, and every character of a piece must be one.
        self.plain = all(ch in ids for p in ids for ch in p)
        often = Counter(self.ranks.values())
        self.shared = re.compile("|".join(sorted({re.escape(p[:2]) for p, r in self.ranks.items() if often[r] > 1 and len(p) > 1})) or "(?!)")
        self.none = len(place)
        self.pad, self.outside = size, size + 1  # symbols that aren't pieces; characters follow from ``outside`` on
        pairs = [(ids[p[:k]] << 21 | ids[p[k:]], self.ranks[p]) for p in ids for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = np.append(table[:, 0], np.int64(1) << 62), np.append(table[:, 1], self.none).astype(np.int32)
        self.piece_of_rank = np.zeros(len(place), np.int64)
        self.piece_of_rank[list(self.ranks.values())] = [ids[p] for p in self.ranks]
        self.char_ids = self.outside + np.arange(0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i

    def pair_ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 21 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none).astype(np.int32)

    def agendas(self, units: list[str]) -> list[list[int]]:
        """Ids of many units: a row of ``ranks`` is a unit's agenda, and in each round the best
        and leftmost pair of every row is merged."""
        sizes = np.array([len(u) for u in units])
        symbols = np.full((len(units), int(sizes.max())), self.pad, np.int64)
        symbols[np.arange(symbols.shape[1]) < sizes[:, None]] = self.char_ids[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        ranks = self.pair_ranks_of(symbols[:, :-1], symbols[:, 1:])
        rows, out = np.arange(len(units)), [[] for _ in units]

        def finish(which: np.ndarray) -> None:
            part = symbols[which]
            held = part != self.pad
            flat, ends = part[held].tolist(), np.cumsum(held.sum(axis=1)).tolist()
            for row, a, b in zip(rows[which].tolist(), [0, *ends], ends, strict=False):
                out[row] = flat[a:b]

        while len(rows):
            if not ranks.shape[1]:
                finish(np.ones(len(rows), bool))
                break
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            going = best < self.none
            if not going.all():
                finish(~going)
                rows, symbols, ranks, at, best = rows[going], symbols[going], ranks[going], at[going], best[going]
            line, at = np.arange(len(rows)), at[:, None]
            symbols[line, at[:, 0]] = self.piece_of_rank[best]
            col = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, col + (col > at), 1)
            col = col[:-1]
            ranks = np.take_along_axis(ranks, col + (col >= at), 1)
            for first in (at[:, 0] - 1, at[:, 0]):  # the pairs on both sides of the merged symbol
                some = np.flatnonzero((first >= 0) & (first < ranks.shape[1]))
                ranks[some, first[some]] = self.pair_ranks_of(symbols[some, first[some]], symbols[some, first[some] + 1])
        for i, ids in enumerate(out):
            if max(ids) >= self.outside:
                out[i] = list(chain.from_iterable([x] if x < self.outside else [self.byte_ids[b] for b in chr(x - self.outside).encode()] for x in ids))
        return out

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit, by stretches that merges may cross.

        A plain word is one stretch.  Others are taken apart, as their words repeat.
        """
        if unit.lstrip(MARK).isalpha():
            return self.agenda(unit)
        joins, start, out = self.joins, 0, []
        for k in range(1, len(unit) + 1):
            if k == len(unit) or unit[k - 1 : k + 1] not in joins:
                stretch = unit[start:k]
                ids = self.stretches.get(stretch)
                if ids is None:
                    ids = self.agenda(stretch)
                    if len(stretch) <= self.longest_kept and len(stretch) < len(unit):
                        if len(self.stretches) >= self.most_units:
                            self.stretches.clear()
                        self.stretches[stretch] = ids
                out += ids
                start = k
        return out

    def agenda(self, stretch: str) -> list[int]:
        """Ids of a stretch: merge the best adjacent pair until none is a piece.

        An entry of the agenda is one integer: the piece's rank by score, then the left
        and the right place, then the piece's length, which tells outdated entries.
        """
        n, ranks = len(stretch), self.ranks
        b = (n + 1).bit_length()
        low = (1 << b) - 1
        symbols, sizes = list(stretch), [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            rank = ranks.get(stretch[i : i + 2])
            if rank is not None:
                agenda.append((((rank << b | i) << b | (i + 1)) << b) | 2)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            right, left = entry >> b & low, entry >> 2 * b & low
            size = sizes[left] + sizes[right]
            if size != entry & low or not sizes[left] or not sizes[right]:
                continue  # one of the two was merged into something else meanwhile
            symbols[left] = merged = symbols[left] + symbols[right]
            sizes[left], sizes[right] = size, 0
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                rank = ranks.get(merged + symbols[far])
                if rank is not None:
                    heappush(agenda, (((rank << b | left) << b | far) << b) | (size + sizes[far]))
            near = before[left]
            if near >= 0:
                rank = ranks.get(symbols[near] + merged)
                if rank is not None:
                    heappush(agenda, (((rank << b | near) << b | left) << b) | (sizes[near] + size))
        out: list[int] = []
        at, known = 0, self.ids
        while at < n:
            piece = known.get(symbols[at])
            if piece is None:
                out += [self.byte_ids[x] for x in symbols[at].encode()]
            else:
                out.append(piece)
            at = after[at]
        return out

    def unit_bytes(self, ids: list[int]) -> bytes:
        """What ids stand for, before the leading space of the text is taken off."""
        return b"".join([self.bytes_of[i] for i in ids])

    def written(self, units: list[str]) -> list[bytes]:
        """Ids of units as b"1,2,"; each unit's ids are compared with the library's, and what
        they decode to with the unit."""
        short = sorted({u for u in units if 0 < len(u) <= SHORT and not self.shared.search(u)} if self.plain else (), key=len)
        found = {u: self.merge(u) for u in set(units).difference(short) if u}
        for start in range(0, len(short), ROWS):
            part = short[start : start + ROWS]
            found.update(zip(part, self.agendas(part), strict=True))
        self.unchecked += found.items()
        self.check()
        digits = {u: b"".join([self.digits[i] for i in ids]) for u, ids in found.items()} | {"": b""}
        return [digits[u] for u in units]

    def check(self) -> None:
        """Compare what was encoded since the last call with the library."""
        asked, self.unchecked = self.unchecked, []
        # Behind a newline, which nothing merges with, a unit is encoded as in a text.
        lead = self.library.encode("\n")
        given = ["\n" + u.replace(MARK, " ") for u, _ in asked]
        for (unit, ids), theirs in zip(asked, self.library.encode(given, num_threads=1) if given else [], strict=True):
            if theirs[len(lead) :] != ids:
                raise ValueError(f"the agenda and the library differ on {unit[:80]!r}")
            if self.unit_bytes(ids) != unit.replace(MARK, " ").encode():
                raise ValueError(f"the ids of {unit[:80]!r} don't decode to it")

    def tokens(self, text: str) -> list[str] | None:
        """Tokens of a text, None if it holds the word mark or white space beside white space."""
        out = text.replace("\n", " \n").split(" ")
        return None if "" in out or MARK in text else out

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(MARK + text.replace(" ", MARK))

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids in decimal joined by commas, decoded text in UTF-8) of each text.

        Every unit is known to decode to itself, so a text decodes to itself but for marks.
        """
        plain = [self.tokens(t) if t else [] for t in texts]
        odd = {i: self.units(texts[i]) for i, p in enumerate(plain) if p is None}
        wanted, others = set(chain.from_iterable(p for p in plain if p)), set(chain.from_iterable(odd.values()))
        if len(self) + len(self.apart) + len(wanted) + len(others) > self.most_units:
            self.clear()
            self.apart.clear()
        new, apart = [k for k in wanted if k not in self], [u for u in others if u not in self.apart]
        line = self.written(["\n"])[0]
        for key, ids in zip(new, self.written([k[1:] if k[0] == "\n" else MARK + k for k in new]), strict=True):
            self[key] = line + ids if key[0] == "\n" else ids
        self.apart.update(zip(apart, self.written(apart), strict=True))
        out = []
        for i, text in enumerate(texts):
            ids = b"".join(map(self.apart.__getitem__, odd[i]) if plain[i] is None else map(self.__getitem__, plain[i]))
            out.append((ids[:-1], text.replace(MARK, " ").encode() if text else b""))
        for known, added in ((self, new), (self.apart, apart)):
            for key in added:
                if len(key) > self.longest_kept:
                    del known[key]
        return out

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        return self.encode_all([text])[0]

    def encode_ids(self, text: str | None) -> list[int]:
        joined = self.encode(text)[0]
        return [int(i) for i in joined.split(b",")] if joined else []

    def decode_ids(self, ids: list[int]) -> str:
        out = self.unit_bytes(ids)
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec_for(model: bytes) -> Codec:
    """The worker's codec for a model; its cache lives as long as the worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:  # the vocabulary lies with the driver's Python
        return f.read()


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """Ids and round trip of every whole text, as digests: ``SCHEMA``."""
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model.value)
        for batch in bounded(batches, "text", 2 << 20):
            counts, ids, decoded = [], [], []
            for joined, back in codec.encode_all(batch.column("text").to_pylist()):
                counts.append(joined.count(b",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def encode_to_ids(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids themselves, for use outside the digest query."""
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model.value)
        for batch in bounded(batches, "text", 2 << 20):
            ids = [[int(i) for i in joined.split(b",")] if joined else [] for joined, _ in codec.encode_all(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_to_text(encoded: DataFrame, model_path: str) -> DataFrame:
    """Texts of rows (doc_id, ids); null ids give an empty text."""
    spark = encoded.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model.value)
        for batch in batches:
            texts = [codec.decode_ids(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
