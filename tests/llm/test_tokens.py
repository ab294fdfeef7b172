"""SentencePiece agenda and packing against the libraries."""

import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import packing, sentencepiece_codec
from tidemark.llm.queries import op4_sentencepiece, op6_packing, table, tokenizer_path

ODD = ["", " ", "a  b", "  a b  ", "a\nb", "a\tb", "x▁y", "\xa0z", "<s> hi </s>", "日本語 字", "\x00a\x01", "🙂 ok", "a\r\nb\n\nc \n d\n", "\n", "a\n b", "<|endoftext|>x", "it's we'll \x85 x", "a b   c", "é" * 300]


def test_agenda_equals_library(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in op4_sentencepiece(spark, sf).collect():
        ids = sp.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(tokenizer_path("piece_bpe_32k.model")), most_units=3)
    for text in ODD:
        ids = codec.encode_ids(text)
        assert ids == sp.encode(text) and codec.decode_ids(ids) == sp.decode(ids)
    codec.check()


def test_round_trip_frames(spark, weird):
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode_to_ids(weird, path)
    back = sorted((str(r.doc_id), r.text) for r in sentencepiece_codec.decode_to_text(encoded, path).collect())
    assert back == sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in weird.collect())


def test_a_wrong_unit_is_noticed():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(tokenizer_path("piece_bpe_32k.model")))
    codec.encode("hello")
    codec.unchecked.append(("▁hello", [5]))
    with pytest.raises(ValueError):
        codec.check()


def test_matrix_and_heap_agendas_agree():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(tokenizer_path("piece_bpe_32k.model")))
    rng = np.random.default_rng(1)
    letters = list("aaeeinorstthhlu▁.,é日\x01🙂Zq-1")
    units = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)]
    units = [u for u in units if "▁▁" not in u]
    assert codec.agendas(units) == [codec.agenda(u) for u in units]


def test_pieces_and_packing(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = op6_packing(spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
        by_sequence.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for d in table(spark, sf, "documents").collect():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for k in range(len(by_doc[d.doc_id])):
            r = by_doc[d.doc_id][k]
            assert r.start == at and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by_sequence) <= 1.06 * sum(r.length for r in rows) / 1024 + 1


def test_units_equal_library_on_odd_texts():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens = packing.Tokens(f.read(), most_units=3)
    for text in ODD:
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == tokens.library.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 21, 300)
    bins, number = packing.sum_of_squares(lengths, 20, np.argsort(-lengths, kind="stable"))
    gaps, made = {}, 0
    for i in np.argsort(-lengths, kind="stable"):
        size, options = int(lengths[i]), []
        counts = lambda g: sum(1 for x in g.values() if 0 < x < 20)
        assert counts(gaps) >= 0
        for gap in sorted({g for g in gaps.values() if g >= size} | {20}):
            after = list(gaps.values())
            if gap < 20:
                after.remove(gap)
            after.append(gap - size)
            options.append((sum(after.count(g) ** 2 for g in range(1, 20)), gap))
        chosen = gaps.get(int(bins[i]), 20)
        assert chosen == min(options)[1]
        made = max(made, int(bins[i]) + 1)
        gaps[int(bins[i])] = chosen - size
    assert made == len(gaps) == number


def test_rounds_leave_fewer_sequences_and_keep_every_piece():
    rng = np.random.default_rng(4)
    lengths = np.minimum(1024, rng.integers(1, 700, 5000) * rng.integers(1, 3, 5000))
    once, made = packing.sum_of_squares(lengths, 1024, np.argsort(-lengths, kind="stable"))
    bins = packing.improved(lengths, 1024)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 1024 and fill.min() > 0 and len(fill) <= made
    assert len(fill) <= 1.004 * lengths.sum() / 1024 + 1
    at = packing.offsets(lengths, bins)
    for b in range(0, len(fill), 97):
        spans = sorted(zip(at[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
        assert [s for s, _ in spans] == np.r_[0, np.cumsum([n for _, n in spans])[:-1]].tolist()
    assert len(packing.improved(lengths[:0], 1024)) == 0 and packing.improved(lengths[:1], 1024).tolist() == [0]


def test_groups_cost_little(spark):
    """Pieces on both sides of a group's boundary: two groups need hardly more than one."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 900, 4000))], packing.PIECES)
    count = lambda most: packing.pack(rows, group_pieces=most).select("sequence_id").distinct().count()
    whole = count(4000)
    assert count(2000) <= 1.008 * whole + 1 and count(3999) <= 1.008 * whole + 1  # 0.6 % here, with groups this small
    packed = packing.pack(rows, group_pieces=300).collect()
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    assert len(packed) == 4000 and len(spans) <= 1.05 * whole
    for parts in spans.values():
        parts.sort()
        assert [a for a, _ in parts] == np.r_[0, np.cumsum([n for _, n in parts])[:-1]].tolist() and sum(n for _, n in parts) <= 1024


def test_odd_rows(spark, weird, no_rows):
    packed = packing.pack(packing.pieces(weird, tokenizer_path("byte_bpe_50k.json")))
    assert packed.where("piece = 0").count() == weird.count()
    path = tokenizer_path("piece_bpe_32k.model")
    assert sentencepiece_codec.encode_documents(weird, path).count() == weird.count()
    assert packing.pack(packing.pieces(no_rows, tokenizer_path("byte_bpe_50k.json"))).count() == 0
    assert sentencepiece_codec.encode_documents(no_rows, path).count() == 0
