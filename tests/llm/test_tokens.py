"""Chunk encoder, packing, directly addressable codes, prefix counts."""

import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlink.llm import dac, packing, prefix_counts
from ledgerlink.llm.common import BYTE_BPE, WORD_BPE, encoder, vocabulary

from llm_rows import LONG, MESSY, sentence

ODD = st.lists(st.sampled_from([*"aAbé'.,!1½ \n\t  日ß🙂<|>", "the", "don't", "<|endoftext|>", "  ", "İ", "e\u0301", "Σ"]), max_size=40).map("".join)


def ids(text):
    return encoder(vocabulary(BYTE_BPE)).library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_chunk_encoder_gives_the_librarys_ids(text):
    enc = encoder(vocabulary(BYTE_BPE))
    for _ in range(2):  # then from memory
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_counts_at_every_prefix(text):
    c = prefix_counts.counter(vocabulary(WORD_BPE))
    from tokenizers import Tokenizer

    lib = test_counts_at_every_prefix.lib = getattr(test_counts_at_every_prefix, "lib", None) or Tokenizer.from_file(vocabulary(WORD_BPE))
    store = c.deltas(text)
    want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert [prefix_counts.count_at(store, k) for k in range(len(text) + 1)] == want
    for budget in (0, 1, 3):
        assert prefix_counts.truncate(store, budget) == max(k for k, n in enumerate(want) if n <= budget)


@pytest.mark.parametrize("form", ["{}", "a{}", "{}a", "a{}b", "a {} b", "{0}{0}", ".{}.", "é{}", "'{}s", "日{}本", "<|endoftext|>{}", "x'{}"])
def test_every_byte_value_counts_as_the_library_counts_it(form):
    c = prefix_counts.counter(vocabulary(WORD_BPE))
    lib = Tokenizer.from_file(vocabulary(WORD_BPE))
    for b in [*range(256), 0x301, 0xE33, 0x93E, 0x1161, 0x200B, 0x2028, 0x3000, 0xFEFF]:
        text = form.format(chr(b))
        store = c.deltas(text)
        assert [prefix_counts.count_at(store, k) for k in range(len(text) + 1)] == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text


PARTS = ["a", "B", "é", "e\u0301", "'s", "'re", "'", "!", "..", "1", "23", "\x00", "\x1c", "日本", "か\u3099", "\u1112\u1161\u11ab", "İ", "<|endoftext|>", "<|endof", "\u3000", "\xa0", "ß", "the", "_", "½", "हिं", "🙂", "\u200d"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=5, unique=True), st.integers(100, 500), st.randoms(use_true_random=False))
def test_long_chunks_are_cut_where_it_makes_no_difference(parts, n, r):
    text = "".join(r.choice(parts) for _ in range(n))
    c = prefix_counts.counter(vocabulary(WORD_BPE))
    lib = Tokenizer.from_file(vocabulary(WORD_BPE))
    store = c.deltas(text)
    for k in [len(text), *[r.randrange(len(text) + 1) for _ in range(8)]]:
        assert prefix_counts.count_at(store, k) == len(lib.encode(text[:k], add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["ab" * 50_000 + "<|endoftext|>", "日本語" * 16_000 + "'" + "日本語" * 17_000, "'" + "日本語" * 33_000, "it's" * 25_000, "हि" * 50_000, "か\u3099" * 50_000, "." * 100_000])
def test_unspaced_texts_take_linear_time(text):
    c = prefix_counts.counter(vocabulary(WORD_BPE))
    began = time.process_time()
    store = c.deltas(text)
    assert time.process_time() - began < 10  # quadratic work would take hours
    assert prefix_counts.count_at(store, len(text)) == len(Tokenizer.from_file(vocabulary(WORD_BPE)).encode(text, add_special_tokens=False).ids)


def test_prefix_counts_on_messy_rows(messy, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary(WORD_BPE))
    rows = prefix_counts.prefix_counts(messy, with_store=True).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in MESSY)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    long = next(r for r in rows if r.doc_id == 11)
    assert len(lib.encode(LONG[: long.cut], add_special_tokens=False).ids) <= 2048
    assert prefix_counts.prefix_counts(empty).count() == 0


def lowest(total, capacity):
    return -(-total // capacity)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=12))
def test_plan_is_best_fit_over_counts(histogram):
    runs = packing.plan(histogram, 64)
    slots, placed = {}, dict.fromkeys(histogram, 0)
    for length, rank, n, per, first, at in runs:
        assert rank == placed[length]  # ranks are gapless
        placed[length] += n
        for k in range(n):
            slots.setdefault(first + k // per, []).append((at + k % per * length, length))
    assert placed == histogram
    for s in slots.values():
        end = 0
        for at, length in sorted(s):
            assert at == end
            end = at + length
        assert end <= 64
    rooms = []  # best-fit decreasing, piece by piece
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            room = min(fits) if fits else 64
            if fits:
                rooms.remove(room)
            rooms.append(room - length)
    assert len(slots) == len(rooms)


def test_packing_on_messy_rows(messy, empty):
    rows = packing.pack(messy, with_ids=True).collect()
    whole = {}
    for i, t, *_ in MESSY:
        whole.setdefault(i, []).append([*ids(t), 0])
    got = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 2048
        got.setdefault(r.doc_id, []).append(r)
    assert {k: sum(map(len, v)) for k, v in whole.items()} == {k: sum(r.length for r in v) for k, v in got.items()}
    long = sorted(got[11], key=lambda r: r.piece)
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in long]).tolist() == whole[11][0]
    assert [r.piece for r in long] == list(range(len(long))) and all(r.length == 2048 for r in long[1:])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for at, length in sorted(s):
            assert at == end
            end += length
        assert end <= 2048
    assert lowest(sum(r.length for r in rows), 2048) <= len(sequences) <= lowest(sum(r.length for r in rows), 2048) + 2
    assert packing.pack(empty).count() == 0


def test_one_length_may_hold_all_pieces(spark):
    rows = packing.slots(spark.range(5000).selectExpr("id", "700 as length"), salts=16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5000
    assert {r.offset for r in rows} == {0, 700} and len({r.sequence_id for r in rows}) == 2500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**32 - 1), st.sampled_from([255, 256, 65535, 65536])), max_size=1500))
def test_codes_give_every_id(values):
    codes = dac.Codes(dac.encode(np.array(values, np.uint32)))
    assert codes.all().tolist() == values
    assert [codes[i] for i in range(len(codes))] == values
    places = np.random.default_rng(len(values)).integers(0, max(1, len(values)), len(values))
    assert codes.at(places).tolist() == [values[i] for i in places]
    assert codes.at(np.arange(len(values))).tolist() == values


def test_codes_of_messy_rows(spark, messy, empty):
    segments = dac.write(messy, buckets=4, segment_tokens=200)
    rows = sorted(dac.read(segments).collect(), key=lambda r: r.start)
    order = sorted(MESSY, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t, *_) in zip(rows, order, strict=True):
        want = [*ids(t), 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert (r.first_token, r.last_token) == (want[0], 2)
        at += len(want)
    want = {i: [*ids(t), 2] for i, t, *_ in MESSY if i in (6, 10, 11)}
    asked = [(i, p) for i, v in want.items() for p in (0, 3, len(v) // 2, len(v) - 1, len(v))]
    found = dac.tokens_at(segments, spark.createDataFrame(asked, "doc_id long, position long")).collect()
    assert {(r.doc_id, r.position): r.token for r in found} == {(i, p): (want[i][p] if p < len(want[i]) else None) for i, p in asked}
    assert dac.read(dac.write(empty)).count() == 0


def test_codes_refuse_other_files():
    with pytest.raises(ValueError):
        dac.Segment(b"XXXX" + bytes(24))


def test_long_words_are_not_remembered():
    c = prefix_counts.PrefixCounter(vocabulary(WORD_BPE))
    c.deltas("x" * 500 + " " + sentence(1))
    assert all(len(k) <= 64 for k in c.chunks)
