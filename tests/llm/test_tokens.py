import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing, token_files
from palimpsest.llm.bytescan import text_bytes
from palimpsest.llm.shared import new_folder
from palimpsest.llm.tokens import Encoder, encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "\n\n", "a  b", "  a\n\n b \n", "x<|endoftext|>\n\ny", "a\u00a0b\u3000c", "it's  don't\t\tok\r\n x", "é É ñ中文 🙂🙂", "a\x1cb", " \n\t x", "x \n",
       "ΣΑΣ", "é ́x", "Iİ A", "a.b,c", "don't.", "x's, y'", "é. —.a—.", "a1.b2", "naïve,", "l'été", "x" * 5000]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=30), st.text(alphabet="ab .,'\n\té1", max_size=20)), max_size=6))
def test_ids_are_those_of_the_library(name, texts):
    enc = encoder(public_tokenizers.path(name))
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    ids, n = enc.encode(*text_bytes(pa.array(texts, pa.string())))
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])][:len(texts)] == [enc.library.encode(t, add_special_tokens=False).ids for t in texts]


def wanted(rows, name):
    lib, start, out = encoder(public_tokenizers.path(name)).library, 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_what_was_written(spark, edge_docs):
    folder = new_folder(spark, "test")
    token_files.write_token_files(edge_docs, folder, public_tokenizers.path(FILES[0]))
    got = token_files.map_documents(spark, folder, lambda ids: {"crc": zlib.crc32(ids.astype("<u4").tobytes())}, "crc long", most=2)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == wanted([(r.doc_id, r.text) for r in edge_docs.collect()], FILES[0])


def test_no_documents_give_no_files(spark, no_docs):
    folder = new_folder(spark, "test")
    assert token_files.write_token_files(no_docs, folder, public_tokenizers.path(FILES[0])).count() == 0
    assert token_files.map_documents(spark, folder, lambda ids: {}, "").count() == 0


def best(items, cap):
    items, least = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(items):
            least[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            j = rooms.index(room)
            go(i + 1, rooms[:j] + [room - items[i]] + rooms[j + 1:])
        go(i + 1, [*rooms, cap - items[i]])

    go(0, [])
    return least[0]


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 40).flatmap(lambda cap: st.tuples(st.just(cap), st.lists(st.integers(1, cap), max_size=10))))
def test_reduction_keeps_a_best_solution(case):
    cap, items = case
    counts = np.bincount(items, minlength=cap + 1).astype(np.int64) if items else np.zeros(cap + 1, np.int64)
    fixed, left = packing.reduce_instance(counts, cap)
    rest = [x for x in range(cap + 1) for _ in range(left[x])]
    assert sum(p.times for p in fixed) + best(rest, cap) == best(items, cap)
    total = np.zeros_like(counts)
    for p in packing.solve(counts, cap):
        assert sum(p.lengths) <= cap
        for x in p.lengths:
            total[x] += p.times
    assert (total == counts).all()


@pytest.mark.parametrize("together", [200_000, 3])
def test_every_piece_has_a_place_without_gaps(spark, edge_docs, monkeypatch, together):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", together)
    pieces = packing.token_pieces(edge_docs.union(edge_docs), public_tokenizers.path(FILES[1]), capacity=64, keep=("source",))
    got = packing.pack_pieces(pieces, capacity=64).collect()
    lib = encoder(public_tokenizers.path(FILES[1])).library
    want = []
    for r in edge_docs.collect() * 2:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, i, a, len(ids[a:a + 64]), np.array(ids[a:a + 64], "<u4").tobytes()) for i, a in enumerate(range(0, len(ids), 64))]
    key = repr
    assert sorted(((g.doc_id, g.piece, g.start, g.length, bytes(g.ids)) for g in got), key=key) == sorted(want, key=key)
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= -(-sum(g.length for g in got) // 64) + 3


def test_nothing_is_packed_into_nothing(no_docs):
    assert packing.pack_pieces(packing.token_pieces(no_docs, public_tokenizers.path(FILES[1]))).count() == 0


@pytest.mark.parametrize("name", FILES)
def test_words_of_repeats_have_their_own_ids(name, repeats):
    enc = Encoder(public_tokenizers.path(name))
    texts = [*repeats, " ".join(repeats), "c" * 5000, "c" * 5000 + "d"]
    ids, n = enc.encode(*text_bytes(pa.array(texts)))
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_words_with_one_hash_are_told_apart(monkeypatch):
    from palimpsest.llm import tokens

    plain = tokens.hashes
    monkeypatch.setattr(tokens, "hashes", lambda buf, start, end, lane=0: plain(buf, start, end, lane) % np.uint64(3 if lane == 0 else 2**63))
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three four", "five six seven", "eight", "one two"]
    for _ in range(2):
        ids, n = enc.encode(*text_bytes(pa.array(texts)))
        want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
