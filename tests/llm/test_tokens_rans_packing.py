import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fightlake.llm import packing, rans, tokens
from fightlake.llm.common import shared_dir
from fightlake.llm.tokens import default_path, text_encoder

ODD = ["", "a  b\n\n c", "  lead", "tail \n", "x\t\ty 's it's  z", "é\x85 ü", "a\x1c b", "日本 語　x", "1 2  3\r\n 4", "<|endoftext|> a", " a.b", "\nx.", " ", "\n", "a ", "a\n"]
ODD += ["x, y.z ., ..", "a.,", "é, ü.", "1. 2, ٣.", "ʼ. x", "a\t\tb", "it's. don't,", "the the.\nThe, the", "ǅa x", "á. b"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(default_path())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def rows():
    rng = random.Random(4)
    words = ["the", "of,", "thing.", "été", "it's", "x1", "--", "a\nb", "über,"]
    texts = ODD + [None] + [" ".join(rng.choice(words) + rng.choice(["", "", "q", "."]) for _ in range(rng.randint(1, 900))) for _ in range(80)] + ["w " * 9000]
    out = [((i * 37) % 1009, t, "x", i) for i, t in enumerate(texts)]
    return out + [out[3], (None, "no id", "x", 0), (None, None, "x", 1), (-5, "below zero", None, None)]


def test_encoder_equals_the_library(plain):
    encoder = text_encoder(default_path())
    for _ in range(2):
        for _, text, *_ in rows():
            assert encoder.document(text).tolist() == plain(text), text


def test_rans_round_trip_of_many_shapes():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (5, 3), (511, 9), (512, 2), (513, 50000), (70000, 50257), (200000, 4)):
        ids = (rng.zipf(1.3, n) % k).astype(np.uint32)
        table = rans.Table(rans.quantised(np.bincount(ids)))
        assert int(table.freq.sum()) == 1 << rans.BITS
        again = rans.Table.unpacked(table.packed())
        assert (again.decode(n, *table.encode(ids)) == ids).all()
    data = bytearray(rans.packed_block(table, [(1, ids)]))
    data[-3] ^= 8
    with pytest.raises(ValueError):
        rans.unpacked_block(table, bytes(data))


def test_quantised_sums_hold_for_flat_and_steep_counts():
    for counts in (np.ones(50257, int), np.array([10**9, 1, 1, 0, 1]), np.r_[10**6, np.ones(200000, int)], np.array([7])):
        freq = rans.quantised(counts)
        assert freq.sum() == 1 << rans.BITS and ((freq > 0) == (counts > 0)).all()


def test_files_give_every_document_back(spark, plain):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, path string, start long")
    index = rans.write_ids(docs, shared_dir(spark, "ids"), segment=20000, block=3000)
    assert index.count() > 5
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in rans.read_ids(index).collect()), key=lambda r: r[0])
    start = 0
    for doc_id, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        raw = np.array(plain(text), "<u4").tobytes()
        assert got.pop(0) == (start, doc_id, len(raw) // 4, zlib.crc32(raw), raw)
        start += len(raw) // 4
    assert not got
    assert rans.read_ids(rans.write_ids(docs.limit(0), shared_dir(spark, "ids"))).count() == 0


def test_packing_is_whole_gapless_and_near_the_bound(spark, plain):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, bin string, part long")
    for per_partition in (50_000, 20):
        got = packing.pack(packing.pieces_of(docs, 512), 512, per_partition).collect()
        want = []
        for doc_id, text, *_ in data:
            ids, start, piece = plain(text), 0, 0
            end = len(ids) % 512 or 512
            while start < len(ids):
                want.append((doc_id, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
                start, end, piece = end, end + 512, piece + 1
        assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 512
        bound = packing.lower_bound(np.array([r.length for r in got]), 512)
        assert bound <= len(bins) <= bound + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_bounds_are_bounds_and_fits_are_best():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = np.sort(rng.integers(1, rng.integers(3, 101), rng.integers(1, 60)))[::-1]
        bins, offsets, n = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= n
        assert (np.bincount(bins, lengths) <= 100).all()
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_half_a_million_pieces_are_encoded_once():
    memory = tokens.text_encoder(tokens.default_path(), rans.PIECES)._memory
    made = []
    memory.make = lambda piece: made.append(piece) or b""
    for _ in range(2):
        for i in range(500_000):
            memory[f" {i}"]
    assert len(made) == 500_000
    tokens.text_encoder.cache_clear()


def test_short_cuts_are_the_patterns_they_stand_for():
    for i in range(0x3000):
        for text in (chr(i), f"a{chr(i)}", f"{chr(i)}\u2019"):
            assert tokens._odd(text) == bool(tokens._ODD.search(text)), ascii(text)
    encoder = tokens.TextEncoder(tokens.default_path())
    for i in range(0x250):
        piece = f" {chr(i)}a"
        spelt = piece.encode().decode("latin-1").translate(encoder._letters)
        assert encoder._piece(piece) == b"".join(encoder._spelt(t.id) for t in encoder._tokenize(spelt)), ascii(piece)
