import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from salient.llm import sentencepiece_spans as sps
from salient.llm import token_planes as tp
from salient.session import scratch_path
from tests.llm.helpers import no_docs, odd_docs

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "'s", "'", "s", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "ß", "²", "½", "ª", "中", "あ", "🙂", "\u00a0", "\u3000", "\x1c", "\x00", "<|endoftext|>", "<s>", "<0x0A>",
         "1", "23", ".", "!!", "_", " 'll", "\u0301", "\u2009", "\x85", "Ⅷ", "▁", "▁▁", "the ", "in "]


def texts(n=4000):
    rnd = random.Random(3)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + ["plain words, and\nlines. " * 50 + "x"]


def test_ids_are_the_librarys(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(tp, "PART_BYTES", 2000)
    tok = Tokenizer.from_file(BPE)
    for text, ids in zip(texts(), tp.ByteBpe(BPE).encode(pa.array(texts()))):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_plane_file_round_trip(tmp_path, mode):
    rnd = np.random.default_rng(0)
    docs = [(i, rnd.integers(0, top, n).astype(np.uint32)) for i, (n, top) in enumerate([(0, 9), (1, 9), (5000, 50_000), (3, 1 << 32), (2048, 2), (0, 2)])]
    path = str(tmp_path / "x.planes")
    fs = pafs.LocalFileSystem()
    with fs.open_output_stream(path) as out:
        w = tp.PlaneWriter(out, mode, block=1024)
        for i, ids in docs:
            w.add(i, ids)
        w.close()
    with fs.open_input_file(path) as f:
        r = tp.PlaneReader(f)
        assert [d[0] for d in r.docs] == [i for i, _ in docs]
        for (_, start, n), (_, ids) in zip(r.docs, docs):
            got = list(r.pieces(start, n))
            assert np.array_equal(np.concatenate(got) if got else np.zeros(0, np.uint32), ids)
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-3])
    with fs.open_input_file(path) as f, pytest.raises(ValueError):
        tp.PlaneReader(f)


def test_planes_over_documents(spark, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(tp, "FILE_BYTES", 50_000)
    docs = odd_docs(spark)
    folder = scratch_path(spark, "planes-test")
    files = tp.write_planes(docs, BPE, folder)
    assert files.count() > 1
    got = tp.read_planes(files, folder).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    tok, start, want = Tokenizer.from_file(BPE), 0, []
    for i, text in rows:
        ids = np.asarray([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_planes_of_nothing(spark):
    folder = scratch_path(spark, "planes-test")
    assert tp.read_planes(tp.write_planes(no_docs(spark), BPE, folder), folder).count() == 0


def test_pieces_are_the_librarys_and_spans_fit(monkeypatch):
    import sentencepiece
    monkeypatch.setattr(sps, "PART_BYTES", 2000)
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=PIECES), sps.PieceEncoder(PIECES)
    assert enc.cuts
    for text, e in zip(texts(), enc.encode(pa.array(texts()))):
        raw, ids = text.encode(), lib.encode(text)
        assert e.ids.tolist() == ids and enc.csv(e.ids) == ",".join(map(str, ids)).encode()
        if not ids:
            continue
        assert e.starts[0] == 0 and e.ends[-1] == len(raw) and np.array_equal(e.starts[1:], e.ends[:-1])
        for i, a, b in zip(ids, e.starts, e.ends):
            piece, span = lib.id_to_piece(i), raw[a:b]
            if lib.is_byte(i):
                assert span == bytes([int(piece[3:5], 16)])
            else:
                marked = span.replace(b" ", sps.MARK.encode())
                assert marked == piece.encode() or (a == 0 and sps.MARK.encode() + marked == piece.encode())
        assert enc.decode(e.ids) == lib.decode(ids)


def test_without_cuts_the_spans_are_the_same():
    enc, whole = sps.PieceEncoder(PIECES), sps.PieceEncoder(PIECES)
    whole.cuts = False
    for a, b in zip(enc.encode(pa.array(texts(500))), whole.encode(pa.array(texts(500)))):
        assert np.array_equal(a.ids, b.ids) and np.array_equal(a.starts, b.starts) and np.array_equal(a.ends, b.ends)


def _map(pairs):
    """A compiled character map of a few replacements, laid out by first fit."""
    trie, texts_, at = {}, b"", {}
    for key, value in pairs:
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        at[key] = len(texts_)
        node[None] = len(texts_)
        texts_ += value + b"\0"
    units, used = {0: 0}, {0}

    def place(node, index, label, has):
        children = sorted(k for k in node if k is not None)
        offset = 256
        while any(((index ^ offset) ^ c) in used for c in [*children, *([0] if has else [])]) or (offset >= 1 << 21):
            offset += 256
        units[index] = (offset >> 8 << 10 | 1 << 9 if offset >= 1 << 21 else offset << 10) | (1 << 8 if has else 0) | label
        base = index ^ offset
        if has:
            used.add(base)
            units[base] = node[None] | 1 << 31
        for c in children:
            used.add(base ^ c)
        for c in children:
            place(node[c], base ^ c, c, None in node[c])

    place(trie, 0, 0, False)
    size = max(units) + 1
    table = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(size))
    return struct.pack("<I", len(table)) + table + texts_


def test_longest_prefix_of_the_character_map():
    cmap = sps.CharacterMap(_map([(b"a", b"1"), (b"ab", b"2"), (b"abcd", b"long"), (b"x", b"")]))
    assert cmap.longest(b"abce", 0) == (2, b"2")
    assert cmap.longest(b"zabcdz", 1) == (4, b"long")
    assert cmap.longest(b"ac", 0) == (1, b"1") and cmap.longest(b"x", 0) == (1, b"") and cmap.longest(b"q", 0) is None


def test_normalising_keeps_origins():
    enc = sps.PieceEncoder(PIECES)
    enc.charmap = sps.CharacterMap(_map([("ﬁ".encode(), b"fi"), (b"\t", b" "), ("é".encode(), "e\u0301".encode())]))
    text, origin = enc.normalise("é\tﬁn")
    assert text == "▁e\u0301▁fin"
    assert origin.tolist() == [0, 0, 0, 0, 0, 0, 2, 2, 2, 3, 3, 6, 7]
    enc.trim = True
    assert enc.normalise("  a  b ")[0] == "▁a▁b"


def test_spans_table(spark):
    docs = odd_docs(spark).withColumnRenamed("label", "ids")
    got = sps.encode_spans(docs, PIECES)
    assert got.count() == docs.count() and got.columns[-3:] == ["ids", "starts", "ends"]
    back = sps.decode_ids(got, PIECES).where("text is not null and text not like '%▁%'").select("text", "decoded").collect()
    assert all(r["decoded"] == r["text"] for r in back)
    assert sps.round_trip(no_docs(spark), PIECES).count() == 0
    trip = sps.round_trip(docs, PIECES).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(r["covered_bytes"] == len((r["text"] or "").encode()) for r in trip)


def test_stretches_with_one_hash_keep_their_own_numbers():
    from salient.llm.common import StretchCache

    made = []

    def make(text):
        made.append(text)
        return (np.frombuffer(text.encode(), np.uint8).astype(np.uint32).tobytes(),)

    data = np.frombuffer(b"onetwosix" + b"x" * 5000 + b"y" + b"x" * 4999, np.uint8)
    starts, ends = np.array([0, 3, 6, 0, 3, 9, 5009]), np.array([3, 6, 9, 3, 6, 5009, 10009])
    cache = StretchCache(make)
    for hashes in ([5] * 7, [5, 5, 7, 5, 5, 5, 5], [7, 5, 5, 7, 5, 7, 7]):  # in one batch, and against what is held
        (ids,), length = cache.numbers(data, np.array(hashes, np.uint64), starts, ends)
        assert length.tolist() == (ends - starts).tolist()
        assert ids.astype(np.uint8).tobytes() == b"".join(data[a:b].tobytes() for a, b in zip(starts, ends))
    assert len(set(made)) == 5
