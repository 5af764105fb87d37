"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix replacement through the model's compiled
character map, white space becomes the space mark, and every byte of the result
remembers the original byte it came from.  Each piece is then projected to the
original byte span it covers.  The ids are those of the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.common import StretchCache, arrow_bytes, is_plain, prepare, stretches, text_or_empty, with_row

MARK = "▁"
PART_BYTES = 2 << 20


class CharacterMap:
    """A compiled character map: a double-array trie of prefixes with their replacements.

    ``blob`` is the normaliser's ``precompiled_charsmap``: the trie's size in
    bytes, its 32-bit units, then the zero-ended replacements.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest mapped prefix of ``text[at:]``."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        stop = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1]:stop]


@dataclass
class Encoded:
    """A text's ids and each piece's original byte span."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class PieceEncoder:
    """Encodes whole texts and keeps the record of each distinct stretch.

    Where no piece holds a space mark after another character, or a line feed,
    merges never cross these places, so a plain text can be cut there; this is
    tested on the vocabulary when the model is loaded.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.charmap = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.full = sentencepiece.SentencePieceProcessor(model_file=path)
        # the same pieces without any normalisation: it gets texts that are normalised already
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.name = "identity"
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.remove_extra_whitespaces = False
        model.normalizer_spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece for p in model.pieces]
        self.size = [1 if p.type == pb.ModelProto.SentencePiece.BYTE else len(p.piece.encode()) for p in model.pieces]
        self.unknown = self.full.unk_id()
        self.cuts = (model.trainer_spec.model_type == pb.TrainerSpec.BPE and model.trainer_spec.byte_fallback
                     and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
                     and self.charmap is None and self.prefix and not self.trim and self.escape)
        self.kept = StretchCache(self._record, columns=2, limit=400_000)
        self.digits = np.array([b"%d" % i for i in range(len(pieces))], object)

    # -- normalisation with alignment

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, original byte offset of each of its bytes and of its end)."""
        raw = text.encode()
        out, origin = bytearray(), []
        space = MARK.encode() if self.escape else b" "
        if raw and self.prefix:
            out += space
            origin += [0] * len(space)
        at, blank = 0, self.trim  # blank: a space here would be an extra one
        while at < len(raw):
            got = self.charmap.longest(raw, at) if self.charmap else None
            if got is None:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                got = (n, raw[at:at + n])
            for i, byte in enumerate(got[1]):
                if byte == 0x20:
                    if not blank:
                        out += space
                        origin += [at] * len(space)
                    blank = self.trim
                else:
                    out.append(byte)
                    origin.append(at + (i if got[1] == raw[at:at + got[0]] else 0))
                    blank = False
            at += got[0]
        if self.trim:
            while out.endswith(space):
                del out[-len(space):]
                del origin[-len(space):]
        origin.append(len(raw))
        return out.decode(), np.asarray(origin, np.int64)

    # -- encoding

    def _lengths(self, ids: list[int], text: str) -> list[int]:
        """Normalised bytes of each piece; unknown pieces share what the others leave, in order."""
        sizes = [self.size[i] for i in ids]
        if self.unknown in ids:
            proto = self.bare.encode(text, out_type="immutable_proto")
            sizes = [len(p.surface.encode()) for p in proto.pieces]
        return sizes

    def _record(self, text: str) -> tuple[bytes, bytes]:
        """A stretch's ids and the original bytes of each of its pieces."""
        bare = text.replace(" ", MARK) if text[:1] in " \n" else MARK + text
        ids = self.bare.encode(bare)
        sizes = self._lengths(ids, bare)
        sizes[0] -= 2 if text[0] == " " else 3 * (text[0] != "\n")  # the mark stands for one byte, or none at the start
        return array("i", ids).tobytes(), array("i", sizes).tobytes()

    def _whole(self, text: str) -> Encoded:
        if not text:
            none = np.zeros(0, np.int64)
            return Encoded(none.astype(np.int32), none, none)
        bare, origin = self.normalise(text)
        ids = self.bare.encode(bare)
        ends = np.cumsum(np.asarray(self._lengths(ids, bare), np.int64))
        stops = np.concatenate([[0], ends])
        spans = origin[np.minimum(stops, len(origin) - 1)]
        return Encoded(np.asarray(ids, np.int32), spans[:-1], spans[1:])

    def encode(self, texts: pa.Array) -> Iterator[Encoded]:
        """Each text of a column."""
        data, offsets = arrow_bytes(texts)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART_BYTES, "right")) - 1)
            yield from self._part(data, offsets[a:b + 1])
            a = b

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Encoded]:
        plain = is_plain(data, offsets, latin=False) & self.cuts
        hashes, starts, ends, bounds = stretches(data, offsets)
        use = np.repeat(plain, np.diff(bounds))
        (ids, widths), length = self.kept.numbers(data, hashes[use], starts[use], ends[use])
        ids, covered = ids.view(np.int32), np.cumsum(widths, dtype=np.int64)
        stop = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(np.where(plain, np.diff(bounds), 0))])]
        for i in range(len(plain)):
            if plain[i]:
                a, b = int(stop[i]), int(stop[i + 1])
                over = covered[a:b] - (covered[a - 1] if a else 0)
                yield Encoded(ids[a:b], np.concatenate([[0], over[:-1]]), over)
            else:
                yield self._whole(data[offsets[i]:offsets[i + 1]].tobytes().decode())

    def csv(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b",".join(self.digits[ids].tolist())

    def decode(self, ids: np.ndarray) -> str:
        return self.full.decode(ids.tolist()) if len(ids) else ""


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_spans(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``, ``starts`` and ``ends`` (arrays of int): each piece and its original byte span.

    Null texts count as empty and have no piece.  Columns of these names in
    ``df`` are replaced; rows and repeats stay as they are.
    """
    prepare(df.sparkSession)
    new = ("ids", "starts", "ends")
    keep = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in new]).alias("row"), text_or_empty(text).alias("t"))

    def run(batches):
        for batch in batches:
            found = list(piece_encoder(model).encode(batch.column("t")))
            cols = [pa.array([getattr(e, n).astype(np.int32) for e in found], pa.list_(pa.int32())) for n in new]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], ["row", *new])

    schema = with_row(keep, *[(n, "array<int>") for n in new])
    return keep.mapInArrow(run, schema).select("row.*", *new)


def decode_ids(df: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text that the library decodes from an array of ids (null: empty)."""
    prepare(df.sparkSession)
    keep = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != to]).alias("row"),
                     F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("i"))

    def run(batches):
        for batch in batches:
            enc = piece_encoder(model)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([enc.full.decode(i) if i else "" for i in batch.column("i").to_pylist()], pa.string())], ["row", to])

    return keep.mapInArrow(run, with_row(keep, (to, "string"))).select("row.*", f"`{to}`")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Digests of each text's encoding and decoding.

    (doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes); the last is
    the end of the last piece's span, the text's length in bytes where the
    normaliser drops nothing at the end.  Texts are encoded once; ids and spans
    stay in the task.  Null texts count as empty; repeated rows stay.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            enc = piece_encoder(model)
            rows = [(len(e.ids), hashlib.sha256(enc.csv(e.ids)).hexdigest(), hashlib.sha256(enc.decode(e.ids).encode()).hexdigest(), int(e.ends[-1]) if len(e.ends) else 0)
                    for e in enc.encode(batch.column("text"))]
            n, ids, text, end = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string()), pa.array(end, pa.int64())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with spans and decoded again."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
