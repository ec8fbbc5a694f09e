"""Sentence-piece encoding that keeps source offsets, and decoding.

The normaliser follows the model's compiled character map (a double-array trie
over UTF-8 byte strings with a replacement each): at every position the longest
key wins, else one character stays. Every normalised byte remembers the source
byte it came from, so pieces project to spans of the original text.
Every text takes this way, also where the model's map is empty (that of
piece_bpe_32k.model is): then no byte can begin a key, and the walk has one run.
Cases: null and empty texts have no ids and no spans; the empty text decodes to
itself; very long texts are encoded whole; repeated rows, also of one doc_id, and
null ids are encoded each; further columns change nothing; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronosift.llm.common import arrow_map, texts_of
from chronosift.llm.tokens import vocabulary

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"


class CharacterMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.strings = blob[4 + n :]
        # bytes that a key can begin with: all others pass in runs
        first = [b for b in range(256) if self._begins(b)]
        self.first = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in first) + b"]") if first else re.compile(b"(?!)")

    def _begins(self, byte: int) -> bool:
        if not self.units:
            return False
        place = ((self.units[0] >> 10) << ((self.units[0] & 512) >> 6)) ^ byte
        return place < len(self.units) and self.units[place] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at `at`, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        place = jump(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= jump(unit)
            if unit >> 8 & 1:
                begin = units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[begin : self.strings.index(b"\0", begin)]
        return found

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each the source position it begins at;
        one more entry gives the end."""
        out: list[bytes] = []
        source: list[np.ndarray] = []
        at = 0
        while at < len(data):
            start = self.first.search(data, at)
            stop = start.start() if start else len(data)
            out.append(data[at:stop])
            source.append(np.arange(at, stop))
            if stop == len(data):
                break
            hit = self.longest(data, stop)
            if hit is None:
                n = 1
                while stop + n < len(data) and data[stop + n] & 0xC0 == 0x80:
                    n += 1
                hit = n, data[stop : stop + n]
                source.append(np.arange(stop, stop + n))
            else:
                source.append(np.full(len(hit[1]), stop))
            out.append(hit[1])
            at = stop + hit[0]
        return b"".join(out), np.concatenate([*source, [len(data)]])


class Pieces:
    """Encoder and decoder of one BPE model with byte pieces."""

    def __init__(self, name: str = PIECE_BPE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        path = vocabulary(name)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if not (model.trainer_spec.byte_fallback and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces):
            raise ValueError("made for models that add a mark in front, keep white space and fall back to bytes")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.byte_piece = [p.type == 6 for p in model.pieces]
        #: Bytes of a piece in the normalised text.
        self.marked = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """Per text: ids, and per piece the end of its span in the bytes of the
        original text; spans follow each other without gaps, the added mark has
        none."""
        return [(x, self._ends(t.encode(), x)) for t, x in zip(texts, self.sp.encode(texts, num_threads=1))]

    def _ends(self, data: bytes, ids: list[int]) -> np.ndarray:
        """Ends of the pieces' spans by the alignment of the normalised text,
        in which a mark of three bytes stands for each space and one in front."""
        if not ids:
            return np.zeros(0, np.int64)
        norm, source = self.map.normalise(data)
        wide = np.where(np.frombuffer(norm, np.uint8) == 32, 3, 1)
        places = np.concatenate([[0, 0, 0], np.repeat(source[:-1], wide), source[-1:]])
        ends = np.cumsum(self.marked[ids])
        if ends[-1] != len(places) - 1:
            raise ValueError(f"pieces cover {ends[-1]} of {len(places) - 1} normalised bytes")
        return places[ends]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) per piece, in bytes of the original UTF-8 text."""
        ids, ends = self.encode_all([text])[0]
        return list(zip(ids, [0, *ends[:-1].tolist()], ends.tolist()))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes of byte pieces join; what is no UTF-8 becomes U+FFFD."""
        raw = b"".join([self.bytes[i] for i in ids])
        if ids and not self.byte_piece[ids[0]] and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(name: str = PIECE_BPE) -> Pieces:
    return Pieces(name)


FULL = "doc_id long, n_tokens long, ids array<int>, span_ends binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encode_decode(docs: DataFrame, name: str = PIECE_BPE, full: bool = True) -> DataFrame:
    """Encode and decode every text. `full`: ids, the end of each piece's span
    in source bytes (little-endian unsigned 32-bit integers) and the decoded
    text; else the SHA-256 of the ids (decimals joined by commas), of the decoded
    text and of the span ends (those integers), made beside the encoder so that
    they needn't leave it."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(name)
        got = p.encode_all(b.column("text").to_pylist())
        decoded = [p.decode(x) for x, _ in got]
        ends = [e.astype("<u4").tobytes() for _, e in got]
        out = [b.column("doc_id").cast(pa.int64()), pa.array([len(x) for x, _ in got], pa.int64())]
        if full:
            out += [pa.array([x for x, _ in got], pa.list_(pa.int32())), pa.array(ends, pa.binary()), pa.array(decoded, pa.string())]
            return pa.record_batch(out, names=["doc_id", "n_tokens", "ids", "span_ends", "decoded"])
        out += [pa.array([sha(",".join(map(str, x))) for x, _ in got], pa.string()), pa.array(map(sha, decoded), pa.string()), pa.array([hashlib.sha256(e).hexdigest() for e in ends], pa.string())]
        return pa.record_batch(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return arrow_map(texts_of(docs), run, FULL if full else DIGESTS)
