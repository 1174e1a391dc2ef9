"""SentencePiece encoding that keeps offsets: every piece is projected onto the bytes of the original text.

Normalisation takes, at each place, the longest prefix that the model's compiled character map (a double
array of prefixes and their replacements) knows, and records which source bytes each replacement stands
for. The library cuts the pieces; their characters, counted along that record, give each piece's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklines.llm.common import slices

SPACE = "▁"
#: Piece types of the model format.
UNKNOWN, BYTE = 2, 6


class CharacterMap:
    """A compiled character map: bytes of a double array, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, src: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, source bytes it stands for) of the longest known prefix of src[at:]."""
        found, node = None, 0
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node ^= step(self.units[0]) if self.units else 0
        for i in range(at, len(src) if self.units else at):
            node ^= src[i]
            unit = self.units[node]
            if unit & 0x800000FF != src[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(0, found[0])], found[1]


class PieceModel:
    """A model file of the sentencepiece kind: the library cuts the pieces, this class projects them onto the source."""

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(data)
        norm = proto.normalizer_spec
        if not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("spaces must be marked before words")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.plain = not self.map.units and not self.squeeze
        kinds = [p.type for p in proto.pieces]
        self.byte = np.array([k == BYTE for k in kinds])
        self.unknown = kinds.index(UNKNOWN)
        # of a piece: the byte it stands for, -1 for others; characters, of which a byte begins one or none
        value = np.array([int(p.piece[1:-1], 16) if k == BYTE else -1 for k, p in zip(kinds, proto.pieces, strict=True)])
        self.lead = value >= 0xC0
        self.chars = np.where(self.byte, (value < 0x80) | self.lead, [len(p.piece) for p in proto.pieces])

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source bytes before each of its characters and, at the end, all of them).

        The bytes of a replacement go to its first character, those of a prefix that is replaced by nothing to the character before.
        """
        if self.plain:  # an empty map: characters stand for themselves
            c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            taken = np.concatenate([np.zeros(int(self.prefix and len(c) > 0), np.int64), 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)])
            return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE), np.concatenate([[0], np.cumsum(taken)])
        src, at, body = text.encode(), 0, []
        while at < len(src):
            hit = self.map.longest(src, at)
            if hit is None:
                n = 1 + (src[at] >= 0xC0) + (src[at] >= 0xE0) + (src[at] >= 0xF0)
                hit = src[at : at + n], n
            new = hit[0].decode().replace(" ", SPACE)
            if not new:
                body.append(("", hit[1]))
            body += [(c, hit[1] if i == 0 else 0) for i, c in enumerate(new)]
            at += hit[1]
        if self.squeeze:
            body = self._squeezed(body)
        out, lost = [(SPACE, 0)] if self.prefix and any(c for c, _ in body) else [], 0
        for c, n in body:
            if c:
                out.append((c, n + lost))
                lost = 0
            elif out:
                out[-1] = (out[-1][0], out[-1][1] + n)
            else:
                lost += n
        return "".join(c for c, _ in out), np.concatenate([[0], np.cumsum([n for _, n in out], dtype=np.int64)]).astype(np.int64)

    @staticmethod
    def _squeezed(body: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """Runs of spaces as one, none at the ends; source bytes of a removed one go to the character before or, at the start, after."""
        out, owed = [], 0
        for c, n in body:
            if c == "" or c == SPACE and (not out or out[-1][0] == SPACE):
                if out:
                    out[-1] = (out[-1][0], out[-1][1] + n)
                else:
                    owed += n
            else:
                out.append((c, n + owed))
                owed = 0
        if out and out[-1][0] == SPACE:
            n = out.pop()[1]
            if out:
                out[-1] = (out[-1][0], out[-1][1] + n)
        return out

    def ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Where each of the text's pieces ends, in source bytes: its characters, counted along the normaliser's record.

        ValueError if the pieces are not those of the normalised text.
        """
        norm, record = self.normalize(text)
        if (ids == self.unknown).any():  # an unknown piece takes all characters up to the next known one
            at, place = np.zeros(len(ids), np.int64), 0
            for k, i in enumerate(ids):
                if i == self.unknown:
                    rest = range(place + 1, len(norm))
                    place = next((j for j in rest if self.library.piece_to_id(norm[j]) != self.unknown), len(norm))
                else:
                    place += self.chars[i]
                at[k] = place
        else:
            at = np.cumsum(self.chars[ids])
        if len(ids) and at[-1] != len(norm) or not len(ids) and norm:
            raise ValueError("the pieces don't make up the normalised text")
        out = record[at]
        for k in np.flatnonzero(self.lead[ids]):  # the bytes of a character that stands for itself end one after the other
            n, begin = len(norm[at[k] - 1].encode()), out[k - 1] if k else 0
            if out[k] - begin == n:
                out[k : k + n] = begin + 1 + np.arange(n)
        return out

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """(ids without an end id, byte span of each in the original text)."""
        ids = self.library.encode(text)
        ends = self.ends(text, np.array(ids, np.int64)).tolist()
        return ids, list(zip([0, *ends], ends, strict=False))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@lru_cache(maxsize=2)
def piece_model(data: bytes) -> PieceModel:
    return PieceModel(data)


def _encoded(model: PieceModel, batch: pa.RecordBatch, spans: bool) -> pa.RecordBatch:
    """The rows of encode_documents() for a batch of (doc_id, text)."""
    end, rows, ends = model.library.eos_id(), [], []
    for text in batch.column(1).to_pylist():
        ids = model.library.encode(text)
        if spans:
            ends.append(model.ends(text, np.array(ids, np.int64)).astype(np.int32))
        every = [*ids, end]
        rows.append((len(every), _sha(" ".join(map(str, every))), _sha(model.library.decode(every))))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ends"] * spans]
    columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.string()], strict=True))]
    if spans:
        begin = np.cumsum([0, *(len(e) for e in ends)])
        columns.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(np.concatenate(ends), pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names=names)


def encode_documents(docs: DataFrame, model_path: str, spans: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ends for every row of docs(doc_id, text).

    ids end with the model's end id. decoded_sha256 digests what the ids decode to. ends: where each piece but the end id ends in
    the original text, in bytes; a piece begins where the one before ends, the first at 0, so all bytes are covered. spans False: without ends. The model file
    is read by the driver and sent to the executors (half a megabyte). Null text counts as empty: the end id alone.
    Null ids and repeated rows are rows like others. Empty table: no rows.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(shared.value)
        for batch in batches:
            for some in slices(batch, 1):
                yield _encoded(model, some, spans)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ends array<int>" if spans else "")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encoded, schema)
