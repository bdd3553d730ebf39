"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps a score-ordered agenda of adjacent symbol pairs: the pair
whose merged piece scores highest is merged first, the leftmost on a tie, and
the merge's two new neighbours join the agenda. A text falls apart at places
that no piece of the vocabulary crosses (before a run of blanks, around a line
feed), so each distinct part is encoded once per worker and remembered. Every
Arrow batch's new parts are encoded by the sentencepiece library too; a
difference stops the job.

Defined results: a null text is the empty text; the empty text has only the
begin and end ids; all other columns pass through, but for those that bear
the name of an output column, which the output replaces; an empty table gives an empty table; repeated
rows give repeated rows. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from stonefold.llm.common import FLUSH_BYTES, claim, remember, spread, texts

#: Most remembered parts in a Python worker (some 200 bytes each).
MEMO_PARTS = 900_000
SPACE = "▁"


class Codec:
    """Encoder and decoder of one model file; identity normalization with a leading blank is asked for."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        norm, spec = proto.normalizer_spec, proto.trainer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("a BPE model with identity normalization and a leading blank is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [p.piece for p in proto.pieces]
        types = [p.type for p in proto.pieces]
        if any(t in (4, 5) for t in types):
            raise ValueError("user-defined and unused pieces are not handled")
        self.begin, self.end, self.unknown = self.pieces.index(spec.bos_piece), self.pieces.index(spec.eos_piece), types.index(2)
        self.normal = {p: i for i, (p, t) in enumerate(zip(self.pieces, types, strict=True)) if t == 1}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(types) if t == 6}
        self.byte_fallback = spec.byte_fallback and len(self.byte_ids) == 256
        #: rank of a merged piece: 0 is the highest score; equal scores share a rank
        scores = sorted({p.score for p in proto.pieces}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        self.pairs: dict[int, tuple[int, int]] = {}
        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                left, right = self.normal.get(piece[:cut]), self.normal.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = (rank_of[proto.pieces[i].score], i)
        #: what decode() emits for each id; control pieces emit nothing
        self.raw = [b"" if t == 3 else b" \xe2\x81\x87 " if t == 2 else bytes([int(p[3:5], 16)]) if t == 6 else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, types, strict=True)]
        # A part may begin before a run of blanks if none follows another character inside a piece.
        inner = any(a != SPACE and b == SPACE for p in self.normal for a, b in zip(p, p[1:], strict=False))
        newline = any("\n" in p for p in self.normal)
        self.part = re.compile("(?s:.+)" if inner or newline else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.fresh: list[str] = []

    def merge(self, part: str) -> list[int]:
        """Ids of one part, by the agenda."""
        normal, pairs = self.normal, self.pairs
        n = len(part)
        ids = [normal.get(c, -1) for c in part]
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = []
            for i in range(n - 1):
                if (a := ids[i]) >= 0 and (b := ids[i + 1]) >= 0 and (m := pairs.get(a << 32 | b)):
                    agenda.append((m[0], i, a, b, m[1]))
            heapq.heapify(agenda)
            while agenda:
                _, i, a, b, merged = heapq.heappop(agenda)
                if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                    continue
                ids[i], ids[j] = merged, -2
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if ids[k] >= 0 and (m := pairs.get(merged << 32 | ids[k])):
                        heapq.heappush(agenda, (m[0], i, merged, ids[k], m[1]))
                if (h := before[i]) >= 0 and ids[h] >= 0 and (m := pairs.get(ids[h] << 32 | merged)):
                    heapq.heappush(agenda, (m[0], h, ids[h], merged, m[1]))
        if -1 not in ids:
            return [i for i in ids if i != -2]
        out = []
        last_unknown = False
        for i, x in enumerate(ids):
            if x == -1:
                if self.byte_fallback:
                    out += [self.byte_ids[b] for b in part[i].encode()]
                elif not last_unknown:
                    out.append(self.unknown)
                last_unknown = True
            elif x != -2:
                out.append(x)
                last_unknown = False
        return out

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def look_up(self, part: str) -> tuple[bytes, bytes]:
        ids = self.merge(part)
        self.fresh.append(part)
        self.memo[part] = found = (packed(ids), self.bytes_of(ids))
        return found

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """(packed ids with begin and end, the decoded text in UTF-8)."""
        if not text:
            return packed([self.begin, self.end]), b""
        memo, look_up = self.memo, self.look_up
        found = [memo.get(p) or look_up(p) for p in self.part.findall(SPACE + text.replace(" ", SPACE))]
        ids = b"".join([packed([self.begin]), *[x[0] for x in found], packed([self.end])])
        return ids, decoded(b"".join([x[1] for x in found]))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids, as the library's decode()."""
        body = [i for i in ids if i not in (self.begin, self.end)]
        blank = bool(body) and self.pieces[body[0]][:1] == SPACE
        return decoded(self.bytes_of(body), blank).decode()

    def check_fresh(self) -> None:
        """Compare the parts first met since the last call with the library, then bound the memory."""
        fresh, self.fresh = self.fresh, []
        #: a part after a line feed has no blank before it; the library then gets the line feed too
        asked = [p[1:] if p[0] == SPACE else "\n" + p for p in fresh]
        skip = self.library.encode("\n")
        for part, ids in zip(fresh, self.library.encode(asked, num_threads=1), strict=True):
            if part[0] != SPACE:
                ids = ids[len(skip) :] if ids[: len(skip)] == skip else None
            elif not part[1:]:  # the library gives the empty text no blank
                ids = [self.normal[SPACE]]
            if ids is None or packed(ids) != self.memo[part][0]:
                raise AssertionError(f"the agenda and the sentencepiece library differ on {part!r}")
        if len(self.memo) > MEMO_PARTS:
            self.memo.clear()


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(ids: bytes) -> list[int]:
    out = array("I")
    out.frombytes(ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tolist()


def decoded(raw: bytes, blank: bool = True) -> bytes:
    """Drop the first piece's blank; a byte that is not part of valid UTF-8 becomes U+FFFD."""
    raw = raw[1:] if blank and raw[:1] == b" " else raw
    try:
        raw.decode()
    except UnicodeDecodeError:
        raw = lenient(raw).encode()
    return raw


def lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        i += n
    return "".join(out)


_CODECS: dict[str, Codec] = {}
remember("sentencepiece", _CODECS.clear)


def codec(model_path: str) -> Codec:
    """One codec a worker, kept between tasks."""
    if model_path not in _CODECS:
        _CODECS[model_path] = Codec(model_path)
    return _CODECS[model_path]


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """`df` with each text's ids (packed little-endian unsigned 32-bit) and their decoded text.

    One pass over the rows, no shuffle; a worker holds one batch and a bounded
    memory of parts.
    """
    df = spread(df).drop(*({ids_col, decoded_col} - {text_col}))
    at = df.columns.index(text_col)
    schema = StructType([*df.schema.fields, StructField(ids_col, BinaryType()), StructField(decoded_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentencepiece")
        own = codec(model_path)
        out_schema = None
        for batch in batches:
            start, size, ids, back = 0, 0, [], []
            for row, text in enumerate(texts(batch.column(at))):
                a, b = own.encode_decode(text)
                ids.append(a)
                back.append(b)
                size += len(a) + len(b)
                if size > FLUSH_BYTES or row == batch.num_rows - 1:
                    own.check_fresh()
                    columns = [*batch.slice(start, len(ids)).columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary()).cast(pa.string())]
                    out_schema = out_schema or pa.schema([*batch.schema, pa.field(ids_col, pa.binary()), pa.field(decoded_col, pa.string())])
                    yield pa.RecordBatch.from_arrays(columns, schema=out_schema)
                    start, size, ids, back = row + 1, 0, [], []

    return df.mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stonefold.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
