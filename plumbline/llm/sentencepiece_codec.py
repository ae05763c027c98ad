"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text the last token of its encoding is unique. Scanning
the text once with an automaton of all pieces, a piece that ends at position i
and starts at j is that token exactly if it stands alone there (j = 0) or the
pair (last token of prefix j, piece) is compatible, that is, encodes to
itself. Which pairs are compatible depends on the merge scores only and is
remembered. The ids are read off the table backwards. The table's work is
linear in the text, and no agenda of merges is kept.

No piece has a word mark after another character, so no merge crosses the
start of a word; the table is therefore filled word by word, and a worker
remembers, within bounds, the ids of words that it has met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import hold, prepare

MARK = "▁"
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64


class PieceEncoder(dict):
    """Words -> ids joined by commas, for one BPE .model file; also the encoder of texts."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        super().__init__()
        self.library = SentencePieceProcessor(model_file=path)
        proto = model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only BPE models without a character map are read here")
        if proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep white space, with the mark before a word, are read here")
        self.prefix = MARK if proto.normalizer_spec.add_dummy_prefix else ""
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not read here")
        self.score = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.piece = {i: p for p, (_, i) in self.score.items()}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece crosses the start of a word")
        self.size = len(proto.pieces)
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.score.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.score))
        # A character of no piece stands alone, so it ends a word as well.
        self.words = re.compile(f"[{apart}]|{MARK}*[^{MARK}{apart}]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merges(self, text: str) -> list[str]:
        """The pieces of a short text by the merges themselves: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score[m][0], -k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        if (known := self.pairs.get(key)) is None:
            a, b = self.piece[left], self.piece[right]
            known = self.pairs[key] = self.merges(a + b) == [a, b]
        return known

    def stands(self, token: int) -> bool:
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = self.merges(self.piece[token]) == [self.piece[token]]
        return known

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word (or of any text without a word start inside)."""
        n = len(word)
        # last[i]: the last token of the prefix of i characters; -1: a character of no piece.
        last, length = [None] * (n + 1), [1] * (n + 1)
        at = 0
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            while at < end - 1:  # nothing ended at these: characters of no piece
                at += 1
                if last[at] is None:
                    last[at] = -1
            at = end - 1
            if last[end] is not None:
                continue
            before = last[end - size] if end > size else -1
            if before is None:
                continue
            if self.stands(token) if before == -1 else self.compatible(before, token):
                last[end], length[end] = token, size
        for i in range(1, n + 1):
            if last[i] is None:
                last[i] = -1
        ids, i = [], n
        while i:
            if last[i] >= 0:
                ids.append(last[i])
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(word[i - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown)
            i -= length[i]
        return ids[::-1]

    def __missing__(self, word: str) -> str:
        code = ",".join(map(str, self.word_ids(word)))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = code
        return code

    def code(self, text: str) -> str:
        """All ids of a text, decimal, joined by commas."""
        if not text:
            return ""
        if self.prefix and text[0] != " " and "  " not in text and MARK not in text:
            return ",".join(map(self.__getitem__, (MARK + text.replace(" ", f" {MARK}")).split(" ")))  # each word has its mark
        return ",".join(map(self.__getitem__, self.words(self.prefix + text.replace(" ", MARK))))

    def encode(self, text: str) -> list[int]:
        code = self.code(text)
        return list(map(int, code.split(","))) if code else []

    def count(self, text: str) -> int:
        code = self.code(text)
        return code.count(",") + 1 if code else 0

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder for ``path``, made once while no other operator's caches take its place."""
    hold("pieces", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, path: str, text: str = "text", ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """``docs`` with the ids of each whole text under a sentencepiece BPE model.

    Adds ``n_tokens`` and, as asked, ``ids`` (array<int>), ``decoded`` (the
    library's decoding of these ids) and the digests ``ids_sha256`` (decimal
    ids joined by commas) and ``decoded_sha256``. A null text counts as empty:
    no ids, decoded empty. Rows are independent: repeated rows stay, other
    columns pass through, a column named like an added one is replaced.
    One map over the rows; nothing is shuffled.
    """
    prepare(docs.sparkSession)
    added = [("n_tokens", "long")]
    added += [("ids", "array<int>")] * ids + [("decoded", "string")] * decoded
    added += [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests
    names = [n for n, _ in added]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    schema = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL(", ".join(map(" ".join, added))).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for value in batch.column(batch.num_columns - 1):
                code = bpe.code(value.as_py() or "")
                own = list(map(int, code.split(","))) if code and (ids or decoded or digests) else []
                out["n_tokens"].append(code.count(",") + 1 if code else 0)
                if ids:
                    out["ids"].append(own)
                if decoded or digests:
                    plain = bpe.decode(own)
                    if decoded:
                        out["decoded"].append(plain)
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(code.encode()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(out[n], kinds.get(n, pa.string())) for n in names)], names=[*batch.schema.names[:-1], *names])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the library's decoding of the column ``ids``; null ids decode to the empty text."""
    prepare(encoded.sparkSession)
    kept = [F.col(f"`{c}`") for c in encoded.columns if c != out]
    schema = encoded.select(*kept).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            plain = pa.array((bpe.decode(v.as_py() or []) for v in batch.column(batch.num_columns - 1)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], plain], names=[*batch.schema.names[:-1], out])

    return encoded.select(*kept, F.col(ids).alias("__ids")).mapInArrow(run, schema)
