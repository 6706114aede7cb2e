"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from courtside.llm.common import map_batches

#: Distinct chunks of text that a task remembers with their ids; then it starts anew.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is a visible
    Latin-1 character, else one from U+0100 on, in byte order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class ByteBPE:
    """Encodes texts by a rank file (base64 token and rank per line).

    The text is cut by ``pattern``; each piece is a whole token or is merged pair by pair,
    lowest rank first. Merges are recovered from the ranks: a token's merge is the pair
    that its own bytes come down to under the lower ranks. Decoding reverses the byte
    table; a character split over tokens comes together again in the bytes.
    """

    def __init__(self, ranks: bytes | tuple[dict, list], pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        vocabulary, merges = ranks if isinstance(ranks, tuple) else self.tables(ranks)
        self.char_of = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.char_of)}
        # Nothing is cut or normalised by the library: it gets pieces in visible characters.
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True, cache_capacity=0))
        #: The bytes of each id: its visible characters through the reversed byte table.
        self.token_bytes = {number: self.from_visible(token) for token, number in vocabulary.items()}
        self.find = regex.compile(pattern).findall
        self.pattern = regex.compile(pattern)
        # A space after a character that is no space always starts a new piece, and what
        # follows does not depend on what came before: such chunks can be encoded alone.
        self.uneven = re.compile(r"\s ")
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def tables(cls, ranks: bytes) -> tuple[dict[str, int], list[tuple[str, str]]]:
        """Vocabulary and merges in visible characters. Costs seconds: done once on the driver
        and sent to the tasks; its size is that of the rank file, a few MB."""
        pairs = (line.split() for line in ranks.splitlines() if line)
        rank = {base64.b64decode(token): int(number) for token, number in pairs}
        char_of = byte_characters()
        visible = {token: "".join(map(char_of.__getitem__, token)) for token in rank}
        merges = []
        for token, number in sorted(rank.items(), key=lambda x: x[1]):
            parts = cls._parts(token, number, rank) if len(token) > 1 else ()
            if len(parts) == 2:
                merges.append((visible[parts[0]], visible[parts[1]]))
        return {visible[token]: number for token, number in rank.items()}, merges

    def visible(self, raw: bytes) -> str:
        return "".join(map(self.char_of.__getitem__, raw))

    def from_visible(self, visible: str) -> bytes:
        return bytes(map(self.byte_of.__getitem__, visible))

    @staticmethod
    def _parts(token: bytes, number: int, rank: dict[bytes, int]) -> list[bytes]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(rank.get(a + b, number), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            lowest, i = min(found)
            if lowest >= number:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _chunks(self, text: str) -> list[str]:
        if self.uneven.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def _learn(self, chunks: Iterable[str]) -> None:
        new = list(dict.fromkeys(c for c in chunks if c not in self.known))
        if not new:
            return
        pieces, owner = [], []
        for i, chunk in enumerate(new):
            found = self.find(chunk)
            pieces += found
            owner += [i] * len(found)
        mapped = [self.visible(p.encode("utf-8", "surrogatepass")) for p in pieces]
        encoded = self.tokenizer.encode(mapped, is_pretokenized=True, add_special_tokens=False)
        ids: list[list[int]] = [[] for _ in new]
        for number, word in zip(encoded.ids, encoded.word_ids):
            ids[owner[word]].append(number)
        self.known.update(zip(new, map(tuple, ids)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; an empty text has none."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out, waiting, size = [], [], 0
        for text in chain(texts, [None]):
            if text is not None:
                waiting.append(self._chunks(text))
                size += len(text)
            if size > 1 << 20 or text is None:
                self._learn(chain.from_iterable(waiting))
                known = self.known.__getitem__
                out += [list(chain.from_iterable(map(known, chunks))) for chunks in waiting]
                waiting, size = [], 0
                if len(self.known) > REMEMBERED:
                    self.known.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids. Bytes, as a cut may fall inside a character."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def characters(self, ids: list[int]) -> str:
        """The ids as the library writes them: one visible character per byte."""
        return "".join(map(self.tokenizer.id_to_token, ids))

    def from_characters(self, visible: str) -> bytes:
        """The reverse of the byte table."""
        return self.from_visible(visible)

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """For each id the code points it touches, end exclusive. Ids that share a split
        character all cover it."""
        out, at, start = [], 0, []
        for i, c in enumerate(text):
            start += [i] * len(c.encode("utf-8", "surrogatepass"))
        for number in ids:
            end = at + len(self.token_bytes[number])
            out.append((start[at], start[end - 1] + 1))
            at = end
        return out


def encode(docs: DataFrame, ranks: bytes, pattern: str, with_offsets: bool = False, with_decoded: bool = False,
           text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) and, if asked, ``offsets`` (array of start and end in code
    points) and ``decoded`` (the bytes that the ids give back, in the same pass) to each row.
    A null text is empty and has no ids; rows keep their number and other columns; input
    columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteBPE.tables(ranks))
    at = docs.columns.index(text)
    pair = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("offsets", T.ArrayType(pair))] if with_offsets else []
    fields += [T.StructField("decoded", T.BinaryType())] if with_decoded else []

    def work():
        codec = ByteBPE(shared.value, pattern)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            numbers, ends, spans, decoded = [np.empty(0, np.int32)], [0], [], []
            for start in range(0, batch.num_rows, 128):  # few at a time: lists of numbers are large
                texts = [x or "" for x in batch.column(at).slice(start, 128).to_pylist()]
                for value, ids in zip(texts, codec.encode(texts)):
                    numbers.append(np.array(ids, np.int32))
                    ends.append(ends[-1] + len(ids))
                    if with_offsets:
                        spans.append([{"start": a, "end": b} for a, b in codec.offsets(value, ids)])
                    if with_decoded:
                        decoded.append(codec.decode(ids))
            arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(numbers)))]
            arrays += [pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))] if with_offsets else []
            return arrays + ([pa.array(decoded, pa.binary())] if with_decoded else [])

        return compute

    return map_batches(docs, work, fields)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``; null ids give empty bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ByteBPE.tables(ranks))
    at = encoded.columns.index(ids)

    def work():
        codec = ByteBPE(shared.value, pattern)
        return lambda batch: [pa.array([codec.decode(x or []) for x in batch.column(at).to_pylist()], pa.binary())]

    return map_batches(encoded, work, [T.StructField("decoded", T.BinaryType())])


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Encoding and decoding in one pass: adds ``n_tokens``, ``ids_sha256`` (of the decimal
    ids joined by commas) and ``decoded_sha256`` (of the decoded bytes)."""
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(ByteBPE.tables(ranks))
    at = docs.columns.index(text)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]

    def work():
        codec = ByteBPE(shared.value, pattern)
        decimal = {number: str(number) for number in codec.token_bytes}.__getitem__
        digest = lambda raw: hashlib.sha256(raw).hexdigest()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, of_ids, of_bytes = [], [], []
            texts = [x or "" for x in batch.column(at).to_pylist()]
            for start in range(0, len(texts), 256):
                for ids in codec.encode(texts[start : start + 256]):
                    counts.append(len(ids))
                    of_ids.append(digest(",".join(map(decimal, ids)).encode()))
                    of_bytes.append(digest(codec.decode(ids)))
            return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

        return compute

    return map_batches(docs, work, fields)
