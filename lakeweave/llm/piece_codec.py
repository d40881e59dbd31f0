"""Encoding and decoding with a SentencePiece vocabulary of the merge type: a score-ordered agenda of adjacent pairs."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column
from lakeweave.llm.words import slices, split_words, sums_by_span

SPACE = "▁"
#: Runs of letters, digits one by one, and runs of other signs, each with the spaces before it.
UNIT = re.compile(rf"[ {SPACE}]*(?:[^\W\d_²³¹¼½¾]+|(?:[^\w {SPACE}]|[_²³¹¼½¾])+)|[ {SPACE}]*\d|[ {SPACE}]+")
MOST_KEPT = 400_000


class PieceCodec:
    """Encodes and decodes as the model file says, without begin or end ids.

    Texts are cut at places that no piece of the vocabulary spans (checked when the model is
    read), so each distinct unit goes through the agenda once per worker; each new unit's ids
    are compared with those of the sentencepiece library.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with identity normalisation, dummy prefix and byte fallback is needed")
        self.pieces = [p.piece for p in proto.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.said = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte_id.items():
            self.said[i] = bytes([b])
        pairs = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.units_hold = all(UNIT.findall(p) == [p] for p in pairs)
        self.lead = [self.id_of[SPACE], self.byte_id[10]]
        self.units: dict[str, tuple[int, str, str]] = {}
        self.differed = 0

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit. The agenda holds adjacent symbols that join to a piece; best score, then leftmost, goes first."""
        symbols = list(unit.replace(" ", SPACE))
        n, score = len(symbols), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-s, i, 2, p) for i in range(n - 1) if (s := score.get(p := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, _, joined = heapq.heappop(agenda)
            if (j := after[i]) >= n or symbols[i] is None or symbols[i] + symbols[j] != joined:
                continue  # one of the two has changed since
            symbols[i], symbols[j] = joined, None
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (s := score.get(p := joined + symbols[j])) is not None:
                    heapq.heappush(agenda, (-s, i, len(p), p))
            if (h := before[i]) >= 0 and (s := score.get(p := symbols[h] + joined)) is not None:
                heapq.heappush(agenda, (-s, h, len(p), p))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                i = self.id_of.get(s)
                ids.extend([i] if i is not None else [self.byte_id[b] for b in s.encode()])
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that form no character become U+FFFD. The dummy prefix, the first space, goes."""
        return b"".join(map(self.said.__getitem__, ids)).decode(errors="replace").removeprefix(" ")

    def learn(self, units: list[str]) -> None:
        """Encode units not met before and check them against the library, whose ids hold where they differ (``differed`` counts these)."""
        ids = [self.merge(u) for u in units]
        theirs = self.library.encode(["\n" + u for u in units], num_threads=1)
        for u, own, other in zip(units, ids, theirs, strict=True):
            if self.lead + own != other:
                self.differed += 1
                own = other[len(self.lead) :]
            self.units[u] = (len(own), ",".join(map(str, own)), self.decode([*self.lead, *own])[1:])

    def parts(self, text: str) -> list[str]:
        return UNIT.findall(text) if self.units_hold else [text] * bool(text)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of each text: number of ids, decimal ids joined by commas, decoded text."""
        texts = pc.fill_null(texts, "")
        full = pc.greater(pc.binary_length(texts), 0)
        led = pc.if_else(full, pc.binary_join_element_wise("", texts, " "), texts)
        if len(self.units) > MOST_KEPT:
            self.units.clear()
        # words that begin at a single space meet nothing on their left; elsewhere a text is cut as a whole
        plain = self.units_hold and not pc.any(pc.match_substring(led, "  ")).as_py() and not pc.any(pc.match_substring(led, SPACE)).as_py()
        if not plain and len(texts) > 1:
            odd = pc.fill_null(pc.or_(pc.match_substring(led, "  "), pc.match_substring(led, SPACE)), False).to_numpy(zero_copy_only=False) if self.units_hold else np.ones(len(texts), bool)
            if not odd.all():
                return self._stitched(texts, odd)
        if plain:
            w = split_words(texts, " ")  # each word stands for a space and itself; the first one's is the dummy prefix
            cut = [self.parts(" " + x) for x in w.distinct]
        else:
            w = None
            cut = [self.parts(x) for x in led.to_pylist()]
        new = list({u: None for parts in cut for u in parts if u not in self.units})
        if new:
            self.learn(new)
        units = self.units
        count = np.array([sum(units[u][0] for u in parts) for parts in cut], np.int64)
        ids = pa.array([",".join([units[u][1] for u in parts]) for parts in cut], pa.string())
        back = pa.array(["".join([units[u][2] for u in parts]) for parts in cut], pa.string())
        if w is None:
            return count, ids, pa.array([x.as_py().removeprefix(" ") for x in back], pa.string())
        codes, offsets = pa.array(w.codes), pa.array(np.concatenate([[0], w.ends]).astype("int32"))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, ids.take(codes)), ",")
        spoken = pc.binary_join(pa.ListArray.from_arrays(offsets, back.take(codes)), "")
        n = sums_by_span(count[w.codes], w.ends)
        keep = full.to_numpy(zero_copy_only=False)
        return np.where(keep, n, 0), pc.if_else(full, joined, ""), pc.utf8_slice_codeunits(spoken, 1)

    def _stitched(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        a, b = self.encoded(texts.filter(pa.array(~odd))), self.encoded(texts.filter(pa.array(odd)))
        order = pa.array(np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), kind="stable"))
        return np.concatenate([a[0], b[0]])[order], pa.concat_arrays([a[1], b[1]]).take(order), pa.concat_arrays([a[2], b[2]]).take(order)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _digests(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(memoryview(x.as_buffer()) if x.as_buffer() is not None else b"").hexdigest() for x in texts.cast(pa.binary())]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (the decimal ids joined by commas), decoded text and n_tokens of every whole text.

    Null text counts as empty and has no ids. Any other text keeps all its characters, those
    outside the vocabulary as bytes. Repeated rows give repeated results; an empty table gives
    none; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, ids, back = codec(model_path).encoded(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), ids, back], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def encoding_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; as ``encode_documents``, hashed where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, ids, back = codec(model_path).encoded(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(_digests(ids)), pa.array(_digests(back))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
