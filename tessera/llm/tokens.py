"""Encoding of whole texts by a public byte-level BPE vocabulary, on the tokenization automaton."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.automaton import MergeAutomaton
from tessera.llm.presplit import code_points, word_starts
from tessera.llm.tables import read

VOCABULARY = "byte_bpe_50k.json"
#: Distinct words that a worker remembers before it starts afresh, and characters it splits at once.
CACHE_WORDS, CHUNK = 400_000, 2_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed vocabulary files are; pass another path to the operators to use other files."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / name)


class Encoder(dict):
    """Word (str) to the bytes of its int32 ids; words not seen before go through the automaton."""

    def __init__(self, vocabulary: bytes, name: str) -> None:
        super().__init__()
        self.automaton = (MergeAutomaton.from_merges if name.endswith(".json") else MergeAutomaton.from_ranks)(vocabulary)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode(word.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
                self.automaton.forget()
            self[word] = ids
        return ids

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 bytes; null and empty texts give none."""
        out: list[bytes] = []
        batch: list[str] = []
        size = 0
        for text in texts:
            batch.append(text or "")
            size += len(batch[-1])
            if size >= CHUNK:
                out += self._encode(batch)
                batch, size = [], 0
        return out + self._encode(batch) if batch else out

    def _encode(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        begins = np.r_[0, ends[:-1]]
        starts = word_starts(code_points(joined), begins[begins < ends])
        first = np.searchsorted(starts, begins).tolist() + [len(starts)]
        cuts = [*starts.tolist(), len(joined)]
        ids = [self[joined[a:b]] for a, b in zip(cuts, cuts[1:])]
        return [b"".join(ids[a:b]) for a, b in zip(first, first[1:])]


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(vocabulary, name: str) -> Encoder:
    """The encoder of this Python worker; built once, kept while the worker lives."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary.value, name)
    return _ENCODERS[name]


def _shared(spark: SparkSession, path: str):
    # a vocabulary file has a fixed size (1.6 MB), whatever the data
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode_texts(docs: DataFrame, ident: str, text: str, path: str | None = None) -> DataFrame:
    """(ident, ids ARRAY<INT>): token ids of each text, special tokens' names being ordinary text.

    One narrow stage, no shuffle. An empty text and a null text give an empty list; repeated rows stay repeated; other
    columns are not looked at; texts of any length are encoded whole, in time linear in their length.
    """
    path = path or vocabulary_path()
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, path)
        for batch in batches:
            found = encoder.encode_many(batch.column(1).to_pylist())
            offsets = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [ident, "ids"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, ident: str, text: str, path: str | None = None) -> DataFrame:
    """(ident, n_tokens BIGINT): as encode_texts, the number of tokens only."""
    path = path or vocabulary_path()
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, path)
        for batch in batches:
            found = encoder.encode_many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in found], pa.int64())], [ident, "n_tokens"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, n_tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"), "doc_id", "text")
