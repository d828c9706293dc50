"""Chunking of documents: fixed windows, packed sentences, packed paragraphs."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("fixed", "sentence", "paragraph")
_SENTENCE, _PARAGRAPH = re.compile(r"(?<=[.!?])\s+"), re.compile(r"\n\s*\n")


@dataclass(frozen=True)
class Chunker:
    """tail: also give the last window when the one before already holds it, as plain stepping does."""

    size: int = 512
    overlap: int = 50
    least: int = 50
    tail: bool = True

    def fixed(self, text: str) -> list[str]:
        """Windows of `size`, cut at the last blank after `least` characters, each `overlap` back from the end of the one before."""
        out, at, n = [], 0, len(text)
        while at < n:
            end = at + self.size
            if end < n and (blank := text.rfind(" ", at + self.least, end)) > at:
                end = blank
            if piece := text[at:end].strip():
                out.append(piece)
            if end >= n and not (self.tail and end - self.overlap < n and end - self.overlap > at):
                break
            at = max(end - self.overlap, at + 1)  # a break close to the start must not stop the walk
        return out

    def sentences(self, text: str) -> list[str]:
        """Sentences packed up to `size`; with an overlap the last sentence is repeated; a longer one falls to fixed()."""
        return self._pack([s for x in _SENTENCE.split(text) if (s := x.strip())], " ", self.fixed, self.overlap > 0)

    def paragraphs(self, text: str) -> list[str]:
        return self._pack([s for x in _PARAGRAPH.split(text) if (s := x.strip())], "\n\n", self.sentences, False)

    def _pack(self, parts: list[str], glue: str, split, repeat: bool) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        used = 0
        for part in parts:
            if len(part) > self.size:
                if held:
                    out.append(glue.join(held))
                held, used = [], 0
                out += split(part)
            elif held and used + len(part) + len(glue) > self.size:
                out.append(glue.join(held))
                held = [held[-1], part] if repeat else [part]
                used = sum(map(len, held)) + (len(glue) if repeat else 0)
            else:
                held.append(part)
                used += len(part) + len(glue)
        return [*out, glue.join(held)] if held else out

    def chunks(self, text: str, strategy: str) -> list[str]:
        return {"fixed": self.fixed, "sentence": self.sentences, "paragraph": self.paragraphs}[strategy](text)


#: Bytes of text that a worker cuts at a time, at least one document.
PIECE = 1 << 20


def _pieces(batch: pa.RecordBatch):
    """The rows of a batch (doc_id, text) in slices of about PIECE bytes of text: a batch may hold 10,000 large pages."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, end - at)
        at = end


def chunk(docs: DataFrame, strategy: str = "sentence", chunker: Chunker | None = None) -> DataFrame:
    """chunk_id, doc_id, chunk_index, total_chunks, chunk_strategy, text. Chunks under `least` go after they are numbered, so numbers have gaps."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    c = chunker or Chunker()

    def run(batches):
        for whole in batches:
            for b in _pieces(whole):
                made = [c.chunks(x.as_py() or "", strategy) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "chunks"])

    own = docs.select("doc_id", "text")
    cut = own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, chunks array<string>")
    rows = cut.select("doc_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "text")).where(F.char_length("text") >= c.least)
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "total_chunks", F.lit(strategy).alias("chunk_strategy"), "text")


def estimate(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """One row: chunks, at least 1."""
    return docs.agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.sum(F.char_length("text")), F.lit(0)) / (size - overlap))).cast("long").alias("chunks"))
