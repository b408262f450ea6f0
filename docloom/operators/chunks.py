"""Blocks packed into chunks of about the same size, section by section."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.ship import ship

TARGET, OVERLAP = 420, 60
SCHEMA = "doc_id string, chunk_no int, chunk_id string, page int, section string, text string, block_ids array<string>, tokens int"
ARROW = pa.schema([("doc_id", pa.string()), ("chunk_no", pa.int32()), ("chunk_id", pa.string()), ("page", pa.int32()), ("section", pa.string()), ("text", pa.string()), ("block_ids", pa.list_(pa.string())), ("tokens", pa.int32())])
BLOCK = ["block_ord", "block_id", "page_no", "kind", "section", "text"]
#: Chunks that are sent at once.
BATCH = 1000
_WORD = re.compile(r"\w+")


def tokens(text: str) -> int:
    return estimate(words(text))


def words(text: str) -> int:
    return len(_WORD.findall(text))


def estimate(n_words: int) -> int:
    return int(1.3 * n_words)


def pack(blocks: list[tuple], target: int = TARGET, overlap: int = OVERLAP, longest: int | None = None) -> list[dict]:
    """Chunks of one document's blocks (block_id, page, kind, section, text), in their order.

    A heading starts a chunk and sets the section. After each chunk, the next
    begins with the last blocks of the one before, as many as make `overlap`
    tokens, be it all of them. A block over one and a half targets is a chunk of
    its own, after what was held; longest, if given, cuts its text to so many
    characters. What is held at the end is the last chunk.
    """
    out: list[dict] = []
    held: list[tuple] = []  # (block, words)
    total, section = 0, None

    def emit(rows: list[tuple], text: str, size: int) -> None:
        out.append({"page": rows[0][1], "section": section, "text": text, "block_ids": [r[0] for r in rows], "tokens": size})

    def flush() -> None:
        nonlocal held, total
        if not held:
            return
        # Blocks are joined by line ends, so no word spans two of them.
        emit([r for r, _ in held], "\n".join(r[4] for r, _ in held), estimate(sum(n for _, n in held)))
        first, total = len(held), 0
        while first and total < overlap:
            first -= 1
            total += estimate(held[first][1])
        held = held[first:]

    for row in blocks:
        text = row[4] or ""
        bare = text.strip()
        if not bare:
            continue
        n = words(text)
        size = estimate(n)
        if row[2] == "heading":
            flush()
        section = row[3] or (bare if row[2] == "heading" else section)
        if size > 1.5 * target:
            flush()
            emit([row], text if longest is None else text[:longest], size)
            continue
        if total + size > target:
            flush()
        held.append((row, n))
        total += size
    flush()
    return out


def chunk(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """R1 for blocks (doc_id, block_ord, block_id, page_no, kind, section, text).

    A document is one group, as it is one file. Blocks without text are in no
    chunk; a document without any has no rows.
    """
    return chunk_rows(blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*BLOCK))).alias("blocks")), target, overlap)


def chunk_rows(documents: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """R1 for documents (doc_id, blocks) that hold their blocks, structs of BLOCK, in order. Nothing is shuffled."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids, ends = batch.column(0).to_pylist(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            flat = pc.list_flatten(lists)
            rows = list(zip(*[flat.field(BLOCK.index(c)).to_pylist() for c in ("block_id", "page_no", "kind", "section", "text")], strict=True))
            found: list[dict] = []
            for i, doc in enumerate(ids):
                own = pack(rows[ends[i] : ends[i + 1]], target, overlap)
                found += [{"doc_id": str(doc), "chunk_no": n + 1, "chunk_id": f"{doc}::c{n + 1}", **c} for n, c in enumerate(own)]
                if len(found) >= BATCH:
                    yield pa.RecordBatch.from_pylist(found, schema=ARROW)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=ARROW)

    return documents.select("doc_id", "blocks").mapInArrow(run, SCHEMA)
