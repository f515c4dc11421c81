"""Quality rules with compression bands.

The ratio of raw to zstandard-compressed bytes tells repetitive text (high) and
incompressible text (low) from prose. It depends on length, so the limits are
given per length band. The ratio is taken over the whole text and over fixed
chunks of it, the last one moved back to end with the text, so that one
repetitive stretch inside a long text is seen too: one bad chunk rejects, and a
stretch of two chunks holds a whole one wherever it lies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, sliced

LEVEL = 3
CHUNK_BYTES = 4096
#: (bytes up to, least ratio, most ratio); the last band has no upper length.
BANDS = ((256, 0.5, 3.0), (512, 1.1, 3.5), (1024, 1.2, 4.0), (2048, 1.4, 5.0), (4096, 1.5, 6.0), (16384, 1.6, 8.0), (None, 1.7, 10.0))
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def band(size: int) -> tuple[float, float]:
    for top, low, high in BANDS:
        if top is None or size <= top:
            return low, high
    raise AssertionError


def ratios(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """(ratio of the whole, chunks, chunks outside their band); an empty text has ratio 1."""
    if not text:
        return 1.0, 0, 0
    whole = len(text) / len(packer.compress(text))
    chunks = bad = 0
    for start in range(0, len(text), CHUNK_BYTES):
        chunk = text[max(0, min(start, len(text) - CHUNK_BYTES)) :][:CHUNK_BYTES]
        low, high = band(len(chunk))
        chunks += 1
        bad += not low <= len(chunk) / len(packer.compress(chunk)) <= high
    return whole, chunks, bad


def in_bands(size: int, whole: float, bad: int) -> bool:
    low, high = band(size)
    return not size or (low <= whole <= high and not bad)


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.split(None, 1)] if b"\n" in text else []
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = {w for w, c in Counter(windows).items() if c > 1}
            reach = 0
            for i, w in enumerate(windows):
                if w in often:
                    repeat += i + 3 - max(i, reach)
                    reach = i + 3
    return n, chars, symbols, dup, repeat


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, then ``ratio``, ``chunks``, ``bad_chunks``.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated 3-word windows. ``kept`` is false then, else the bands' verdict.
    Null and empty text fail the base; texts of any length are judged whole. Null
    ids stay null; repeated rows give repeated results; an empty table gives an
    empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in sliced(batches, "text"):
            rows = []
            for text in as_bytes(batch, "text"):
                n, chars, symbols, dup, repeat = counts(text)
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                whole, chunks, bad = ratios(text, packer)
                rows.append((n, chars, symbols, dup, repeat, failed, not failed and in_bands(len(text), whole, bad), whole, chunks, bad))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks long, bad_chunks long"
    names = ["id", *(x.split()[0] for x in out.split(", "))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {out}").withColumnRenamed("id", id_col)
