"""Quality rules by compression bands.

A text is kept when it passes two base rules (enough words, few repeated five-word windows) and
when its zstandard ratio, compressed bytes over bytes, lies inside the band for its length, both
for the whole document and for every fixed-size chunk of it. A ratio under the band means a
repetitive text, one over it means text that does not compress (keys, encoded bytes, noise).

Nulls, empty texts and short texts: a NULL text counts as empty, has no words and fails the base
rule. Texts shorter than the least length of the bands have no reliable ratio and are judged by
the base rules alone. Repeated rows are judged alike, row by row; no row is dropped here. Other
columns pass through, except those that carry the names of the verdict columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.columns import others
from textguard.llm.words import numbered, row_of_word, slices, windows_in_rows, words_of


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of at least ``least`` bytes."""

    least: int
    low: float
    high: float


#: Longer texts compress better, so that both limits fall with length.
DOCUMENT_BANDS = (
    Band(200, 0.25, 0.90),
    Band(1_000, 0.18, 0.74),
    Band(4_000, 0.14, 0.68),
    Band(16_000, 0.10, 0.62),
    Band(64_000, 0.06, 0.60),
)
CHUNK_BYTES = 4_096
#: Chunks are cut at fixed bytes; a last chunk under half the size joins the one before it.
CHUNK_BANDS = (Band(1_000, 0.10, 0.74), Band(CHUNK_BYTES // 2, 0.08, 0.70))

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"

_FIELDS = (
    ("n_words", "bigint", pa.int64()),
    ("n_dup_lines", "bigint", pa.int64()),
    ("n_repeat_words", "bigint", pa.int64()),
    ("document_ratio", "double", pa.float64()),
    ("least_chunk_ratio", "double", pa.float64()),
    ("most_chunk_ratio", "double", pa.float64()),
    ("in_bands", "boolean", pa.bool_()),
)
VERDICT_COLUMNS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words document_ratio "
    "least_chunk_ratio most_chunk_ratio base_failed kept"
).split()


def band_of(size: int, bands: tuple[Band, ...]) -> Band | None:
    fitting = [band for band in bands if size >= band.least]
    return max(fitting, key=lambda band: band.least) if fitting else None


def _inside(size: int, ratio: float, bands: tuple[Band, ...]) -> bool:
    band = band_of(size, bands)
    return band is None or band.low <= ratio <= band.high


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    ends = list(range(size, len(data), size)) + [len(data)]
    if len(ends) > 1 and ends[-1] - ends[-2] < size // 2:
        del ends[-2]
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def compression(data: bytes, squeeze) -> tuple[float, float, float, bool]:
    """``(document ratio, least and most chunk ratio, inside all bands)``; 1.0 for no bytes."""
    if not data:
        return 1.0, 1.0, 1.0, True
    whole = len(squeeze(data)) / len(data)
    if len(data) < CHUNK_BANDS[0].least:
        return whole, whole, whole, _inside(len(data), whole, DOCUMENT_BANDS)
    parts = chunks(data)
    ratios = [len(squeeze(part)) / len(part) for part in parts] if len(parts) > 1 else [whole]
    fine = _inside(len(data), whole, DOCUMENT_BANDS) and all(
        _inside(len(part), ratio, CHUNK_BANDS) for part, ratio in zip(parts, ratios, strict=True)
    )
    return whole, min(ratios), max(ratios), fine


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row, the words inside five-word windows that the row holds twice or more.

    Windows get exact names: five words by their two overlapping triples and the row.
    """
    rows = row_of_word(bounds)
    starts = windows_in_rows(bounds, WINDOW)
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(starts):
        three = _named(ids[:-2], ids[1:-1], ids[2:])
        own = _named(rows[starts], three[starts], three[starts + 2])
        again = starts[np.bincount(own)[own] > 1]
        covered += np.bincount(again, minlength=len(covered))
        covered -= np.bincount(again + WINDOW, minlength=len(covered))
    inside = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
    return np.bincount(rows, weights=inside, minlength=len(bounds) - 1).astype(np.int64)


def _named(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers for the distinct tuples of non-negative columns."""
    key, size = columns[0], int(columns[0].max()) + 1
    for column in columns[1:]:
        width = int(column.max()) + 1
        if size * width >= 1 << 62:
            key = _dense(key)
            size = int(key.max()) + 1
        key, size = key * np.int64(width) + column, size * width
    return _dense(key)


def _dense(keys: np.ndarray) -> np.ndarray:
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for part in slices(batches, "_text"):
        texts = part.column("_text").fill_null("")
        flat, bounds = words_of(texts)
        ids, _ = numbered(flat)
        ratios = [compression(text, squeeze) for text in texts.cast(pa.binary()).to_pylist()]
        found = {
            "n_words": np.diff(bounds),
            "n_dup_lines": [repeated_lines(text) for text in texts.to_pylist()],
            "n_repeat_words": repeated_words(ids, bounds),
            "document_ratio": [r[0] for r in ratios],
            "least_chunk_ratio": [r[1] for r in ratios],
            "most_chunk_ratio": [r[2] for r in ratios],
            "in_bands": [r[3] for r in ratios],
        }
        measured = pa.StructArray.from_arrays(
            [pa.array(found[name], kind) for name, _, kind in _FIELDS],
            [name for name, _, _ in _FIELDS],
        )
        columns = [measured if n == "_measured" else part.column(n) for n in _names_out(part)]
        yield pa.RecordBatch.from_arrays(columns, _names_out(part))


def _names_out(part: pa.RecordBatch) -> list[str]:
    return [*(n for n in part.schema.names if n != "_text"), "_measured"]


def judge(documents: DataFrame, text: str = "text") -> DataFrame:
    """Each row with its counts, ratios, ``base_failed`` and ``kept``."""
    rows = documents.select(
        F.struct(*others(documents, *VERDICT_COLUMNS)).alias("_row"),
        F.col(text).alias("_text"),
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")).cast("bigint").alias("_chars"),
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{SYMBOLS}]", "")).cast("bigint").alias("_symbols"),
    )
    measured = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind, _ in _FIELDS))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_text"]).add("_measured", measured)
    out = rows.mapInArrow(_measure, schema)
    m = lambda name: F.col(f"_measured.{name}")
    failed = (m("n_words") < LEAST_WORDS) | (
        100 * m("n_repeat_words") > MOST_REPEATED_PERCENT * m("n_words")
    )
    return out.select(
        "_row.*",
        m("n_words").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        *(m(n).alias(n) for n in ("n_dup_lines", "n_repeat_words", "document_ratio", "least_chunk_ratio", "most_chunk_ratio")),
        failed.alias("base_failed"),
        (~failed & m("in_bands")).alias("kept"),
    )


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    renamed = documents.select(F.struct("*").alias("_whole"), F.col("text").alias("text"))
    return judge(renamed).where("kept").select("_whole.*")
