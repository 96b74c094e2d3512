"""Quality rules with compression bands.

A text that zstandard shrinks too well repeats itself; one that it hardly
shrinks is noise. What is usual depends on the length, so the limits do too.

Measured upper ends, level 3: prose of four invented languages, Markdown and
manuals 0.90 at 257 to 384 bytes, 0.82 at 512, 0.78 at 768, 0.69 at 1,024, 0.66
at 2,048, 0.60 at 4,096 and 0.54 beyond; base64 noise with a space after every
seven letters, at the same lengths, 0.85, 0.82, 0.78, 0.77, 0.75, 0.74 and 0.73.
Up to 256 bytes prose and noise overlap, so there only stored texts are out.
Noise of few letters (hex, a to z) is at 0.50 to 0.62, as dense prose is; from
4,096 bytes on it is told by its bytes' entropy, which it does not get under
(1.007 times and more, prose 0.98 at most). Shorter noise of few letters passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidewatch.llm.common import by_slices

LEVEL = 3
CHUNK_BYTES = 4096
#: (bytes up to, least ratio, most ratio) of compressed to raw bytes; chunks use the band of their own length.
BANDS = ((100, 0.30, 1.60), (256, 0.22, 1.10), (384, 0.16, 0.85), (512, 0.16, 0.81), (768, 0.13, 0.775), (1024, 0.13, 0.75), (2048, 0.10, 0.72), (4096, 0.10, 0.70), (float("inf"), 0.06, 0.68))
#: A text or chunk of at least CHUNK_BYTES is noise unless it shrinks to under this share of its bytes' entropy.
MOST_ENTROPY = 0.995
#: A document is rejected if more than this share of its bytes is in chunks out of band; the last chunk may be short.
BAD_CHUNKS = 0.25
SYMBOLS = "#*$%&|<>"


def band(size: int) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in BANDS if size <= most)


def entropy(raw: bytes) -> float:
    """Entropy of single bytes, as a ratio of compressed to raw bytes."""
    share = np.bincount(np.frombuffer(raw, dtype=np.uint8)) / len(raw)
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum()) / 8


def rating(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, str]:
    """The ratio of a text or chunk, and whether its band holds it."""
    ratio = len(packer.compress(raw)) / len(raw)
    low, high = band(len(raw))
    if ratio < low:
        return ratio, "repetitive"
    noise = ratio > high or len(raw) >= CHUNK_BYTES and ratio >= MOST_ENTROPY * entropy(raw)
    return ratio, "incompressible" if noise else "kept"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    code, base = ids[:n], len(seen)
    for i in range(1, width):  # ranks stay below n, so codes fit in 64 bits
        if code.size and (int(code.max()) + 1) * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + ids[i:n + i]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
    return len(lines) - len(set(lines))


def measure(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    gaps = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    repeat = repeated_words(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    ratio, bad, verdict = None, 0.0, "base"
    if raw:
        ratio, verdict = rating(raw, packer)
        if len(raw) > CHUNK_BYTES:
            parts = [raw[i:i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
            bad = sum(len(c) for c in parts if rating(c, packer)[1] != "kept") / len(raw)
            if verdict == "kept" and bad > BAD_CHUNKS:
                verdict = "chunks"
    if failed:
        verdict = "base"
    return (len(words), len(text) - gaps, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat, failed, verdict == "kept", ratio, bad, verdict)


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
           ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.float64()), ("verdict", pa.string())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double, verdict string"


def compression_bands(docs: DataFrame) -> DataFrame:
    """doc_id, word and line counts, compression ratios and the verdict.

    ``kept`` is false for documents under ten words, for those of whose words
    over a fifth stand in repeated five-word windows, for those whose whole
    ratio leaves the band of their length or is no better than their bytes'
    entropy, and for those with too many bytes in such chunks. Null and empty texts have no words and fail. Repeated rows
    give repeated results. No row depends on another, so nothing is shuffled."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        rows = [measure(t, packer) for t in batch.column("text").to_pylist()]
        cols = list(zip(*rows)) or [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS))], names=["doc_id", *(n for n, _ in _FIELDS)])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(by_slices(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {_DDL}")
