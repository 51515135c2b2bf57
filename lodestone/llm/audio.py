"""Media columns: telephony audio.

A payload is stored as the samples of a mu-law WAV file (one byte a sample, 8,000 Hz): 8-bit companded
codes are kept as they are, so the file is lossless for any bytes (``store``).  ``measure`` reads a stored file back: its codes
are the payload and expand to linear PCM by lookup tables (mu-law and A-law), and the same bytes can be
read as IMA ADPCM blocks, which are decoded by numpy across blocks: one step of the predictor runs over
all blocks at once.  The expanded samples are resampled to any rate and kept as a 16-bit PCM file, which may be packed without loss
(``packed``).  ``measure_pcm`` reads kept files back and measures the resampled samples.

Work is done row by row within Arrow batches and in bounded slices of blocks and samples, so memory does not grow
with a text's length beyond a few copies of that text.  There is no shuffle: media tables are written, read and measured where they lie.

Defined results: a null or an empty text is one block of zero bytes; a very long text is one file; equal payloads give equal files
and features; repeated rows and rows that share an id (null ids too) give a row each; an empty table gives an empty table; other
columns of the input of ``store`` and ``measure`` are not carried over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import slices

BLOCK = 64
RATE = 8000
#: Samples a second of the PCM that is kept, unless another rate is asked for.
PCM_RATE = 16_000
MULAW_TAG, PCM_TAG = 7, 1
#: WAVE_FORMAT_DEVELOPMENT: the tag that is left free for forms without a registered one.
PACKED_TAG = 0xFFFF
#: ADPCM blocks decoded at once: 120 samples of 4 bytes for each.
BLOCKS_AT_ONCE = 8192
#: Samples resampled or summed up at once: some arrays of 8 bytes for each.
SAMPLES_AT_ONCE = 1 << 18

# Fixed values of the IMA ADPCM format: how a code moves the step index.
INDEX_MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]
# Fixed values of the IMA ADPCM format: the step sizes.
STEP_SIZES = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
]


def mulaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 mu-law codes (ITU-T G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - value, value - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 A-law codes (ITU-T G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code & 0x70) >> 4, (code & 0x0F) << 4
    value = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def wav(samples: bytes, tag: int, rate: int, bits: int) -> bytes:
    """A mono WAV file; a companded one has the ``fact`` chunk that the format asks for."""
    width = bits // 8
    chunks = b"fmt " + struct.pack("<IHHIIHHH", 18, tag, 1, rate, rate * width, width, bits, 0)
    if tag != PCM_TAG:
        chunks += b"fact" + struct.pack("<II", 4, len(samples) // width)
    chunks += b"data" + struct.pack("<I", len(samples))
    pad = b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + len(samples) + len(pad)) + b"WAVE" + chunks + samples + pad


def wav_samples(file: bytes) -> tuple[int, bytes]:
    """The format tag and the bytes of the ``data`` chunk."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag = 12, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", file, at + 8)[0]
        elif name == b"data":
            if tag is None:
                raise ValueError("data before its format")
            return tag, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def rate_of(file: bytes) -> int:
    """Samples a second of a file of ``wav``, where the format comes first."""
    return struct.unpack_from("<I", file, 24)[0]


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM (mono): ``blocks`` is blocks x bytes; a block's first sample stands in its header.

    A header's step index over 88 counts as 88."""
    n, width = blocks.shape
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").astype(np.int32)[:, 0]
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEP_SIZES) - 1)
    steps, moves = np.array(STEP_SIZES, np.int32), np.array(INDEX_MOVES, np.int32)
    codes = np.empty((2 * (width - 4), n), np.uint8)
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = value = head
    for k, code in enumerate(codes):
        size = code & 7
        step = steps[index]
        delta = (step >> 3) + (step >> 2) * (size & 1) + (step >> 1) * (size >> 1 & 1) + step * (size >> 2)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + moves[size], 0, len(STEP_SIZES) - 1)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Samples at ``target`` a second of samples at ``source`` a second: on the line between the two neighbours, the last one is held."""
    out = np.empty(-(-len(pcm) * target // source), np.int16)
    for first in range(0, len(out), SAMPLES_AT_ONCE):
        at = np.arange(first, min(first + SAMPLES_AT_ONCE, len(out)), dtype=np.int64) * source
        left, part = at // target, at % target
        before, after = pcm[left].astype(np.int64), pcm[np.minimum(left + 1, len(pcm) - 1)]
        out[first : first + len(at)] = (before * (target - part) + after * part) // target
    return out


def between(even: np.ndarray, n: int) -> np.ndarray:
    """The means, rounded down, of ``n`` samples and the ones after them; the last one's is itself."""
    after = np.append(even[1:], even[-1:])[:n]
    return (even[:n].astype(np.int32) + after >> 1).astype(np.int16)


def packed(file: bytes) -> bytes:
    """A 16-bit PCM file as samples at even places, then differences (modulo 2^16) of the others from the mean of their neighbours.

    Any samples come back (``unpacked``); smooth ones, such as those of a doubled rate, give small differences, which compress well."""
    tag, samples = wav_samples(file)
    if tag != PCM_TAG:
        raise ValueError("not a PCM file")
    pcm = np.frombuffer(samples, "<i2")
    even, odd = pcm[0::2], pcm[1::2]
    return wav(even.tobytes() + (odd - between(even, len(odd))).astype("<i2").tobytes(), PACKED_TAG, rate_of(file), 16)


def unpacked(file: bytes) -> bytes:
    """The 16-bit PCM file of a packed one; a PCM file stays as it is."""
    tag, samples = wav_samples(file)
    if tag == PCM_TAG:
        return file
    if tag != PACKED_TAG:
        raise ValueError("not a PCM file")
    held = np.frombuffer(samples, "<i2")
    even, odd = np.split(held, [-(-len(held) // 2)])
    pcm = np.empty(len(held), "<i2")
    pcm[0::2], pcm[1::2] = even, odd + between(even, len(odd))
    return wav(pcm.tobytes(), PCM_TAG, rate_of(file), 16)


def payload_of(text: str | None, block: int = BLOCK) -> tuple[int, bytes]:
    """The length of the UTF-8 bytes, and those bytes with zeros up to a positive multiple of ``block``."""
    data = (text or "").encode("utf-8")
    size = max(block, -(-len(data) // block) * block)
    return len(data), data.ljust(size, b"\0")


def summary(pcm: np.ndarray) -> str:
    """Samples, mean magnitude and sign changes."""
    loud = turns = 0
    for at in range(0, len(pcm), SAMPLES_AT_ONCE):
        wide = pcm[at : at + SAMPLES_AT_ONCE + 1].astype(np.int64)
        loud += int(np.abs(wide[:SAMPLES_AT_ONCE]).sum())
        turns += int((wide[1:] * wide[:-1] < 0).sum())
    return f"{len(pcm)}:{loud // max(1, len(pcm))}:{turns}"


def adpcm_stats(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block, the sum of the magnitudes and the sign changes of its samples."""
    loud, turns = np.empty(len(blocks), np.int64), np.empty(len(blocks), np.int64)
    for at in range(0, len(blocks), BLOCKS_AT_ONCE):
        part = slice(at, at + BLOCKS_AT_ONCE)
        pcm = decode_adpcm(blocks[part]).T
        loud[part] = np.abs(pcm.astype(np.int32)).sum(axis=0, dtype=np.int64)
        turns[part] = ((pcm[1:] ^ pcm[:-1]) < 0).sum(axis=0)
    return loud, turns


def features(payloads: list[bytes], block: int = BLOCK) -> list[str]:
    """Samples, mean magnitude and sign changes as mu-law, A-law and ADPCM.

    The ADPCM blocks of all payloads are decoded together."""
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, block)
    counts = np.array([len(p) // block for p in payloads])
    starts = np.cumsum(counts) - counts
    loud, turns = (np.add.reduceat(x, starts) for x in adpcm_stats(blocks))
    samples = counts * (2 * (block - 4) + 1)
    out = []
    for k, payload in enumerate(payloads):
        codes = np.frombuffer(payload, np.uint8)
        out.append(f"mulaw={summary(MULAW[codes])};alaw={summary(ALAW[codes])};adpcm={samples[k]}:{loud[k] // samples[k]}:{turns[k]}")
    return out


def _mapped(
    rows: DataFrame, id_col: str, made: dict[str, pa.DataType], work: Callable[[list[list]], Iterator[tuple]], kept: Sequence[str] = ()
) -> DataFrame:
    """The id, the ``kept`` columns and new ones for slices of ``rows``.

    Its first column is the id, its second one holds what a slice is cut by, its last ones are those kept, which ``work`` does not see."""
    named = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    end = len(rows.columns) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                columns = zip(*work([c.to_pylist() for c in part.columns[1:end]]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[end:], *(pa.array(x, t) for x, t in zip(columns, made.values(), strict=True))],
                    names=[id_col, *kept, *made],
                )
            pa.default_memory_pool().release_unused()

    same = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in (id_col, *kept)]
    return rows.mapInArrow(run, ", ".join([*same, *(f"{n} {named[t]}" for n, t in made.items())]))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per document: the id, ``n_bytes`` (of the text), ``media`` (a mu-law WAV file of the payload)."""

    def work(columns: list[list]) -> Iterator[tuple]:
        for text in columns[0]:
            n, payload = payload_of(text, block)
            yield n, wav(payload, MULAW_TAG, RATE, 8)

    return _mapped(docs.select(id_col, text_col), id_col, {"n_bytes": pa.int64(), "media": pa.binary()}, work)


def measure(stored: DataFrame, rate: int = PCM_RATE, id_col: str = "doc_id", block: int = BLOCK, pack: bool = False) -> DataFrame:
    """What is read back from stored files (``n_bytes``, ``media``), a row each.

    Columns: the id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``, ``media_sha256``, ``feature`` and
    ``pcm``, a 16-bit PCM file at ``rate``, with ``pack`` a packed one.  A file of another kind is an error."""
    made = {
        "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pcm": pa.binary(),
    }

    def work(columns: list[list]) -> Iterator[tuple]:
        files, sizes = columns
        read = [wav_samples(file) for file in files]
        if any(tag != MULAW_TAG for tag, _ in read):
            raise ValueError("not a mu-law file")
        payloads = [back for _, back in read]
        for n, back, file, feature in zip(sizes, payloads, files, features(payloads, block), strict=True):
            linear = resample(MULAW[np.frombuffer(back, np.uint8)], RATE, rate)
            pcm = wav(linear.astype("<i2").tobytes(), PCM_TAG, rate, 16)
            yield (
                n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-block:]),
                len(file), hashlib.sha256(file).hexdigest(), feature, packed(pcm) if pack else pcm,
            )

    return _mapped(stored.select(id_col, "media", "n_bytes"), id_col, made, work)


def measure_pcm(measured: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from kept PCM files (``pcm``, packed or not), a row each; the other columns are carried over.

    ``resampled_bytes``, ``resampled_sha256`` and ``resampled_feature`` (samples, mean magnitude, sign changes) are those of the file at the
    rate it was kept at; ``pcm_bytes`` and ``pcm_sha256`` those of its samples brought back to 8,000 Hz (of a doubled rate: every second
    one, so the expanded samples themselves)."""
    made = {
        "pcm_bytes": pa.int64(), "pcm_sha256": pa.string(),
        "resampled_bytes": pa.int64(), "resampled_sha256": pa.string(), "resampled_feature": pa.string(),
    }

    def work(columns: list[list]) -> Iterator[tuple]:
        for held in columns[0]:
            file = unpacked(held)
            pcm = np.frombuffer(wav_samples(file)[1], "<i2")
            narrow = wav(resample(pcm, rate_of(file), RATE).astype("<i2").tobytes(), PCM_TAG, RATE, 16)
            yield len(narrow), hashlib.sha256(narrow).hexdigest(), len(file), hashlib.sha256(file).hexdigest(), summary(pcm)

    kept = [c for c in measured.columns if c not in (id_col, "pcm")]
    return _mapped(measured.select(id_col, "pcm", *kept), id_col, made, work, kept)
