"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV files, decoded to linear samples and resampled.

The companded formats expand through 256-entry tables built from their rules. ADPCM blocks are independent
of each other, so numpy decodes all blocks of a batch together, one sample position at a time, through
tables of the predictor's change and of the next step index.

``store`` keeps a text as a mu-law WAV file: its bytes, filled up with spaces to a multiple of BLOCK bytes,
are the file's 8-bit samples, so nothing is lost. ``read`` parses the stored file, takes the payload from it
and describes it. ``to_pcm`` turns any of these files into a 16-bit PCM file at another rate.

Cases: null text counts as empty and is stored as one block of spaces; equal texts give equal values; a
file that isn't a WAV of a known format gives null; batches are worked on in parts of at most PART_BYTES of text
or media, so the resampled samples, four times as many bytes, are held for one part or one very long row only.
``read`` resamples where it checks, in one Python worker, so PCM isn't sent to another one. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm.common import quoted, unused

BLOCK = 192
FILL = b" "
RATE = 8000
PCM_RATE = 16000
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
GROUP_BLOCKS = 1 << 14
#: Bytes of texts or media that are worked on at once.
PART_BYTES = 1 << 20
#: Zero crossings of the resampling filter on each side, and output samples that are made at once.
TAPS, CHUNK = 16, 4096

#: The step sizes of IMA ADPCM, and how each code's size moves the step index.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype("<i2")


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    high, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(high == 0, low + 8, (low + 264) << np.maximum(high - 1, 0))
    return np.where(code & 128, size, -size).astype("<i2")


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + code: the predictor's change, and the next step index * 16."""
    step, code = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    following = np.clip(np.arange(len(STEPS))[:, None] + np.array(MOVES)[code & 7], 0, len(STEPS) - 1) * 16
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), following.astype(np.int32).ravel()


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()
CHANGE, FOLLOWING = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks, 2 * (size - 4) + 1) of mono IMA ADPCM blocks (blocks, size)."""
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), dtype="<i2")
    out[0] = predictor
    for k, pair in enumerate(codes):
        for half, code in enumerate((pair & 15, pair >> 4)):
            at = index + code
            predictor = np.clip(predictor + CHANGE[at], -32768, 32767)
            index = FOLLOWING[at]
            out[1 + 2 * k + half] = predictor
    return out.T


def encode_adpcm(samples: np.ndarray, size: int = BLOCK) -> bytes:
    """Mono IMA ADPCM blocks of 16-bit samples; the last block is filled up with the last sample."""
    each = 2 * (size - 4) + 1
    samples = np.asarray(samples, dtype=np.int32)
    if not len(samples):
        return b""
    rows = np.concatenate([samples, np.full(-len(samples) % each, samples[-1])]).reshape(-1, each)
    start = np.minimum(np.searchsorted(STEPS, np.abs(rows[:, 1] - rows[:, 0])), len(STEPS) - 1)
    predictor, index = rows[:, 0].copy(), (start * 16).astype(np.int32)
    codes = np.empty((each - 1, len(rows)), dtype=np.uint8)
    choices = np.arange(16)
    for k in range(1, each):
        reached = np.clip(predictor[:, None] + CHANGE[index[:, None] + choices], -32768, 32767)
        best = np.abs(reached - rows[:, k : k + 1]).argmin(axis=1)
        predictor, index = reached[np.arange(len(rows)), best], FOLLOWING[index + best]
        codes[k - 1] = best
    body = (codes[0::2] | codes[1::2] << 4).T
    head = np.zeros((len(rows), 4), dtype=np.uint8)
    head[:, 2] = start
    head[:, :2] = rows[:, :1].astype("<i2").view(np.uint8).reshape(-1, 2)
    return np.hstack([head, body]).tobytes()


def wav(data: bytes, kind: int = MULAW, rate: int = RATE, block: int = 1, bits: int = 8, samples: int | None = None, per_block: int = 0) -> bytes:
    """A mono WAV file."""
    second = rate * block if kind != ADPCM else rate * block // max(per_block, 1)
    form = struct.pack("<HHIIHH", kind, 1, rate, second, block, bits) + (b"" if kind == PCM else struct.pack("<HH", 2, per_block) if kind == ADPCM else struct.pack("<H", 0))
    fact = b"" if kind == PCM else b"fact" + struct.pack("<II", 4, len(data) // block if samples is None else samples)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(file: bytes | None) -> dict | None:
    """kind, channels, rate, block, bits, data of a WAV file; None if it isn't one."""
    if not file or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(file):
            kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", file, at + 8)
            found = {"kind": kind, "channels": channels, "rate": rate, "block": block, "bits": bits}
        elif name == b"data" and found:
            return found | {"data": file[at + 8 : at + 8 + size]}
        at += 8 + size + size % 2
    return None


def samples_of(file: bytes | None) -> tuple[np.ndarray, int] | None:
    """16-bit samples and rate of a file in any of the known formats, channels averaged; None for others and for ADPCM of several channels."""
    x = parse(file)
    if not x or not x["channels"] or not x["rate"]:
        return None
    raw, channels = np.frombuffer(x["data"], dtype=np.uint8), x["channels"]
    if x["kind"] in (MULAW, ALAW) or x["kind"] == PCM and x["bits"] == 16:
        each = raw[: len(raw) // 2 * 2].view("<i2") if x["kind"] == PCM else (MULAW_TABLE if x["kind"] == MULAW else ALAW_TABLE)[raw]
        if channels > 1:
            each = each[: len(each) // channels * channels].reshape(-1, channels).mean(axis=1).round().astype("<i2")
        return each, x["rate"]
    if x["kind"] == ADPCM and x["block"] > 4 and channels == 1:
        whole = raw[: len(raw) // x["block"] * x["block"]].reshape(-1, x["block"])
        parts = [decode_adpcm(whole[i : i + GROUP_BLOCKS]).ravel() for i in range(0, len(whole), GROUP_BLOCKS)]
        return np.concatenate(parts) if parts else np.zeros(0, "<i2"), x["rate"]
    return None


def _half_band(taps: int = 31) -> np.ndarray:
    x = np.arange(taps) - taps // 2
    return (np.sinc(x / 2) * np.hamming(taps)).astype(np.float64)


_UP = _half_band()


def resample(samples: np.ndarray, rate: int, to: int = PCM_RATE) -> np.ndarray:
    """16-bit samples at another rate by a windowed-sinc filter, which also takes off what a lower rate can't hold."""
    if rate == to or not len(samples):
        return samples.astype("<i2")
    if to == 2 * rate:
        wide = np.zeros(2 * len(samples))
        wide[::2] = samples
        made = np.convolve(wide, _UP)[len(_UP) // 2 :][: 2 * len(samples)]  # "same" would be as long as the filter for short inputs
    else:
        cut = min(1.0, to / rate)
        half, number = int(np.ceil(TAPS / cut)), len(samples) * to // rate
        padded, around = np.pad(samples.astype(np.float64), half), np.arange(1 - half, half + 1)
        made = np.empty(number)
        for first in range(0, number, CHUNK):
            at = np.arange(first, min(first + CHUNK, number)) * (rate / to)
            base = np.floor(at).astype(np.int64)
            off = around[None, :] - (at - base)[:, None]
            weights = np.sinc(off * cut) * (0.5 + 0.5 * np.cos(np.pi * np.clip(off / half, -1, 1)))
            made[first : first + len(at)] = (padded[base[:, None] + around[None, :] + half] * weights).sum(axis=1) / weights.sum(axis=1)
    return np.clip(np.rint(made), -32768, 32767).astype("<i2")


def to_pcm(file: bytes | None, rate: int = PCM_RATE) -> bytes | None:
    """The file as 16-bit PCM at ``rate``; None if it can't be read."""
    found = samples_of(file)
    return None if found is None else wav(resample(found[0], found[1], rate).tobytes(), PCM, rate, 2, 16)


def parts(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut so that the column at ``place`` has PART_BYTES at most, or is one row's."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PART_BYTES, "right")))
            yield batch.slice(first, last - first)
            first = last


def with_pcm(batches: Iterator[pa.RecordBatch], place: int, rate: int = PCM_RATE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in parts, and one more column, made: the files at ``place`` as 16-bit PCM files."""
    for batch in parts(batches, place):
        made = pa.array([to_pcm(f.as_py(), rate) for f in batch.column(place)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "made"])


def converted(media: DataFrame, media_col: str = "media", rate: int = PCM_RATE, out: str = "pcm") -> DataFrame:
    """media and one more column, out: each file of media_col as a 16-bit PCM file at ``rate``; null where it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return with_pcm(batches, place, rate)

    place, plain = media.columns.index(media_col), media.toDF(*(f"c{i}" for i in range(len(media.columns))))  # names may hold dots, or clash
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("made", BinaryType())])).toDF(*media.columns, unused(media, out))


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + FILL * (-len(raw) % BLOCK if raw else BLOCK)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's bytes as the samples of a mu-law file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            rows = [payload(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([wav(p) for _, p in rows], pa.binary())], names=["id", "n_bytes", "media"])

    slim = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n_bytes long, media binary")


def _adpcm_checks(payloads: list[bytes]) -> list[int]:
    """CRC-32 of the samples of each payload, read as ADPCM blocks; the blocks of many payloads are decoded together."""
    made, at = [0] * len(payloads), 0
    while at < len(payloads):
        end, size = at, 0
        while end < len(payloads) and (end == at or size + len(payloads[end]) <= GROUP_BLOCKS * BLOCK):
            size += len(payloads[end])
            end += 1
        blocks = np.frombuffer(b"".join(payloads[at:end]), dtype=np.uint8).reshape(-1, BLOCK)
        first = 0
        counts = [len(p) // BLOCK for p in payloads[at:end]]
        owner = np.repeat(np.arange(at, end), counts)
        for i in range(0, len(blocks), GROUP_BLOCKS):  # one payload alone may be longer than a group
            samples = np.ascontiguousarray(decode_adpcm(blocks[i : i + GROUP_BLOCKS]))
            mine = owner[i : i + GROUP_BLOCKS]
            cuts = np.flatnonzero(np.diff(mine)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mine)]):
                made[mine[first]] = zlib.crc32(samples[first:last], made[mine[first]])
        at = end
    return made


def describe(file: bytes | None, pcm: bytes | None, adpcm: int) -> str | None:
    """None for what isn't a file of a known format; else rms, peak and sign changes of the file's samples, and CRC-32s of the samples, of the stored PCM, and of the payload as A-law and as ADPCM."""
    found, made = samples_of(file), parse(pcm)
    if found is None or made is None:
        return None
    samples = found[0]
    wide = samples.astype(np.int64)
    rms = int(np.sqrt((wide * wide).sum() // max(len(wide), 1)))
    signs = int(np.count_nonzero(np.diff(np.signbit(samples))))
    raw = np.frombuffer(parse(file)["data"], dtype=np.uint8)
    checks = (zlib.crc32(samples), zlib.crc32(made["data"]), zlib.crc32(ALAW_TABLE[raw]), adpcm)
    return f"rms={rms};peak={int(np.abs(wide).max(initial=0))};signs={signs};" + ";".join(f"{k}={v:08x}" for k, v in zip(("ulaw", "pcm", "alaw", "adpcm"), checks))


_READ = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def read(stored: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of ``store``'s rows, from the stored files.

    The file as resampled PCM is a column of its own on the way, made as ``converted`` makes it, from which the
    checksum is taken. A file that isn't one has null for all that would be read from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_pcm(batches, 2):
            files, pcms = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            payloads = [(parse(f) or {}).get("data") for f in files]
            checks = _adpcm_checks([(p or b"")[: len(p or b"") // BLOCK * BLOCK] for p in payloads])
            rows = [
                (None,) * 3 + ((None, None) if f is None else (len(f), hashlib.sha256(f).hexdigest())) + (None,) if p is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest(), describe(f, m, c))
                for f, p, m, c in zip(files, payloads, pcms, checks)
            ]
            columns = list(zip(*rows)) if rows else [()] * len(_READ)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, _READ.values()))], names=["id", "n_bytes", *_READ])

    return stored.select("id", "n_bytes", "media").mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
