"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks, resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

from .common import materialize, slices, text_buffer, with_columns_of


def mulaw_table() -> np.ndarray:
    """16-bit PCM of the 256 mu-law codes (ITU-T G.711)."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of the 256 A-law codes (ITU-T G.711)."""
    a = np.arange(256) ^ 0x55
    exponent, low = (a >> 4) & 7, (a & 15) << 4
    size = np.where(exponent == 0, low + 8, (low + 264) << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
# Fixed values of the IMA ADPCM format: the step sizes and the moves of the step index.
ADPCM_STEPS = np.array(
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
    np.int32,
)
ADPCM_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + nibble: the change of the sample and the next step index."""
    nibble, step = np.arange(16), ADPCM_STEPS[:, None]
    change = (step >> 3) + (nibble & 1) * (step >> 2) + (nibble >> 1 & 1) * (step >> 1) + (nibble >> 2 & 1) * step
    following = np.clip(np.arange(len(ADPCM_STEPS))[:, None] + ADPCM_MOVES[nibble & 7], 0, len(ADPCM_STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), following.astype(np.int32).ravel()


ADPCM_CHANGE, ADPCM_NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (n, bytes) to PCM (n, 2 * (bytes - 4) + 1); a step works on one nibble of all blocks.

    A block's head is a sample (i16), a step index (above 88 counts as 88) and an unused byte; low nibbles come first."""
    n, size = blocks.shape
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    out[0] = sample
    for j in range(size - 4):
        for k, nibble in enumerate((body[j] & 15, body[j] >> 4)):
            at = index * 16 + nibble
            sample = np.clip(sample + ADPCM_CHANGE[at], -32768, 32767)
            index = ADPCM_NEXT[at]
            out[2 * j + k + 1] = sample
    return out.T


def expand(payload: np.ndarray, codec: str, block: int = 64) -> np.ndarray:
    """8-bit telephony bytes as 16-bit PCM; codec is mulaw, alaw or adpcm (whole blocks only)."""
    if codec == "adpcm":
        return decode_adpcm(payload.reshape(-1, block)).ravel()
    return {"mulaw": MULAW, "alaw": ALAW}[codec][payload]


def resample(pcm: np.ndarray, up: int = 2, size: np.ndarray | None = None) -> np.ndarray:
    """PCM at `up` times its rate, by linear interpolation rounded toward minus infinity; the last sample is held.

    size: how many samples each of several files has that lie one after another."""
    x = pcm.astype(np.int32)
    after = np.r_[x[1:], x[-1:]]
    if size is not None:
        last = np.cumsum(size)[size > 0] - 1
        after[last] = x[last]
    out = np.empty((len(pcm), up), np.int16)
    for k in range(up):
        out[:, k] = (x * (up - k) + after * k) // up
    return out.ravel()


def pack_pcm(pcm: np.ndarray, size: np.ndarray, up: int = 2) -> list[bytes]:
    """Lossless codes of files of these many samples one after another, each a multiple of `up`: `up`, whether samples lie off the lines between every up-th one
    (a byte each), these samples, and only if so what all samples differ by from the lines (two bytes each)."""
    frames = size // up
    base = pcm[::up]
    rest = pcm.astype(np.int32) - resample(base, up, frames)
    off = np.r_[0, np.cumsum(size)]
    bent = np.r_[0, np.cumsum(rest != 0)][off]
    bent = bent[1:] > bent[:-1]
    raw = base.astype("<i2").tobytes()
    return [bytes([up, curved]) + raw[2 * a // up : 2 * b // up] + (rest[a:b].astype("<u2").tobytes() if curved else b"") for a, b, curved in zip(off[:-1].tolist(), off[1:].tolist(), bent.tolist(), strict=True)]


def unpack_pcm(code: bytes) -> np.ndarray:
    """The 16-bit samples of a code of pack_pcm()."""
    up, raw = code[0], np.frombuffer(code, "<i2", offset=2)
    frames = len(raw) // (up + 1) if code[1] else len(raw)
    line = resample(raw[:frames], up)
    return line + raw[frames:] if code[1] else line


def measure(pcm: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peak, sum of absolute samples and zero crossings of files (none empty) of these many samples one after another."""
    begin = np.cumsum(size) - size
    loud = np.abs(pcm.astype(np.int32))
    turns = np.zeros(len(pcm), np.int64)
    turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turns[begin] = 0
    return np.maximum.reduceat(loud, begin), np.add.reduceat(loud.astype(np.int64), begin), np.add.reduceat(turns, begin)


def wav(payload: bytes, codec: str, rate: int = 8000, block: int = 64) -> bytes:
    """A RIFF file around coded bytes: format 7 (mu-law), 6 (A-law) or 0x11 (IMA ADPCM)."""
    kind = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}[codec]
    if codec == "adpcm":
        samples = 2 * (block - 4) + 1
        fmt = struct.pack("<HHIIHHHH", kind, 1, rate, rate * block // samples, block, 4, 2, samples)
    else:
        fmt = struct.pack("<HHIIHHH", kind, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(raw: bytes) -> tuple[str, int, memoryview]:
    """(codec, rate, coded bytes) of wav()'s files; chunks other than fmt and data are passed over."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(raw):
        name, (size,) = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", raw, at + 8)
            codec = {7: "mulaw", 6: "alaw", 0x11: "adpcm"}[kind]
        elif name == b"data":
            return codec, rate, memoryview(raw)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def store_audio(docs: DataFrame, codec: str = "mulaw", text: str = "text", key: str = "doc_id", unit: int = 64) -> DataFrame:
    """A table (doc_id, n_bytes, media): whole texts as UTF-8, zero-padded to a positive multiple of `unit`, as the
    coded samples of a WAV file. Null texts count as empty (one unit of zeros); null keys and repeated rows are stored like others;
    a text is held whole by its task (WAV files end at 4 GB); an empty table gives an empty one; other columns are not read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, off = text_buffer(part.column(1))
                raw, out = buf.tobytes(), []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    out.append(wav(raw[a:b] + b"\0" * (max(unit, -(-(b - a) // unit) * unit) - (b - a)), codec, block=unit))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "media"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialize(chosen.mapInArrow(write, "doc_id long, n_bytes long, media binary"), "media", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20), "parquet.enable.dictionary": "false"})


def decode_audio(media: DataFrame, up: int = 2, column: str = "media") -> DataFrame:
    """All columns of media with pcm (binary, little-endian 16-bit at `up` times the rate) and pcm_rate; null media gives nulls.

    Each file is expanded by its own codec. An empty table gives an empty result; existing columns of these names are replaced."""
    def read(col: pa.Array) -> list[pa.Array]:
        pcm, rates = [], []
        for x in col:
            if not x.is_valid:
                pcm.append(None), rates.append(None)
                continue
            codec, rate, data = read_wav(x.as_py())
            pcm.append(resample(expand(np.frombuffer(data, np.uint8), codec), up).astype("<i2").tobytes())
            rates.append(rate * up)
        return [pa.array(pcm, pa.binary()), pa.array(rates, pa.int32())]

    return with_columns_of(media, column, {"pcm": BinaryType(), "pcm_rate": IntegerType()}, read, rows=64)


#: What store_sound() keeps of a file besides its sound.
_DIGESTS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "codec": pa.string(), "heard": pa.string()}
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _line(codec: str, pcm: np.ndarray, size: np.ndarray) -> list[str]:
    return [f"{codec}:{p},{t},{z}" for p, t, z in zip(*(m.tolist() for m in measure(pcm, size)), strict=True)]


def store_sound(media: DataFrame, up: int = 2, unit: int = 64) -> DataFrame:
    """A table of the sound of stored files, read back: sound (pack_pcm() of the 16-bit PCM at `up` times the rate, see pcm_of()), with digests of the coded bytes and of
    the file.

    heard holds the measures of the payload heard by the other two codecs (ADPCM in blocks of `unit` bytes), whose sound is not kept."""
    names = {**_DIGESTS, "sound": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 1 << 20):
                files = part.column(2).to_pylist()
                opened = [read_wav(f) for f in files]
                data, codecs = [d for _, _, d in opened], [c for c, _, _ in opened]
                payload, size = np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64)
                lines, sound = {}, {}
                for codec in ("mulaw", "alaw", "adpcm"):
                    count = size if codec != "adpcm" else size // unit * (2 * (unit - 4) + 1)
                    pcm = resample(expand(payload, codec, unit), up, count)
                    lines[codec] = _line(codec, pcm, count * up)
                    if codec in codecs:
                        sound[codec] = pack_pcm(pcm, count * up, up)
                out = [part.column(0), part.column(1), size, [hashlib.sha256(d).hexdigest() for d in data], [zlib.crc32(d[-unit:]) for d in data]]
                out += [[len(f) for f in files], [hashlib.sha256(f).hexdigest() for f in files], codecs]
                out.append([";".join(lines[c][i] for c in lines if c != own) for i, own in enumerate(codecs)])
                out.append([sound[c][i] for i, c in enumerate(codecs)])
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, names.values(), strict=True)], names=list(names))

    made = media.select("doc_id", "n_bytes", "media").mapInArrow(read, ", ".join(f"{c} {_KINDS[t]}" for c, t in names.items()))
    return materialize(made, "sound", **{"compression": "zstd", "parquet.page.size": str(4 << 20), "parquet.enable.dictionary": "false"})


def pcm_of(sound: DataFrame) -> DataFrame:
    """sound with pcm, the resampled little-endian 16-bit samples of each file."""
    return with_columns_of(sound, "sound", {"pcm": BinaryType()}, lambda col: [pa.array([unpack_pcm(x.as_py()).astype("<i2").tobytes() if x.is_valid else None for x in col], pa.binary())], rows=256)


def audio_features(sound: DataFrame) -> DataFrame:
    """Of each file of store_sound(), read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature.

    feature gives, for the payload heard as mu-law, A-law and IMA ADPCM, the peak, the sum of absolute samples and the
    zero crossings of the resampled PCM; those of the file's own codec are taken from the stored sound. Whole numbers only, so
    equal payloads agree exactly."""
    names = {c: t for c, t in _DIGESTS.items() if c not in ("codec", "heard")} | {"feature": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "sound", 2 << 20, 1024):
                samples = [unpack_pcm(x) for x in part.column(len(_DIGESTS)).to_pylist()]
                own = _line("", np.concatenate(samples), np.array([len(x) for x in samples]))
                heard = [[*h.split(";"), c + x] for h, c, x in zip(part.column(8).to_pylist(), part.column(7).to_pylist(), own, strict=True)]
                feature = [";".join(sorted(h, key=lambda x: ("mulaw", "alaw", "adpcm").index(x.split(":")[0]))) for h in heard]
                yield pa.RecordBatch.from_arrays([*part.columns[:7], pa.array(feature, pa.string())], names=list(names))

    return sound.select(*_DIGESTS, "sound").mapInArrow(read, ", ".join(f"{c} {_KINDS[t]}" for c, t in names.items()))
