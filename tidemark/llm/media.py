"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, expanded to PCM and resampled.

Media are stored, and so is the PCM that is made of the stored media; digests and features come from what is read back.
PCM is stored without loss in fewer bytes (`pack_samples`): samples that interpolate their neighbours, few distinct values
and ADPCM steps are told by what differs from them, so any PCM comes back sample by sample.

mu-law and A-law expand through 256-entry tables; ADPCM decodes one sample position of all blocks of a
batch at a time, so the Python loop runs over the samples of a block, not over blocks or documents.

Null and empty texts give one unit of 64 zero bytes. Equal texts give equal rows whatever their ids.
Repeated rows, null ids and extra columns are fine; an empty table gives no rows. A very long text is one
medium; batches are handled in slices of SLICE_BYTES.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, strings

#: Bytes of a payload unit, and of an ADPCM block.
UNIT = 64
SLICE_BYTES = 4_000_000
ALAW, MULAW, ADPCM = 6, 7, 17
CODECS = (MULAW, ALAW, ADPCM)
#: How media and PCM are written: zstd at a level that takes more CPU time for fewer bytes.
DENSE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12"}
MEDIA = "doc_id long, n_bytes long, codec int, media binary"

# Fixed values of the IMA ADPCM format.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, segment = (code & 15) << 4, (code >> 4) & 7
    size = np.where(segment == 0, step + 8, (step + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor and next index for index * 16 + code."""
    index, code = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = STEPS[index]
    change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * ((code >> 1) & 1) + step * ((code >> 2) & 1)
    return np.where(code & 8, -change, change).astype(np.int32), np.clip(index + INDEX_MOVES[code], 0, len(STEPS) - 1).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
ADPCM_CHANGE, ADPCM_NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks: (blocks, bytes a block) uint8 to (blocks, samples a block) int16."""
    n, width = blocks.shape
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int16)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = predictor
    for k, column in enumerate(np.ascontiguousarray(blocks[:, 4:].T)):
        for j, code in enumerate((column & 15, column >> 4)):
            at = index * 16 + code
            predictor = np.clip(predictor + ADPCM_CHANGE[at], -32768, 32767)
            index = ADPCM_NEXT[at]
            out[2 * k + j + 1] = predictor
    return out.T


def wav(payload: bytes, codec: int, rate: int = 8000) -> bytes:
    """A mono WAV file whose data chunk is the payload."""
    if codec == ADPCM:
        samples = 2 * (UNIT - 4) + 1
        form = struct.pack("<HHIIHHHH", codec, 1, rate, rate * UNIT // samples, UNIT, 4, 2, samples)
        fact = len(payload) // UNIT * samples
    else:
        form, fact = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0), len(payload)
    chunks = b"".join(struct.pack("<4sI", name, len(x)) + x for name, x in ((b"fmt ", form), (b"fact", struct.pack("<I", fact)), (b"data", payload)))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks


def parse_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """Codec, sampling rate, block size and the data chunk."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(view):
        name, n = struct.unpack_from("<4sI", view, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data":
            data = view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if form is None or data is None:
        raise ValueError("a chunk is missing")
    return form[0], form[2], form[4], data


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers, so that every machine gives the same samples."""
    if rate == to or not len(pcm):
        return pcm
    at, part = np.divmod(np.arange(len(pcm) * to // rate, dtype=np.int64) * rate, to)
    wide = pcm.astype(np.int32)
    return ((wide[at] * (to - part) + wide[np.minimum(at + 1, len(pcm) - 1)] * part) // to).astype(np.int16)


def expand(parsed: list[tuple[int, int, int, memoryview]]) -> list[np.ndarray]:
    """PCM of parsed WAV files; the ADPCM blocks of all of them are decoded together."""
    out: list[np.ndarray | None] = [None] * len(parsed)
    by_width: dict[int, list[int]] = {}
    for i, (codec, _, width, data) in enumerate(parsed):
        if codec == ADPCM:
            by_width.setdefault(width, []).append(i)
        elif codec in (MULAW, ALAW):
            out[i] = (MULAW_TABLE if codec == MULAW else ALAW_TABLE)[np.frombuffer(data, np.uint8)]
        else:
            raise ValueError(f"codec {codec}")
    for width, rows in by_width.items():
        blocks = [np.frombuffer(parsed[i][3], np.uint8).reshape(-1, width) for i in rows]
        decoded = decode_adpcm(np.concatenate(blocks))
        for i, part in zip(rows, np.split(decoded, np.cumsum([len(b) for b in blocks])[:-1]), strict=True):
            out[i] = part.reshape(-1)
    return out


#: Samples that one ADPCM block of UNIT bytes gives: the predictor of stored samples starts anew after as many.
RUN = 2 * (UNIT - 4) + 1
FORM_RAW, FORM_MULAW, FORM_ALAW, FORM_STEPS, HALVED = 0, 1, 2, 3, 4
#: For each 16-bit value its code in the table, or -1.
_PLACES = {form: np.full(65536, -1, np.int16) for form in (FORM_MULAW, FORM_ALAW)}
for _form, _table in ((FORM_MULAW, MULAW_TABLE), (FORM_ALAW, ALAW_TABLE)):
    _PLACES[_form][_table.view(np.uint16)] = np.arange(256)


def _step_code(now: np.ndarray, then: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ADPCM code next to each change, and what it leaves (modulo 2 ** 16)."""
    step, size, code = STEPS[index], np.abs(then - now), np.zeros(len(index), np.int64)
    for bit in (4, 2, 1):
        fits = size >= step
        code += bit * fits
        size, step = size - step * fits, step >> 1
    code += 8 * (then < now)
    return code, (then - np.clip(now + ADPCM_CHANGE[index * 16 + code], -32768, 32767)).astype(np.int16)


def _step_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and rests of runs; a column is a run. Where a sample is at its limit, several codes fit: the smallest is taken if
    only then the next change leaves no rest, else the largest."""
    index = np.full(x.shape[1], len(STEPS) - 1, np.int16)
    codes, rest = np.empty((len(x) - 1, x.shape[1]), np.uint8), np.empty((len(x) - 1, x.shape[1]), np.int16)
    for k in range(len(x) - 1):
        code, left = _step_code(x[k], x[k + 1], index)
        at_limit = np.flatnonzero((x[k + 1] == 32767) | (x[k + 1] == -32768))
        small = np.zeros(len(at_limit), bool)
        if k + 2 < len(x):
            ahead = [_step_code(x[k + 1, at_limit], x[k + 2, at_limit], ADPCM_NEXT[index[at_limit] * 16 + c])[1] == 0 for c in (code[at_limit], 7)]
            small = ahead[0] & ~ahead[1] & (left[at_limit] == 0)
        large = at_limit[~small]
        code[large] = 7 + 8 * (x[k + 1, large] < 0)
        left[large] = (x[k + 1, large] - np.clip(x[k, large] + ADPCM_CHANGE[index[large] * 16 + code[large]], -32768, 32767)).astype(np.int16)
        codes[k], rest[k] = code, left
        index = ADPCM_NEXT[index * 16 + code]
    return codes, rest


def _from_step_codes(first: np.ndarray, codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    codes, rest = np.ascontiguousarray(codes.T), np.ascontiguousarray(rest.T)
    index = np.full(len(first), len(STEPS) - 1, np.int16)
    out = np.empty((RUN, len(first)), np.int16)
    out[0] = first
    for k in range(RUN - 1):
        at = index * 16 + codes[k]
        out[k + 1] = np.clip(out[k] + ADPCM_CHANGE[at], -32768, 32767).astype(np.int16) + rest[k]
        index = ADPCM_NEXT[at]
    return out.T


def pack_samples(pcm: list[np.ndarray]) -> list[bytes]:
    """16-bit samples without loss: a byte for the form, the number of samples, and
    FORM_RAW: the samples; FORM_MULAW and FORM_ALAW (all samples are values of that table): a byte a sample; FORM_STEPS: runs of
    RUN samples as first sample, 4-bit ADPCM codes, a bit for each code that leaves a rest, and the rests.
    HALVED: every second sample is what `resample` makes of its neighbours, and is left out of these."""
    out: list[bytes] = [b""] * len(pcm)
    stepwise: list[tuple[int, int, np.ndarray]] = []
    for i, x in enumerate(pcm):
        whole, form = np.ascontiguousarray(x, np.int16), 0
        x = whole
        if len(whole) and len(whole) % 2 == 0 and np.array_equal(resample(whole[::2], 1, 2), whole):
            x, form = np.ascontiguousarray(whole[::2]), HALVED
        for kind, places in _PLACES.items():
            codes = places[x.view(np.uint16)]
            if codes.min(initial=0) >= 0:
                out[i] = struct.pack("<Bq", form | kind, len(x)) + codes.astype(np.uint8).tobytes()
                break
        else:
            out[i] = struct.pack("<Bq", form | FORM_RAW, len(x)) + x.astype("<i2").tobytes()
            stepwise.append((i, form, x))
    if stepwise:
        runs = [np.pad(x, (0, -len(x) % RUN), "edge").reshape(-1, RUN) for _, _, x in stepwise]
        columns = np.ascontiguousarray(np.concatenate(runs).T).astype(np.int32)
        codes, rest = (c.T for c in _step_codes(columns))
        bounds = np.cumsum([0, *map(len, runs)])
        for (i, form, x), own, lo, hi in zip(stepwise, runs, bounds[:-1], bounds[1:], strict=True):
            left = rest[lo:hi] != 0
            packed = b"".join([struct.pack("<Bq", form | FORM_STEPS, len(x)), own[:, 0].astype("<i2").tobytes(), (codes[lo:hi, ::2] | codes[lo:hi, 1::2] << 4).tobytes(), np.packbits(left).tobytes(), rest[lo:hi][left].astype("<i2").tobytes()])
            out[i] = min(out[i], packed, key=len)
    return out


def unpack_samples(packed: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(packed)
    forms: list[int] = []
    stepwise: list[tuple] = []
    for i, data in enumerate(packed):
        form, n = struct.unpack_from("<Bq", data)
        forms.append(form)
        kind = form & ~HALVED
        if kind in (FORM_MULAW, FORM_ALAW):
            out[i] = (MULAW_TABLE if kind == FORM_MULAW else ALAW_TABLE)[np.frombuffer(data, np.uint8, n, 9)]
        elif kind == FORM_STEPS:
            runs, half = -(-n // RUN), (RUN - 1) // 2
            pairs = np.frombuffer(data, np.uint8, runs * half, 9 + 2 * runs).reshape(runs, half)
            at, bits = 9 + (2 + half) * runs, runs * (RUN - 1)
            left = np.unpackbits(np.frombuffer(data, np.uint8, -(-bits // 8), at), count=bits).astype(bool)
            rest = np.zeros(bits, np.int16)
            rest[left] = np.frombuffer(data, "<i2", offset=at + -(-bits // 8))
            stepwise.append((i, n, np.frombuffer(data, "<i2", runs, 9), np.stack([pairs & 15, pairs >> 4], axis=2).reshape(runs, -1), rest.reshape(runs, -1)))
        else:
            out[i] = np.frombuffer(data, "<i2", n, 9)
    if stepwise:
        samples = _from_step_codes(*(np.concatenate([s[k] for s in stepwise]) for k in (2, 3, 4)))
        for (i, n, first, *_), own in zip(stepwise, np.split(samples, np.cumsum([len(s[2]) for s in stepwise])[:-1]), strict=True):
            out[i] = own.reshape(-1)[:n]
    return [resample(x, 1, 2) if form & HALVED else x for x, form in zip(out, forms, strict=True)]


def feature(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square, zero crossings and a checksum of the resampled PCM, all whole numbers."""
    wide = pcm.astype(np.int64)
    square = int(np.dot(wide, wide))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"samples={len(pcm)};peak={int(np.abs(wide).max(initial=0))};rms={math.isqrt(square // max(1, len(pcm)))};crossings={crossings};crc32={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes):
        yield start, len(sizes)


def encode_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One WAV medium a document; its payload's checksum picks the codec, so that all three are in use."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1)).cast(pa.large_binary())
            for lo, hi in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                sizes, codecs, media = [], [], []
                for raw in texts[lo:hi].to_pylist():
                    payload = raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))
                    codec = CODECS[zlib.crc32(payload) % 3]
                    sizes.append(len(raw))
                    codecs.append(codec)
                    media.append(wav(payload, codec))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sizes, pa.int64()), pa.array(codecs, pa.int32()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "codec", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, MEDIA)


def _decoded(batches: Iterator[pa.RecordBatch], rate: int):
    for batch in batches:
        media = batch.column(batch.schema.get_field_index("media"))
        for lo, hi in slices(pc.binary_length(media).to_numpy(zero_copy_only=False)):
            raw = media[lo:hi].to_pylist()
            parsed = [parse_wav(x) for x in raw]
            yield batch.slice(lo, hi - lo), raw, parsed, [resample(x, p[1], rate) for x, p in zip(expand(parsed), parsed, strict=True)]


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def to_pcm(media: DataFrame, *, rate: int = 16000, packed: bool = False) -> DataFrame:
    """What stored media hold: doc_id, n_bytes, codec, sizes and digests of payload and medium, rate, and the resampled 16-bit
    PCM (packed: as pack_samples gives it)."""
    names = ["doc_id", "n_bytes", "codec", *(c.split()[0] for c in DIGESTS.split(", ")), "rate", "pcm"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, parsed, pcm in _decoded(batches, rate):
            data = [p[3] for p in parsed]
            digests = [
                pa.array([len(x) for x in data], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in data]),
                pa.array([zlib.crc32(x[-UNIT:]) for x in data], pa.int64()),
                pa.array([len(x) for x in raw], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
            ]
            samples = pa.array(pack_samples(pcm) if packed else [x.astype("<i2").tobytes() for x in pcm], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *digests, pa.array([rate] * len(pcm), pa.int32()), samples], names)

    return media.select("doc_id", "n_bytes", "codec", "media").mapInArrow(read, f"doc_id long, n_bytes long, codec int, {DIGESTS}, rate int, pcm binary")


def store_pcm(media: DataFrame, *, rate: int = 16000) -> DataFrame:
    """The PCM of stored media, stored on shared storage without loss and read back."""
    stored = materialize(to_pcm(media, rate=rate, packed=True), "pcm", **DENSE)
    names = stored.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names) - 1)
            for lo, hi in slices(pc.binary_length(column).to_numpy(zero_copy_only=False)):
                samples = [x.astype("<i2").tobytes() for x in unpack_samples(column[lo:hi].to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(samples, pa.binary())], names)

    return stored.mapInArrow(read, stored.schema)


def describe(pcm: DataFrame) -> DataFrame:
    """Stored PCM with a feature of each row's samples in their place."""
    kept = [c for c in pcm.columns if c not in ("rate", "pcm")]
    types = dict(pcm.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature(np.frombuffer(x.as_buffer(), "<i2")) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.string())], [*kept, "feature"])

    return pcm.select(*kept, "pcm").mapInArrow(read, ", ".join(f"{c} {types[c]}" for c in kept) + ", feature string")


def store_texts(docs: DataFrame, **kwargs) -> DataFrame:
    """Media of all documents, stored on shared storage and read back."""
    return materialize(encode_texts(docs, **kwargs), "media", **DENSE)
