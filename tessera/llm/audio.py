"""Media columns: lossless 8-bit audio, polyphase resampling, log-mel windows and hysteresis segments.

The windows of a row are stored as an Arrow IPC stream in a binary column: a table of time spans whose log_mel column
has the Arrow type fixed_shape_tensor of shape (WINDOW, N_MELS); read_windows() gives it back without copying.

Defined cases: null bytes are empty bytes; a payload shorter than a frame is padded with silence for the
features, never in the stored form; a constant payload has no segment. Rows are independent, other columns pass
through, and a column bearing an output's name is replaced.
"""

from __future__ import annotations

import io
import math
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from tessera.llm.common import map_rows

STORED_RATE, RATE = 24_000, 16_000
FRAME, HOP, N_FFT, N_MELS = 400, 160, 512, 32
#: Frames of a stored tensor, whose shape is (WINDOW, N_MELS) for every row.
WINDOW = 16
#: Frames whose spectra are held at a time.
BLOCK_FRAMES = 4096
#: A segment begins where the log energy rises above this share of its range and ends where it falls below the other.
ON, OFF = 0.6, 0.4
#: A smaller range of log energy is flat: no segment.
FLAT = 1e-3
FLOOR = 1e-10

TENSOR = pa.fixed_shape_tensor(pa.float32(), (WINDOW, N_MELS))
WINDOWS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("log_mel", TENSOR)])
SPAN = StructType([StructField("start_s", DoubleType()), StructField("end_s", DoubleType())])


def _le(n: Column, size: int) -> Column:
    """n as size little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def padded_payload(text: Column, multiple: int = 192) -> Column:
    """UTF-8 bytes of the text, null as none, then blanks up to a positive multiple."""
    n = F.octet_length(F.coalesce(text, F.lit("")))
    total = F.greatest(F.lit(1), F.ceil(n / multiple)) * multiple
    return F.encode(F.concat(F.coalesce(text, F.lit("")), F.repeat(F.lit(" "), (total - n).cast("int"))), "UTF-8")


def store_wav(df: DataFrame, bytes_col: str, out: str = "wav") -> DataFrame:
    """Appends a mono 8-bit PCM RIFF/WAVE file that holds the bytes as samples, one each (a pad byte follows an odd number)."""
    data = F.coalesce(F.col(bytes_col), F.lit(b""))
    n = F.octet_length(data)
    odd = n % 2
    head = F.concat(
        F.encode(F.lit("RIFF"), "UTF-8"), _le(n + odd + 36, 4), F.encode(F.lit("WAVEfmt "), "UTF-8"), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(F.lit(1), 2),
        _le(F.lit(STORED_RATE), 4), _le(F.lit(STORED_RATE), 4), _le(F.lit(1), 2), _le(F.lit(8), 2), F.encode(F.lit("data"), "UTF-8"), _le(n, 4),
    )
    return df.withColumn(out, F.concat(head, data, F.when(odd == 1, F.lit(b"\0")).otherwise(F.lit(b""))))


@lru_cache(4)
def _taps(up: int, down: int, zeros: int = 10) -> np.ndarray:
    """Blackman-windowed sinc low-pass at the lower of the two Nyquist rates, of odd length."""
    half = zeros * max(up, down)
    t = np.arange(-half, half + 1)
    return (np.sinc(t / max(up, down)) * np.blackman(2 * half + 1) * up / max(up, down)).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase rational resampling: output m is the sum of x[k] h[m*down - k*up], each phase a small dot product."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down or not len(x):
        return x.astype(np.float32)
    h = _taps(up, down)
    half, n_out = len(h) // 2, -(-len(x) * up // down)
    width = len(h) // up + 1
    y = np.empty(n_out, np.float32)
    lead = width + down
    padded = np.pad(x.astype(np.float32), (lead, width + 2 * down + 2))
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    for phase in range(min(up, n_out)):
        # For m = phase + q*up the inputs k run from ceil((m*down - half) / up).
        k0 = -((half - phase * down) // up)
        taps = np.zeros(width, np.float32)
        for j in range(width):
            at = phase * down - (k0 + j) * up + half
            if 0 <= at < len(h):
                taps[j] = h[at]
        count = -(-(n_out - phase) // up)
        for q in range(0, count, 1 << 16):
            rows = view[lead + k0 + q * down : lead + k0 + min(count, q + (1 << 16)) * down : down][: min(count - q, 1 << 16)]
            y[phase + q * up : phase + (q + len(rows)) * up : up] = rows @ taps
    return y


@lru_cache(1)
def _mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale from 20 Hz to the Nyquist rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(RATE / 2), N_MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(N_FFT, 1 / RATE)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, N_MELS) log-mel energies of overlapped Hann frames and the log energy of each frame."""
    if len(y) < FRAME:
        y = np.pad(y, (0, FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), _mel_bank()
    mels, energy = [], []
    for at in range(0, len(frames), BLOCK_FRAMES):
        part = frames[at : at + BLOCK_FRAMES]
        power = np.abs(np.fft.rfft(part * window, N_FFT)) ** 2
        mels.append(np.log(np.maximum(power.astype(np.float32) @ bank, FLOOR)))
        energy.append(np.log(np.maximum((part * part).mean(axis=1), FLOOR)))
    return np.round(np.concatenate(mels), 3), np.concatenate(energy)


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that begin above the upper threshold and last until the lower one; none in a flat signal."""
    low, span = float(energy.min()), float(np.ptp(energy))
    if span < FLAT:
        return []
    spans, begun = [], None
    for i, e in enumerate(((energy - low) / span).tolist()):
        if begun is None and e > ON:
            begun = i
        elif begun is not None and e < OFF:
            spans.append((begun, i))
            begun = None
    if begun is not None:
        spans.append((begun, len(energy)))
    return spans


def read_wav(stored: bytes) -> tuple[bytes, int]:
    """The samples' bytes of a mono 8-bit file, and its rate."""
    with wave.open(io.BytesIO(stored)) as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("not mono 8-bit audio")
        return f.readframes(f.getnframes()), f.getframerate()


def features_of(samples: bytes, rate: int) -> tuple[pa.RecordBatch, list[tuple]]:
    """Windows (start_s, end_s, frames, log_mel of fixed shape) and speech-like segments (start_s, end_s)."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x, RATE, rate))
    step, n = HOP / RATE, -(-len(mels) // WINDOW)
    tensors = np.full((n * WINDOW, N_MELS), math.log(FLOOR), np.float32)
    tensors[: len(mels)] = mels
    first = np.arange(n) * WINDOW
    frames = np.minimum(WINDOW, len(mels) - first)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), WINDOW * N_MELS)
    columns = [np.round(first * step, 6), np.round((first + frames - 1) * step + FRAME / RATE, 6), frames.astype(np.int32)]
    windows = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ExtensionArray.from_storage(TENSOR, storage)], schema=WINDOWS)
    return windows, [(round(a * step, 6), round((b - 1) * step + FRAME / RATE, 6)) for a, b in hysteresis(energy)]


def write_windows(windows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WINDOWS) as out:
        out.write_batch(windows)
    return sink.getvalue().to_pybytes()


def read_windows(stored: bytes) -> pa.Table:
    """The windows of a row, with log_mel as fixed-shape tensors."""
    return pa.ipc.open_stream(stored).read_all()


def audio_features(df: DataFrame, wav_col: str = "wav") -> DataFrame:
    """Reads the stored files back; appends samples (bytes), n_windows, windows (an Arrow IPC stream) and segments."""

    def make():
        def one(stored: bytes | None) -> tuple:
            samples, rate = read_wav(stored) if stored else (b"", STORED_RATE)
            windows, segments = features_of(samples, rate)
            return samples, windows.num_rows, write_windows(windows), [dict(zip(SPAN.names, s, strict=True)) for s in segments]

        return lambda rows: [one(w) for (w,) in rows]

    return map_rows(df, [wav_col], [("samples", BinaryType()), ("n_windows", IntegerType()), ("windows", BinaryType()), ("segments", ArrayType(SPAN))], make)


def feature_digest() -> Column:
    """Counts of windows and segments and a hash of all their values."""
    return F.concat_ws(":", "n_windows", F.size("segments"), F.lpad(F.lower(F.hex(F.xxhash64("windows", "segments"))), 16, "0"))
