"""Audio columns: lossless 8-bit storage, polyphase resampling, log-mel tensors and energy segments."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, slices, text_values

HEADER = 44  # bytes of a plain WAV header


@dataclass(frozen=True)
class Settings:
    rate: int = 12_000  # of the stored samples
    up: int = 2  # resampling to rate * up / down
    down: int = 3
    taps: int = 8  # of each polyphase branch
    frame: int = 256
    hop: int = 128
    mels: int = 24
    bins: int = 8  # time bins of a segment's tensor
    high: float = 0.25  # a segment begins this far (natural log) above the median energy
    low: float = -0.1  # and ends this far from it


def encode_wav(samples: bytes, rate: int) -> bytes:
    """Mono 8-bit PCM; the samples are the bytes themselves."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a mono 8-bit PCM file, walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


def payload_of(text: str) -> bytes:
    """UTF-8, zero bytes up to a positive multiple of 64."""
    raw = text.encode("utf-8")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed sinc for both rates, as one row of ``taps`` for each of the ``up`` polyphase branches."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (h * up / h.sum()).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, branches: np.ndarray) -> np.ndarray:
    """Output n reads branch (n * down) % up at input (n * down) // up; only kept samples are computed."""
    taps = branches.shape[1]
    total = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(down + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.zeros(total, np.float32)
    for p in range(min(up, total)):
        rows = windows[(p * down) // up :: down][: len(out[p::up])]
        h = branches[(p * down) % up][::-1]
        for a in range(0, len(rows), 1 << 16):  # bounds the copy of overlapping windows
            out[p::up][a : a + (1 << 16)] = np.einsum("ij,j->i", rows[a : a + (1 << 16)], h)
    return out


def mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, (bins of the spectrum, mels)."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


class Extractor:
    def __init__(self, s: Settings):
        self.s = s
        self.branches = low_pass(s.up, s.down, s.taps)
        self.window = np.hanning(s.frame).astype(np.float32)
        self.bank = mel_bank(s.rate * s.up / s.down, s.frame, s.mels)

    def log_mel(self, samples: bytes) -> np.ndarray:
        """(frames, mels) over overlapped frames; the last is filled with zeros."""
        s = self.s
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        y = resample(x, s.up, s.down, self.branches)
        n = 1 + max(0, -(-(len(y) - s.frame) // s.hop))
        y = np.concatenate([y, np.zeros((n - 1) * s.hop + s.frame - len(y), np.float32)])
        frames = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop]
        out = np.empty((n, s.mels), np.float32)
        for a in range(0, n, 2048):  # blocks, so that a long recording needs little memory
            power = np.abs(np.fft.rfft(frames[a : a + 2048] * self.window, axis=1)) ** 2
            out[a : a + 2048] = np.log(power.astype(np.float32) @ self.bank + 1e-6)
        return out

    def segments(self, mel: np.ndarray) -> list[tuple[int, int]]:
        """[from, to) frames: from where the energy passes the high threshold until it falls below the low one.

        A recording without such a passage is one segment.
        """
        energy = mel.mean(axis=1)
        energy = energy - np.median(energy)
        state = np.where(energy >= self.s.high, 1, np.where(energy < self.s.low, 0, -1))
        known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), 0))
        on = np.concatenate([[0], state[known] == 1, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(on))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist())) or [(0, len(mel))]

    def tensors(self, mel: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        """(segments, bins, mels): each segment's frames averaged into ``bins`` even time bins."""
        total = np.concatenate([np.zeros((1, mel.shape[1])), np.cumsum(mel, axis=0, dtype=np.float64)])
        a, b = np.array(spans).T
        at = a[:, None] + (np.arange(self.s.bins + 1) * (b - a)[:, None]) // self.s.bins
        left, right = at[:, :-1], np.maximum(at[:, 1:], at[:, :-1] + 1)
        right = np.minimum(right, len(mel))
        left = np.minimum(left, right - 1)
        return np.round((total[right] - total[left]) / (right - left)[..., None], 2).astype(np.float32)

    def arrow(self, samples: bytes) -> bytes:
        """An Arrow stream with a row for each segment: its time span in ms and its fixed-shape tensor."""
        s = self.s
        mel = self.log_mel(samples)
        spans = self.segments(mel)
        ms = 1000 * s.hop * s.down / (s.rate * s.up)
        kind = pa.fixed_shape_tensor(pa.float32(), (s.bins, s.mels))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(self.tensors(mel, spans).ravel()), s.bins * s.mels)
        batch = pa.RecordBatch.from_arrays([pa.array([a * ms for a, _ in spans]), pa.array([b * ms for _, b in spans]), pa.ExtensionArray.from_storage(kind, flat)], ["start_ms", "end_ms", "log_mel"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        return sink.getvalue().to_pybytes()


def read_segments(stream: bytes) -> pa.Table:
    """The spans and tensors that ``audio_columns`` stored."""
    return pa.ipc.open_stream(stream).read_all()


def audio_columns(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, payload, segments) of each row's whole text, null taken as empty.

    ``media`` is the stored WAV file of the padded payload, ``payload`` the samples
    read back from those stored bytes, and ``segments`` the Arrow stream of spans
    and fixed-shape log-mel tensors computed from them.  Row-local: equal texts
    give equal values, however rows are batched; long recordings go through in
    blocks.  An empty text is 64 zero samples, one segment.
    """

    def run(batches):
        extract = Extractor(settings)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                rows = []
                for text in text_values(part.column(1)):
                    media = encode_wav(payload_of(text), settings.rate)
                    samples, _ = decode_wav(media)
                    rows.append((len(text.encode("utf-8")), media, samples, extract.arrow(samples)))
                n, media, samples, segments = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(samples, pa.binary()), pa.array(segments, pa.binary())], ["id", "n_bytes", "media", "payload", "segments"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, n_bytes long, media binary, payload binary, segments binary").withColumnRenamed("id", id_col)


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("payload").cast("long")
    return audio_columns(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        n.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.sha2("segments", 256).alias("feature"),
    )
