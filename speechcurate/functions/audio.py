"""Small NumPy helpers that run inside tasks: WAV bytes, resampling, noise."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Half-width of the low-pass filter in zero crossings, and its roll-off.
ZERO_CROSSINGS = 16
ROLL_OFF = 0.99
OUTPUT_SLICE = 1 << 15
# Bytes of a file that are read at once when its header is looked for.
HEADER_BYTES = 256


@dataclass(frozen=True)
class Header:
    """Format and place of the samples of a WAV file."""

    kind: int
    channels: int
    rate: int
    width: int
    frames: int
    start: int


def read_header(read: Callable[[int, int], bytes], length: int) -> Header:
    """Header by ranged reads; ``read(at, n)`` gives up to ``n`` bytes at ``at`` of a file of ``length`` bytes.

    Chunks before the samples are skipped by their sizes, the samples are never
    read. A file that ends before its data chunk does is rejected.
    """
    held_at, held = 0, read(0, HEADER_BYTES)

    def get(at: int, n: int) -> bytes:
        nonlocal held_at, held
        if at < held_at or at + n > held_at + len(held):
            held_at, held = at, read(at, HEADER_BYTES)
        return held[at - held_at : at - held_at + n]

    if get(0, 4) != b"RIFF" or get(8, 4) != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", get(at, 8))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", get(at + 8, 16))
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack("<H", get(at + 32, 2))[0]
            found = (kind, channels, rate, bits // 8)
        if name == b"data":
            if found is None or not all(found):
                raise ValueError("WAV data without a format")
            if at + 8 + size > length:
                raise ValueError(f"WAV data of {size} bytes is cut to {length - at - 8}")
            kind, channels, rate, width = found
            return Header(kind, channels, rate, width, size // (channels * width), at + 8)
        at += 8 + size + size % 2
    raise ValueError("WAV file without data")


def _header_of(content: bytes) -> Header:
    return read_header(lambda at, n: content[at : at + n], len(content))


def wav_seconds(content: bytes) -> float:
    """Duration by the header, without decoding."""
    f = _header_of(content)
    return f.frames / f.rate


def decode_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """(sample rate, channels, interleaved float32 samples in -1 to 1) of 8, 16, 24 or 32 bit PCM or 32 or 64 bit float."""
    f = _header_of(content)
    return f.rate, f.channels, decode_samples(content[f.start : f.start + f.frames * f.channels * f.width], f.kind, f.width)


def decode_samples(raw: bytes, kind: int, width: int) -> np.ndarray:
    """Interleaved float32 samples of whole frames."""
    if kind == 3 and width in (4, 8):
        samples = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif kind != 1:
        raise ValueError(f"WAV format {kind} is not supported")
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = (((parts[:, 0] << 8) | (parts[:, 1] << 16) | (parts[:, 2] << 24)) >> 8).astype(np.float32) / float(1 << 23)
    elif width == 1:
        samples = (np.frombuffer(raw, "<u1").astype(np.float32) - 128.0) / 128.0
    elif width in (2, 4):
        samples = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width} bit samples are not supported")
    return samples


def to_pcm(samples: np.ndarray) -> bytes:
    """16 bit PCM; values beyond full scale are clipped."""
    return np.clip(np.rint(np.asarray(samples, dtype=np.float64) * 32768.0), -32768, 32767).astype("<i2").tobytes()


def pcm_header(samples: int, rate: int, channels: int = 1) -> bytes:
    """The 44 bytes before 16 bit PCM samples."""
    size = 2 * samples
    if size + 36 >= 1 << 32:
        raise ValueError(f"{samples} samples don't fit into a WAV file")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", size + 36, b"WAVE", b"fmt ", 16, 1, channels, rate, 2 * channels * rate, 2 * channels, 16, b"data", size)


def encode_wav(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file of 16 bit PCM."""
    return pcm_header(len(samples), int(rate), channels) + to_pcm(samples)


def to_mono(samples: np.ndarray, channels: int) -> np.ndarray:
    return samples if channels == 1 else samples.reshape(-1, channels).mean(axis=1)


def _reach(rate: int, new_rate: int) -> tuple[float, int]:
    """Cut-off of the low-pass filter and its half-width in samples."""
    cutoff = ROLL_OFF * min(1.0, new_rate / rate)
    return cutoff, int(np.ceil(ZERO_CROSSINGS / cutoff))


def resampled_length(frames: int, rate: int, new_rate: int) -> int:
    return -(-frames * new_rate // rate)


def needed_frames(first: int, stop: int, frames: int, rate: int, new_rate: int) -> tuple[int, int]:
    """Range of a clip's frames that its resampled frames ``first`` to ``stop`` depend on."""
    if rate == new_rate:
        return first, stop
    reach = _reach(rate, new_rate)[1]
    low, high = int(first * (rate / new_rate)) - reach - 1, int(stop * (rate / new_rate)) + reach + 2
    return min(max(low, 0), frames), max(min(high, frames), 0)


def resample_part(samples: np.ndarray, at_frame: int, first: int, stop: int, rate: int, new_rate: int) -> np.ndarray:
    """Frames ``first`` to ``stop`` of the resampled clip, from the ``samples`` that stand at ``at_frame`` of the given one.

    Band-limited interpolation with a Hann-windowed sinc. What isn't in ``samples`` counts as silence,
    so a part is equal to that part of the whole if they hold ``needed_frames``.
    """
    if rate == new_rate:
        return samples[first - at_frame : stop - at_frame]
    cutoff, reach = _reach(rate, new_rate)
    taps = np.arange(-reach, reach + 1)
    padded = np.pad(samples.astype(np.float64), reach + 1)
    out = np.empty(stop - first)
    for start in range(first, stop, OUTPUT_SLICE):
        at = np.arange(start, min(start + OUTPUT_SLICE, stop)) * (rate / new_rate)
        nearest = np.floor(at).astype(np.int64)
        offset = taps[None, :] - (at - nearest)[:, None]
        window = np.where(np.abs(offset) < reach, np.cos(np.pi * offset / (2 * reach)) ** 2, 0.0)
        kernel = cutoff * np.sinc(cutoff * offset) * window
        index = np.clip(nearest[:, None] - at_frame + taps[None, :] + reach + 1, 0, len(padded) - 1)
        out[start - first : start - first + len(at)] = (kernel * padded[index]).sum(axis=1)
    return out


def resample(samples: np.ndarray, rate: int, new_rate: int) -> np.ndarray:
    """A whole clip at another rate."""
    if rate == new_rate or len(samples) == 0:
        return samples
    return resample_part(samples, 0, 0, resampled_length(len(samples), rate, new_rate), rate, new_rate)


def noise_gain(signal_energy: float, noise_energy: float, snr: float) -> float:
    """Factor of a noise that brings it ``snr`` dB below a signal; a silent signal gets none."""
    if noise_energy <= 0:
        raise ValueError("the noise is silent")
    if signal_energy <= 0:
        return 0.0
    return 10.0 ** ((10.0 * (np.log10(signal_energy) - np.log10(noise_energy)) - snr) / 20.0)


def mix_noise(signal: np.ndarray, noise: np.ndarray, snr: float | None) -> np.ndarray:
    """Signal plus noise scaled to the wanted signal-to-noise ratio in dB; noise is cut to the signal."""
    if snr is None or np.isnan(snr) or not len(signal):
        return signal
    if len(noise) < len(signal):
        raise ValueError(f"noise of {len(noise)} samples is shorter than the clip of {len(signal)}")
    signal, noise = signal.astype(np.float64), noise[:len(signal)].astype(np.float64)
    return signal + noise_gain((signal ** 2).sum(), (noise ** 2).sum(), snr) * noise
