"""Numeric kernels over samples: framing, filters, spectra, cepstra, embeddings. numpy only."""

from __future__ import annotations

import numpy as np


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """All full frames as a view; none for shorter input."""
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.zeros((0, size), x.dtype)


def levels(x: np.ndarray, rate: int, frame_ms: int = 25, hop_ms: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """dBFS and zero-crossing rate of each frame; one silent frame for shorter input."""
    f = frames(np.asarray(x, np.float64), max(1, rate * frame_ms // 1000), max(1, rate * hop_ms // 1000))
    if not len(f):
        return np.array([-100.0]), np.array([0.0])
    rms = np.sqrt((f**2).mean(1))
    db = np.where(rms > 1e-5, 20 * np.log10(np.maximum(rms, 1e-12)), -100.0)
    return np.maximum(db, -100.0), (np.diff(np.signbit(f), axis=1).sum(1)) / f.shape[1]


def quality(x: np.ndarray, rate: int) -> dict:
    """Peak and RMS in dBFS, share of clipped samples, offset, and milliseconds of near-silent full 20 ms blocks."""
    x = np.asarray(x, np.float64)
    db = lambda v: float(20 * np.log10(v)) if v > 1e-5 else -100.0
    if not len(x):
        return {"duration_ms": 0, "peak_db": -100.0, "rms_db": -100.0, "clipping": 0.0, "offset": 0.0, "near_silent_ms": 0}
    block = max(1, rate * 20 // 1000)
    full = x[: len(x) // block * block].reshape(-1, block)
    quiet = int((np.sqrt((full**2).mean(1)) < 10 ** (-60 / 20)).sum()) if len(full) else 0
    return {"duration_ms": len(x) * 1000 // rate, "peak_db": db(np.abs(x).max()), "rms_db": db(np.sqrt((x**2).mean())), "clipping": float((np.abs(x) >= 0.999).mean()), "offset": float(x.mean()), "near_silent_ms": quiet * 20}


def low_pass(cutoff: float, taps: int) -> np.ndarray:
    """A Hamming-windowed sinc; cutoff as a share of the sampling rate."""
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(2 * cutoff * n) * np.hamming(taps)
    return h / h.sum()


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation after a low-pass when the rate falls; edges are weighted by the taps inside."""
    x = np.asarray(x, np.float64)
    if source == target or not len(x):
        return x
    if target < source:
        h = low_pass(0.45 * target / source, 127 if source / target > 3 else 63)
        x = np.convolve(x, h, "same") / np.convolve(np.ones(len(x)), h, "same") if len(x) >= len(h) else x
    n = int(np.floor(len(x) * target / source + 0.5))
    return np.interp(np.arange(n) * source / target, np.arange(len(x)), x)


def mel_filters(rate: int, size: int, filters: int = 24, low: float = 20.0) -> np.ndarray:
    """Triangles on the mel scale over the bins of a real FFT; an empty one takes its nearest bin."""
    mel, back = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edge = back(np.linspace(mel(low), mel(rate / 2), filters + 2))
    bins = np.arange(size // 2 + 1) * rate / size
    up, down = (bins - edge[:-2, None]) / np.diff(edge)[:-1, None], (edge[2:, None] - bins) / np.diff(edge)[1:, None]
    out = np.maximum(0, np.minimum(up, down))
    for i in np.flatnonzero(out.sum(1) <= 0):
        out[i, np.abs(bins - edge[i + 1]).argmin()] = 1
    return out


def mfcc(x: np.ndarray, rate: int, filters: int = 24, coefficients: int = 13, emphasis: float = 0.97, lifter: int = 22) -> np.ndarray:
    x = np.asarray(x, np.float64)
    size = max(1, rate * 25 // 1000)
    f = frames(np.append(x[:1], x[1:] - emphasis * x[:-1]), size, max(1, rate // 100))
    fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(f * np.hamming(size), fft)) ** 2 / fft
    energy = np.log(np.maximum(power @ mel_filters(rate, fft, filters).T, 1e-10))
    k = np.arange(coefficients)[:, None]
    dct = np.cos(np.pi * k * (np.arange(filters) + 0.5) / filters) * np.where(k == 0, np.sqrt(1 / filters), np.sqrt(2 / filters))
    return energy @ dct.T * (1 + lifter / 2 * np.sin(np.pi * np.arange(coefficients) / lifter))


def delta(c: np.ndarray) -> np.ndarray:
    """Regression over two frames each way, clamped at the ends."""
    i = np.arange(len(c))
    at = lambda k: c[np.clip(i + k, 0, len(c) - 1)]
    return sum(k * (at(k) - at(-k)) for k in (1, 2)) / 10


def mean_normalized(c: np.ndarray) -> np.ndarray:
    """Coefficients of frames (rows) less the mean of each; no frames stay so."""
    return c - c.mean(axis=0, keepdims=True) if len(c) else c


def embedding(x: np.ndarray, rate: int) -> np.ndarray:
    """Mean, deviation and mean change of the cepstra, of unit length; without the change under 3 frames."""
    c = mfcc(x, rate)
    if not len(c):
        return np.zeros(0)
    parts = [c.mean(0), c.std(0)] + ([delta(c).mean(0)] if len(c) >= 3 else [])
    v = np.concatenate(parts)
    norm = np.sqrt((v**2).sum())
    return v / norm if norm > 1e-9 else v


def cosine_distance(a: np.ndarray, b: np.ndarray) -> float:
    """1 - cosine, from 0 to 2; 1 for other lengths or no direction."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape or not a.size:
        return 1.0
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.clip(1 - a @ b / n, 0, 2)) if n > 1e-12 else 1.0


def agglomerate(vectors: list[np.ndarray], count: int = 0, threshold: float = 0.35) -> tuple[list[int], list[float]]:
    """Labels by first appearance and the distance of each merge: the closest pair of size-weighted unit centroids
    merges until `count` are left (if given) or none is within the threshold."""
    centre = {i: np.asarray(v, float) for i, v in enumerate(vectors)}
    size, member, merges = dict.fromkeys(centre, 1), {i: i for i in centre}, []
    far = {(i, j): cosine_distance(centre[i], centre[j]) for i in centre for j in centre if i < j}
    while len(centre) > max(1, count):
        (i, j), d = min(far.items(), key=lambda kv: (kv[1], kv[0]))
        if not count and d > threshold:
            break
        merges.append(d)
        v = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        n = np.linalg.norm(v)
        centre[i], size[i] = (v / n if n > 1e-9 else v), size[i] + size[j]
        del centre[j], size[j]
        member = {k: i if m == j else m for k, m in member.items()}
        far = {p: x for p, x in far.items() if j not in p}
        far |= {(min(i, k), max(i, k)): cosine_distance(centre[i], centre[k]) for k in centre if k != i}
    first: dict[int, int] = {}
    return [first.setdefault(member[k], len(first)) for k in range(len(vectors))], merges


def jump_count(distances: list[float], ratio: float = 1.5, most: int = 8) -> int:
    """How many clusters the largest relative rise of merge distances leaves."""
    n = len(distances)
    rises = [(distances[i] / max(1e-6, distances[i - 1]), -i) for i in range(max(1, n - most), n)]
    best = max(rises, default=(0.0, 0))
    return min(most, max(1, n + best[1])) if best[0] >= max(1.05, ratio) else 1


def split_long(x: np.ndarray, rate: int, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """[start, end) in milliseconds cut at the quietest 100 ms of its middle 60 % until no part exceeds `most`."""
    if end - start <= most:
        return [(start, end)]
    low, high = start + (end - start) // 5, end - (end - start) // 5
    starts = range(low, high - 100 + 1, 50)
    power = [float((np.asarray(x[t * rate // 1000 : (t + 100) * rate // 1000], float) ** 2).mean()) for t in starts]
    cut = starts[int(np.argmin(power))] + 50 if power else (start + end) // 2
    return split_long(x, rate, start, cut, most) + split_long(x, rate, cut, end, most)
