"""Measures of grey pictures, for the functions that decode them."""

from __future__ import annotations

import numpy as np


def measure(grey: np.ndarray) -> dict[str, float]:
    """Sharpness (variance of the Laplacian), brightness (mean) and entropy of the histogram in bits."""
    p = np.pad(np.asarray(grey, np.float64), 1, mode="reflect") if min(grey.shape) > 1 else np.pad(np.asarray(grey, np.float64), 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    share = np.bincount(np.asarray(grey, np.uint8).ravel(), minlength=256) / grey.size
    share = share[share > 0]
    return {"sharpness": round(float(laplacian.var()), 3), "brightness": round(float(np.mean(grey)), 3), "entropy": round(float(-(share * np.log2(share)).sum()), 4) + 0.0}


def _lanczos(size: int, cells: int) -> np.ndarray:
    """(cells, size) weights of the windowed-sinc filter with three lobes, widened by the reduction."""
    scale = size / cells
    wide = max(scale, 1.0)
    centre = (np.arange(cells)[:, None] + 0.5) * scale
    at = np.arange(size)[None, :]
    low = np.maximum(np.floor(centre - 3 * wide + 0.5), 0)
    high = np.minimum(np.floor(centre + 3 * wide + 0.5), size)
    x = (at + 0.5 - centre) / wide
    weight = np.where((at >= low) & (at < high) & (np.abs(x) < 3), np.sinc(x) * np.sinc(x / 3), 0.0)
    return weight / weight.sum(1, keepdims=True)


def shrink(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resampled to whole grey levels, first across, then down."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = level(np.asarray(grey, np.float64) @ _lanczos(grey.shape[1], width).T)
    return level(_lanczos(grey.shape[0], height) @ across)


def difference_hash(grey: np.ndarray, size: int = 8) -> str:
    """One bit a pair of horizontal neighbours of the shrunk picture, set where it gets brighter, as hexadecimal digits."""
    small = shrink(grey, size, size + 1)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{size * size // 4}x}"


def encode_picture(grey: np.ndarray, quality: int = 75) -> bytes:
    """JPEG where the imaging library is there, else the plain grey format (PGM)."""
    try:
        from PIL import Image
    except ImportError:
        return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, np.uint8).tobytes()
    import io

    out = io.BytesIO()
    Image.fromarray(np.asarray(grey, np.uint8)).save(out, "JPEG", quality=quality)
    return out.getvalue()
