"""Pixel arithmetic on one picture: arrays of shape (height, width, channels), RGB."""

from __future__ import annotations

import numpy as np

# Channel means (red, green, blue) on the 0..255 scale.
CHANNEL_MEANS = (123.68, 116.78, 103.94)
CENTRAL_FRACTION = 0.875
RESIZE_METHODS = ("bilinear", "nearest", "bicubic", "area")
CUBIC_A = -0.75
# Strength of the colour distortion.
BRIGHTNESS, HUE = 32.0 / 255.0, 0.2
FACTOR_LOW, FACTOR_HIGH = 0.5, 1.5
# Which distortions run in which order, by ordering number.
SLOW_ORDERS = (("brightness", "saturation", "hue", "contrast"),
               ("saturation", "brightness", "contrast", "hue"),
               ("contrast", "hue", "brightness", "saturation"),
               ("hue", "saturation", "contrast", "brightness"))
FAST_ORDERS = (("brightness", "saturation"),) + (("saturation", "brightness"),) * 3


# --- resizing ---------------------------------------------------------------

def axis_taps(n_in: int, n_out: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Source positions and weights (n_out, taps) along one axis; source = target * n_in / n_out."""
    if method not in RESIZE_METHODS:
        raise ValueError(f"resize method must be one of {' '.join(RESIZE_METHODS)}, got {method!r}")
    scale = n_in / n_out
    at = np.arange(n_out) * scale
    base = np.minimum(np.floor(at).astype(int), n_in - 1)
    if method == "nearest":
        return base[:, None], np.ones((n_out, 1))
    if method == "bilinear":
        t = at - base
        return np.stack([base, np.minimum(base + 1, n_in - 1)], 1), np.stack([1 - t, t], 1)
    if method == "bicubic":
        offsets = np.arange(-1, 3)
        d = np.abs((at - base)[:, None] - offsets)
        near = ((CUBIC_A + 2) * d - (CUBIC_A + 3)) * d * d + 1
        far = ((d - 5) * d + 8) * d * CUBIC_A - 4 * CUBIC_A
        return np.clip(base[:, None] + offsets, 0, n_in - 1), np.where(d <= 1, near, np.where(d < 2, far, 0.0))
    taps = int(np.ceil(scale)) + 1
    cells = base[:, None] + np.arange(taps)
    overlap = np.minimum(cells + 1, (at + scale)[:, None]) - np.maximum(cells, at[:, None])
    return np.minimum(cells, n_in - 1), np.clip(overlap, 0, None) / scale


def resize(img: np.ndarray, height: int, width: int, method: str = "bilinear") -> np.ndarray:
    """Resize to exactly height x width, whatever the aspect."""
    rows, row_w = axis_taps(img.shape[0], height, method)
    cols, col_w = axis_taps(img.shape[1], width, method)
    tall = sum(img[rows[:, t]] * row_w[:, t, None, None] for t in range(rows.shape[1]))
    return sum(tall[:, cols[:, t]] * col_w[None, :, t, None] for t in range(cols.shape[1]))


def aspect_size(height: int, width: int, side: int) -> tuple[int, int]:
    """Size with the smaller side equal to ``side``, in single precision and cut to whole pixels."""
    scale = np.float32(side) / np.float32(min(height, width))
    return int(np.float32(height) * scale), int(np.float32(width) * scale)


def aspect_resize(img: np.ndarray, side: int) -> np.ndarray:
    return resize(img, *aspect_size(img.shape[0], img.shape[1], side))


# --- crops ------------------------------------------------------------------

def crop(img: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    if img.ndim != 3:
        raise ValueError("a picture has three axes")
    if img.shape[0] < height or img.shape[1] < width:
        raise ValueError("crop size greater than the picture size")
    return img[top:top + height, left:left + width]


def central_fraction(img: np.ndarray, fraction: float = CENTRAL_FRACTION) -> np.ndarray:
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    h, w = img.shape[:2]
    top, left = int((h - h * fraction) / 2), int((w - w * fraction) / 2)
    return crop(img, top, left, h - 2 * top, w - 2 * left)


def central_crop(images: list[np.ndarray], height: int, width: int) -> list[np.ndarray]:
    return [crop(i, (i.shape[0] - height) // 2, (i.shape[1] - width) // 2, height, width) for i in images]


def offset_crop(images: list[np.ndarray], height: int, width: int, u: tuple[float, float]) -> list[np.ndarray]:
    """The same window, placed by two uniforms, cut from pictures of one size."""
    if not images:
        raise ValueError("empty picture list")
    if any(i.shape[:2] != images[0].shape[:2] for i in images):
        raise ValueError("pictures differ in size")
    h, w = images[0].shape[:2]
    top, left = int(u[0] * (h - height + 1)), int(u[1] * (w - width + 1))
    return [crop(i, top, left, height, width) for i in images]


def sample_box(height: int, width: int, draw, boxes=None, aspect=(0.75, 1.33), area=(0.05, 1.0),
               covered: float = 0.1, attempts: int = 100) -> tuple[int, int, int, int]:
    """Crop window (top, left, height, width) of random area and aspect.

    ``draw(attempt)`` gives four uniforms.  A window counts if it fits and holds
    at least ``covered`` of the area of some box (ymin, xmin, ymax, xmax in
    0..1; default the whole picture).  Without success the whole picture is taken.
    """
    boxes = [(0.0, 0.0, 1.0, 1.0)] if boxes is None or not len(boxes) else boxes
    for attempt in range(attempts):
        u_area, u_aspect, u_top, u_left = draw(attempt)
        size = (area[0] + (area[1] - area[0]) * u_area) * height * width
        ratio = aspect[0] + (aspect[1] - aspect[0]) * u_aspect
        h, w = int(np.floor(np.sqrt(size / ratio) + 0.5)), int(np.floor(np.sqrt(size * ratio) + 0.5))
        if not (0 < h <= height and 0 < w <= width):
            continue
        top, left = int(u_top * (height - h + 1)), int(u_left * (width - w + 1))
        for ymin, xmin, ymax, xmax in boxes:
            tall = min(top + h, ymax * height) - max(top, ymin * height)
            wide = min(left + w, xmax * width) - max(left, xmin * width)
            whole = (ymax - ymin) * height * (xmax - xmin) * width
            if whole > 0 and max(tall, 0) * max(wide, 0) >= covered * whole:
                return top, left, h, w
    return 0, 0, height, width


def flip(img: np.ndarray) -> np.ndarray:
    return img[:, ::-1]


# --- colour -----------------------------------------------------------------

def to_hsv(rgb: np.ndarray) -> np.ndarray:
    top, low = rgb.max(-1), rgb.min(-1)
    span = top - low
    safe = np.where(span > 0, span, 1.0)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2.0 + (b - r) / safe, 4.0 + (r - g) / safe))
    return np.stack([np.where(span > 0, hue / 6.0 % 1.0, 0.0), np.where(top > 0, span / np.where(top > 0, top, 1.0), 0.0), top], -1)


def to_rgb(hsv: np.ndarray) -> np.ndarray:
    h, s, v = hsv[..., 0:1], hsv[..., 1:2], hsv[..., 2:3]
    wheel = np.abs((h * 6.0 + np.array([0.0, 4.0, 2.0])) % 6.0 - 3.0) - 1.0
    return v * (1.0 + s * (np.clip(wheel, 0.0, 1.0) - 1.0))


def distort_color(img: np.ndarray, ordering: int, u: tuple[float, float, float, float], fast: bool = True) -> np.ndarray:
    """Brightness, saturation, hue and contrast by four uniforms, in one of four orders."""
    if ordering not in (0, 1, 2, 3):
        raise ValueError("color ordering must be in [0, 3]")
    factor = [FACTOR_LOW + (FACTOR_HIGH - FACTOR_LOW) * v for v in u]
    for step in (FAST_ORDERS if fast else SLOW_ORDERS)[ordering]:
        if step == "brightness":
            img = img + (2 * u[0] - 1) * BRIGHTNESS
        elif step == "saturation":
            hsv = to_hsv(img)
            hsv[..., 1] = np.clip(hsv[..., 1] * factor[1], 0.0, 1.0)
            img = to_rgb(hsv)
        elif step == "hue":
            hsv = to_hsv(img)
            hsv[..., 0] = (hsv[..., 0] + (2 * u[2] - 1) * HUE) % 1.0
            img = to_rgb(hsv)
        else:
            mean = img.mean(axis=(0, 1))
            img = (img - mean) * factor[3] + mean
    return np.clip(img, 0.0, 1.0)


# --- normalisation ------------------------------------------------------------

def normalise(img: np.ndarray, mode: int) -> np.ndarray:
    """0: to -1..1; 1: doubled minus its channel means; 2: standardised times 0.4."""
    if mode == 0:
        return (img - 0.5) * 2.0
    if mode == 1:
        doubled = img * 2.0
        return doubled - doubled.mean(axis=(0, 1))
    if mode == 2:
        return (img - img.mean()) / max(img.std(), 1.0 / np.sqrt(img.size)) * 0.4
    raise ValueError(f"normalisation must be 0, 1 or 2, got {mode!r}")


def subtract_means(img: np.ndarray, means=CHANNEL_MEANS) -> np.ndarray:
    if img.ndim != 3:
        raise ValueError("a picture has three axes")
    if img.shape[2] != len(means):
        raise ValueError("one mean per channel is needed")
    return img - np.asarray(means)


def draw_box(img: np.ndarray, box, color=(1.0, 1.0, 0.0)) -> np.ndarray:
    """Copy with the one-pixel outline of box (ymin, xmin, ymax, xmax in 0..1)."""
    out = img.copy()
    h, w = img.shape[:2]
    top, bottom = int(box[0] * (h - 1)), int(box[2] * (h - 1))
    left, right = int(box[1] * (w - 1)), int(box[3] * (w - 1))
    ink = np.asarray(color)[:img.shape[2]]
    out[[top, bottom], left:right + 1] = ink
    out[top:bottom + 1, [left, right]] = ink
    return out
