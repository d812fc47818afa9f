"""Scale-invariant local features of a grey image in numpy, after Lowe's paper of 2004.

Images are doubled, blurred in octaves of LAYERS scales, and extrema of the
differences of neighbouring scales are refined by a quadratic fit. Weak ones and
those on edges are dropped; each gets the orientations of its neighbourhood's
gradients, and a descriptor of 4 x 4 histograms of 8 directions.
"""

from __future__ import annotations

import numpy as np

# Scales of an octave, contrast, edge ratio and first blur of the paper, and the blur a camera's image has.
LAYERS, CONTRAST, EDGE, SIGMA, CAMERA = 3, 0.04, 10.0, 1.6, 0.5
DIRECTIONS, CELLS, BINS = 36, 4, 8


def to_grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """Luminance of samples in the order blue, green, red; None where there is no image."""
    if height <= 0 or width <= 0 or channels not in (1, 3, 4) or len(data) < height * width * channels:
        return None
    samples = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels)
    if channels == 1:
        return samples[:, :, 0]
    return np.rint(samples[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(4 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        wide = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        image = np.lib.stride_tricks.sliding_window_view(wide, len(kernel), axis=axis) @ kernel
    return image


def _doubled(image: np.ndarray) -> np.ndarray:
    """Twice the size, linearly between samples."""
    for axis in (0, 1):
        n = image.shape[axis]
        place = np.clip((np.arange(2 * n) + 0.5) / 2 - 0.5, 0, n - 1)
        low = np.minimum(place.astype(int), max(0, n - 2))
        part = (place - low).reshape(-1, *[1] * (1 - axis))
        image = np.take(image, low, axis) * (1 - part) + np.take(image, np.minimum(low + 1, n - 1), axis) * part
    return image


def _octaves(grey: np.ndarray):
    base = _blur(_doubled(grey.astype(float) / 255), max(SIGMA**2 - 4 * CAMERA**2, 0.01) ** 0.5)
    steps = [SIGMA * 2 ** (i / LAYERS) for i in range(LAYERS + 3)]
    while min(base.shape) >= 8:
        own = [base]
        for a, b in zip(steps, steps[1:]):
            own.append(_blur(own[-1], (b * b - a * a) ** 0.5))
        yield np.stack(own)
        base = own[LAYERS][::2, ::2]


def _extrema(dog: np.ndarray) -> np.ndarray:
    """layer, y, x of samples that none of their 26 neighbours exceeds, in either direction."""
    around = np.lib.stride_tricks.sliding_window_view(dog, (3, 3, 3))
    middle = dog[1:-1, 1:-1, 1:-1]
    strong = np.abs(middle) > 0.5 * CONTRAST / LAYERS
    top = (middle > 0) & (middle >= around.max(axis=(3, 4, 5))) | (middle < 0) & (middle <= around.min(axis=(3, 4, 5)))
    return np.argwhere(strong & top) + 1


def _refined(dog: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Place and contrast of an extremum between samples; None where it leaves the image, is weak or lies on an edge."""
    for _ in range(5):
        s, y, x = at
        cube = dog[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2]
        gradient = np.array([cube[2, 1, 1] - cube[0, 1, 1], cube[1, 2, 1] - cube[1, 0, 1], cube[1, 1, 2] - cube[1, 1, 0]]) / 2
        middle = cube[1, 1, 1]
        curve = np.empty((3, 3))
        curve[0, 0], curve[1, 1], curve[2, 2] = cube[2, 1, 1] + cube[0, 1, 1] - 2 * middle, cube[1, 2, 1] + cube[1, 0, 1] - 2 * middle, cube[1, 1, 2] + cube[1, 1, 0] - 2 * middle
        curve[0, 1] = curve[1, 0] = (cube[2, 2, 1] - cube[2, 0, 1] - cube[0, 2, 1] + cube[0, 0, 1]) / 4
        curve[0, 2] = curve[2, 0] = (cube[2, 1, 2] - cube[2, 1, 0] - cube[0, 1, 2] + cube[0, 1, 0]) / 4
        curve[1, 2] = curve[2, 1] = (cube[1, 2, 2] - cube[1, 2, 0] - cube[1, 0, 2] + cube[1, 0, 0]) / 4
        move = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
        if np.abs(move).max() < 0.5:
            contrast = middle + gradient @ move / 2
            trace, area = curve[1, 1] + curve[2, 2], curve[1, 1] * curve[2, 2] - curve[1, 2] ** 2
            if abs(contrast) * LAYERS < CONTRAST or area <= 0 or trace**2 * EDGE >= (EDGE + 1) ** 2 * area:
                return None
            return at + move, abs(contrast)
        at = at + np.rint(np.clip(move, -1e6, 1e6)).astype(int)
        if (at < 1).any() or (at > np.array(dog.shape) - 2).any():
            return None
    return None


def _gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dy, dx = np.gradient(image)
    return np.hypot(dx, dy), np.arctan2(dy, dx)


def _patch(shape: tuple[int, int], y: float, x: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the inner samples around a place."""
    cy, cx = round(y), round(x)
    rows, columns = np.arange(max(1, cy - reach), min(shape[0] - 1, cy + reach + 1)), np.arange(max(1, cx - reach), min(shape[1] - 1, cx + reach + 1))
    return rows[:, None], columns[None, :]


def _orientations(size: np.ndarray, angle: np.ndarray, y: float, x: float, scale: float) -> list[float]:
    rows, columns = _patch(size.shape, y, x, round(4.5 * scale))
    weight = size[rows, columns] * np.exp(-((rows - y) ** 2 + (columns - x) ** 2) / (2 * (1.5 * scale) ** 2))
    number = np.rint(angle[rows, columns] * DIRECTIONS / (2 * np.pi)).astype(int) % DIRECTIONS
    hist = np.bincount(number.ravel(), weights=weight.ravel(), minlength=DIRECTIONS)
    near = lambda k: np.roll(hist, k)
    hist = (near(2) + near(-2)) / 16 + (near(1) + near(-1)) / 4 + hist * 3 / 8
    before, after = np.roll(hist, 1), np.roll(hist, -1)
    peaks = np.flatnonzero((hist > before) & (hist > after) & (hist >= 0.8 * hist.max()))
    part = (before - after)[peaks] / (2 * (before - 2 * hist + after)[peaks])
    return ((peaks + part) * 2 * np.pi / DIRECTIONS).tolist()


def _descriptor(size: np.ndarray, angle: np.ndarray, y: float, x: float, scale: float, turn: float) -> np.ndarray:
    width = 3 * scale  # of a cell
    rows, columns = _patch(size.shape, y, x, round(width * 2**0.5 * (CELLS + 1) / 2))
    dy, dx = rows - y, columns - x
    across, down = (np.cos(turn) * dx + np.sin(turn) * dy) / width, (np.cos(turn) * dy - np.sin(turn) * dx) / width
    weight = size[rows, columns] * np.exp(-(across**2 + down**2) / (2 * (CELLS / 2) ** 2))
    place = [down + CELLS / 2 - 0.5, across + CELLS / 2 - 0.5, (angle[rows, columns] - turn) % (2 * np.pi) * BINS / (2 * np.pi)]
    inside = (place[0] > -1) & (place[0] < CELLS) & (place[1] > -1) & (place[1] < CELLS)
    place, weight = [p[inside] for p in place], weight[inside]
    low = [np.floor(p).astype(int) for p in place]
    hist = np.zeros((CELLS + 2, CELLS + 2, BINS))
    for corner in np.ndindex(2, 2, 2):  # each sample is shared among the eight nearest bins
        share = weight.copy()
        for p, n, c in zip(place, low, corner):
            share = share * (p - n if c else 1 - (p - n))
        np.add.at(hist, (low[0] + 1 + corner[0], low[1] + 1 + corner[1], (low[2] + corner[2]) % BINS), share)
    out = hist[1:-1, 1:-1].ravel()
    out = np.minimum(out, 0.2 * np.linalg.norm(out))
    return np.minimum(np.rint(512 * out / max(np.linalg.norm(out), 1e-12)), 255)


def keypoints(grey: np.ndarray) -> list[tuple[float, float, float, float, float, np.ndarray]]:
    """contrast, y, x, scale, orientation and descriptor of each feature, places in samples of the image."""
    out = []
    for octave, blurred in enumerate(_octaves(grey)):
        dog = np.diff(blurred, axis=0)
        if min(dog.shape) < 3:
            break
        fields: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen = set()
        for at in _extrema(dog):
            found = _refined(dog, at)
            if found is None or (key := tuple(np.rint(found[0] * 8).astype(int).tolist())) in seen:
                continue
            seen.add(key)
            (s, y, x), contrast = found
            layer = int(np.clip(np.rint(s), 1, LAYERS))
            if layer not in fields:
                fields[layer] = _gradients(blurred[layer])
            scale, step = SIGMA * 2 ** (s / LAYERS), 2.0 ** (octave - 1)
            for turn in _orientations(*fields[layer], y, x, scale):
                out.append((contrast, y * step, x * step, scale * step, turn, _descriptor(*fields[layer], y, x, scale, turn)))
    return out


def descriptors(grey: np.ndarray, most: int = 100) -> np.ndarray | None:
    """The descriptors of the features of the highest contrast, a row of 128 for each; None if there are none."""
    found = sorted(keypoints(grey), key=lambda k: -k[0])[:most]
    return np.stack([k[-1] for k in found]) if found else None
