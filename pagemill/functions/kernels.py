"""NumPy kernels over rasters (height x width x 3, BGR bytes); no Spark in here.

They follow published algorithms (Otsu 1979, contrast-limited histogram equalisation, Canny 1986, Hough and Duda, separable
resampling) and claim the same results as those up to rounding. Every array is worked on as a whole.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

from ..config import EngineConfig, RotationAngle

WHITE = 255
#: Pixels of a block of rows, so that the arrays between stay small however large the raster is.
BLOCK = 1 << 15


def _blocks(h: int, w: int) -> list[slice]:
    step = max(1, BLOCK // max(w, 1))
    return [slice(a, min(a + step, h)) for a in range(0, h, step)]


def to_gray(image: np.ndarray) -> np.ndarray:
    """Fixed-point luma of BGR; gray passes."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.uint32) for k in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The threshold with the most variance between classes, the least of equals; 0 for one value only."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    n, s = hist.sum(), (hist * np.arange(256)).sum()
    q, c = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    inner = (q > 0) & (q < n)
    spread = np.zeros(256)
    spread[inner] = (s * q[inner] - n * c[inner]) ** 2 / (q[inner] * (n - q[inner]))
    return int(np.argmax(spread)) if inner.any() else 0


def ink_mask(gray: np.ndarray) -> np.ndarray:
    """255 where the gray is at most Otsu's threshold."""
    return np.where(gray <= otsu(gray), 255, 0).astype(np.uint8)


def _kernel(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x * x) / (2 * sigma * sigma))
    return k / k.sum()


def _along(x: np.ndarray, k: np.ndarray, axis: int, mode: str) -> np.ndarray:
    """Convolution with a symmetric kernel along one axis."""
    r = len(k) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    p = np.pad(x.astype(np.float64), pad, mode="symmetric" if min(x.shape[axis], r + 1) <= r and mode == "reflect" else mode)
    n = x.shape[axis]
    out = np.zeros(x.shape)
    for i, w in enumerate(k):
        out += w * (p[i : i + n] if axis == 0 else p[:, i : i + n])
    return out


def gaussian(image: np.ndarray, size: int = 5, sigma: float = 1.1) -> np.ndarray:
    k = _kernel(size, sigma)
    out = _along(_along(image, k, 0, "reflect"), k, 1, "reflect")
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _extreme(x: np.ndarray, least: bool) -> np.ndarray:
    """The least or greatest value of each 3 x 3 neighbourhood; what lies outside doesn't count."""
    pick, fill = (np.minimum, 255) if least else (np.maximum, 0)
    p = np.pad(x, 1, constant_values=fill)
    rows = pick(pick(p[:-2], p[1:-1]), p[2:])
    return pick(pick(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])


def open_close(mask: np.ndarray) -> np.ndarray:
    opened = _extreme(_extreme(mask, True), False)
    return _extreme(_extreme(opened, False), True)


def _weights(n_in: int, n_out: int, kind: str) -> np.ndarray:
    """Rows of weights of the inputs of each output along one axis."""
    scale = n_in / n_out
    if kind == "area" and scale > 1:
        low = np.arange(n_out) * scale
        cells = np.arange(n_in)
        return np.clip(np.minimum(low[:, None] + scale, cells + 1) - np.maximum(low[:, None], cells), 0, None) / scale
    taps = {"linear": 1, "area": 1, "cubic": 2, "lanczos": 4}[kind]
    at = (np.arange(n_out) + 0.5) * scale - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((n_out, n_in))
    k = np.arange(1 - taps, taps + 1)
    d = at[:, None] - (base[:, None] + k)
    w = _tap(d, kind)
    w /= w.sum(1, keepdims=True)
    np.add.at(out, (np.repeat(np.arange(n_out), len(k)), np.clip(base[:, None] + k, 0, n_in - 1).ravel()), w.ravel())
    return out


def _tap(d: np.ndarray, kind: str) -> np.ndarray:
    x = np.abs(d)
    if kind in ("linear", "area"):
        return np.clip(1 - x, 0, None)
    if kind == "cubic":
        a = -0.75
        return np.where(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a, 0))
    return np.where(x < 4, np.sinc(d) * np.sinc(d / 4), 0)


def resize(image: np.ndarray, h: int, w: int, kind: str) -> np.ndarray:
    """Separable resampling; rows and columns by banded products."""
    x = image.astype(np.float32)
    x = np.tensordot(_weights(image.shape[0], h, kind).astype(np.float32), x, (1, 0))
    x = np.moveaxis(np.tensordot(_weights(image.shape[1], w, kind).astype(np.float32), x, (1, 1)), 0, 1)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def normalize_height(image: np.ndarray, low: int = 800, high: int = 4000) -> np.ndarray:
    h, w = image.shape[:2]
    to, kind = (low, "cubic") if h < low else (high, "area") if h > high else (h, "")
    return resize(image, to, max(1, int(w * (to / h))), kind) if kind else image


def adaptive_resize(image: np.ndarray, longest: int) -> np.ndarray:
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    scale = longest / max(h, w)
    return resize(image, max(1, int(h * scale)), max(1, int(w * scale)), "lanczos")


def analysis_image(image: np.ndarray, longest: int) -> np.ndarray:
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    scale = longest / max(h, w)
    return resize(image, max(1, int(h * scale)), max(1, int(w * scale)), "area")


_RGB_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE_POINT = np.array([0.950456, 1.0, 1.088754])


def to_lab(image: np.ndarray) -> np.ndarray:
    c = image[..., ::-1] / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = linear @ _RGB_XYZ.T / _WHITE_POINT
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    xyz = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787) * _WHITE_POINT
    linear = np.clip(xyz @ np.linalg.inv(_RGB_XYZ).T, 0, 1)
    c = np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)
    return np.clip(np.rint(c * 255), 0, 255).astype(np.uint8)[..., ::-1]


def equalize_tiles(x: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of one byte channel, tables of neighbouring tiles blended bilinearly."""
    h, w = x.shape
    p = np.pad(x, ((0, -h % tiles), (0, -w % tiles)), mode="symmetric")
    th, tw = p.shape[0] // tiles, p.shape[1] // tiles
    cells = p.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1).astype(np.int64)
    hist = np.bincount((cells + 256 * np.arange(tiles * tiles)[:, None]).ravel(), minlength=256 * tiles * tiles).reshape(-1, 256)
    limit = max(1, int(clip * th * tw / 256))
    over = np.clip(hist - limit, 0, None).sum(1)
    hist = np.minimum(hist, limit) + (over // 256)[:, None]
    rest = over % 256
    for k, r in enumerate(rest):  # a table for each of the 64 tiles
        if r:
            hist[k, : r * max(256 // r, 1) : max(256 // r, 1)] += 1
    lut = np.clip(np.rint(np.cumsum(hist, 1) * (255 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)
    at_y, at_x = (np.arange(h) / th - 0.5), (np.arange(w) / tw - 0.5)
    y0, x0 = np.floor(at_y).astype(int), np.floor(at_x).astype(int)
    fy, fx = (at_y - y0)[:, None], (at_x - x0)[None, :]
    ya, yb, xa, xb = (np.clip(v, 0, tiles - 1) for v in (y0, y0 + 1, x0, x0 + 1))
    out = np.empty((h, w), np.uint8)
    for at in _blocks(h, w):
        a, b, v, f = ya[at, None], yb[at, None], x[at], fy[at]
        top = lut[a, xa[None, :], v] * (1 - fx) + lut[a, xb[None, :], v] * fx
        low = lut[b, xa[None, :], v] * (1 - fx) + lut[b, xb[None, :], v] * fx
        out[at] = np.clip(np.rint(top * (1 - f) + low * f), 0, 255)
    return out


def enhance_contrast(image: np.ndarray) -> np.ndarray:
    """Equalises lightness and leaves colour alone."""
    rows = _blocks(*image.shape[:2])
    lab = np.empty((*image.shape[:2], 3))
    for at in rows:
        lab[at] = to_lab(image[at])
    light = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    lab[..., 0] = equalize_tiles(light) / 2.55
    out = np.empty(lab.shape, np.uint8)
    for at in rows:
        out[at] = from_lab(lab[at])
    return out


def _turned(h: int, w: int, angle: float, center: tuple[float, float]):
    """Size of the canvas that holds all of a turned raster, and its blocks of rows: place, and the x and y that their pixels come from."""
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    nh, nw = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    y, x = np.arange(nh, dtype=np.float64)[:, None] - nh / 2, np.arange(nw, dtype=np.float64) - nw / 2
    cx, sx, cy, sy = c * x, s * x, c * y, s * y
    return nh, nw, ((at, cx - sy[at] + center[0], sx + cy[at] + center[1]) for at in _blocks(nh, nw))


def warp(image: np.ndarray, angle: float, center: tuple[float, float], fill: int, kind: str = "linear") -> np.ndarray:
    """Turned by angle degrees (counter-clockwise) about a center onto a canvas that holds all of it."""
    h, w = image.shape[:2]
    nh, nw, blocks = _turned(h, w, angle, center)
    taps = 1 if kind == "linear" else 2
    p = np.pad(image.astype(np.float32), ((taps, taps), (taps, taps), *[(0, 0)] * (image.ndim - 2)), constant_values=fill)
    out = np.zeros((nh, nw, *image.shape[2:]), np.uint8)
    for at, sx, sy in blocks:
        bx, by = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
        across = [(_tap(sx - bx - i, kind), np.clip(bx + i, -taps, w + taps - 1) + taps) for i in range(1 - taps, taps + 1)]
        part = np.zeros((*sx.shape, *image.shape[2:]), np.float32)
        for j in range(1 - taps, taps + 1):
            wy, iy = _tap(sy - by - j, kind), np.clip(by + j, -taps, h + taps - 1) + taps
            for wx, ix in across:
                weight = (wy * wx).astype(np.float32)
                part += p[iy, ix] * (weight if image.ndim == 2 else weight[..., None])
        out[at] = np.clip(np.rint(part), 0, 255)
    return out


def rotate_for_deskew(image: np.ndarray, angle: float, fill: int = WHITE) -> np.ndarray:
    h, w = image.shape[:2]
    return warp(image, angle, (w / 2, h / 2), fill)


def rotate_arbitrary(image: np.ndarray, angle: float) -> np.ndarray:
    h, w = image.shape[:2]
    return warp(image, angle, (w // 2, h // 2), WHITE, "cubic")


def _turned_row_sums(mask: np.ndarray, angles: np.ndarray, fill: int) -> list[np.ndarray]:
    """rotate_for_deskew(mask, angle, fill).sum(1) of each angle, for masks of 0 and 255: only pixels between both are interpolated."""
    h, w = mask.shape
    p = np.pad((mask > 0).astype(np.uint8), 2, constant_values=int(fill > 0))
    near = (p[:-1, :-1] | p[:-1, 1:] << 1 | p[1:, :-1] << 2 | p[1:, 1:] << 3).ravel()  # which of the four around have ink
    out = []
    for angle in angles:
        nh, nw, blocks = _turned(h, w, angle, (w / 2, h / 2))
        sums = np.zeros(nh, np.int64)
        for at, sx, sy in blocks:
            bx, by = np.floor(sx), np.floor(sy)
            sx -= bx
            sy -= by
            np.maximum(np.minimum(bx, w, out=bx), -2, out=bx)
            np.maximum(np.minimum(by, h, out=by), -2, out=by)
            by += 2
            by *= w + 3
            by += bx
            code = near.take(by.astype(np.intp) + 2)
            mixed = np.flatnonzero((code - np.uint8(1)) < 14)
            code_m, fx, fy = code.ravel()[mixed], sx.ravel()[mixed], sy.ravel()[mixed]
            wx, wy = (_tap(fx, "linear"), _tap(fx - 1, "linear")), (_tap(fy, "linear"), _tap(fy - 1, "linear"))
            v = np.zeros(len(mixed), np.float32)
            for k in range(4):
                v += (code_m >> k & 1) * np.float32(255) * (wy[k >> 1] * wx[k & 1]).astype(np.float32)
            v = np.clip(np.rint(v), 0, 255)
            sums[at] = 255 * np.count_nonzero(code == 15, axis=1) + np.bincount(mixed // nw, v, len(code)).astype(np.int64)
        out.append(sums)
    return out


def skew_angle(image: np.ndarray, border: str = "ink", most: float = 5, step: float = 0.5) -> float:
    """The angle whose row sums vary most, the first of equals."""
    mask = ink_mask(to_gray(image))
    angles = np.arange(-most, most + step / 2, step)
    scores = [np.var(s) for s in _turned_row_sums(mask, angles, 255 if border == "ink" else 0)]
    return float(angles[int(np.argmax(scores))])


def deskew(image: np.ndarray, border: str = "ink") -> np.ndarray:
    angle = skew_angle(image, border)
    return image if abs(angle) < 0.3 else rotate_for_deskew(image, angle)


def white_balance(image: np.ndarray) -> np.ndarray:
    mean = image.reshape(-1, 3).mean(0)
    gain = np.where(mean > 0, mean.mean() / np.where(mean > 0, mean, 1), 1)
    return np.clip(image * gain, 0, 255).astype(np.uint8)


def unsharp(image: np.ndarray, strength: float = 0.5, sigma: float = 2.0) -> np.ndarray:
    k = _kernel(2 * int(np.ceil(3 * sigma)) + 1, sigma)
    blur = np.rint(_along(_along(image, k, 0, "reflect"), k, 1, "reflect"))
    return np.clip(np.rint(image * (1 + strength) - blur * strength), 0, 255).astype(np.uint8)


def pad(image: np.ndarray, size: int = 16, value: int = WHITE) -> np.ndarray:
    return np.pad(image, ((size, size), (size, size), *[(0, 0)] * (image.ndim - 2)), constant_values=value)


def bounds(profile: np.ndarray, more_than: int) -> tuple[int, int] | None:
    at = np.flatnonzero(profile > more_than)
    return (int(at[0]), int(at[-1])) if len(at) else None


def main_block(profile: np.ndarray, gap: int = 100) -> tuple[int, int]:
    """First and last row of the block with most ink rows, the first of equals; wide gaps part blocks."""
    at = np.flatnonzero(profile > 0)
    if not len(at):
        return 0, len(profile) - 1
    blocks = np.split(at, np.flatnonzero(np.diff(at) > gap) + 1)
    best = max(blocks, key=len)
    return int(best[0]), int(best[-1])


def guard(h: int, w: int, top: int, bottom: int, left: int, right: int, most: float = 30) -> tuple[int, int, int, int]:
    """Gives back a part of what was cropped beyond so many percent."""
    out = []
    for full, a, b in ((h, top, bottom), (w, left, right)):
        percent = (1 - (b - a) / full) * 100
        if percent > most:
            grow = int(full * (percent - most) / 200)
            a, b = max(0, a - grow), min(full, b + grow)
        out += [a, b]
    return tuple(out)


def _profiles(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ink = ink_mask(to_gray(image)) > 0
    return ink.sum(1), ink.sum(0)


def crop_box(image: np.ndarray, config: EngineConfig = EngineConfig()) -> tuple[int, int, int, int]:
    """Top, bottom, left, right of both passes together."""
    h, w = image.shape[:2]
    whole = (0, h, 0, w)
    rows, columns = _profiles(image)
    if config.ignore_bottom_percent > 0:
        # a foot of no rows clears the whole profile, and with it the crop
        rows[-int(h * config.ignore_bottom_percent / 100) :] = 0
    tb, lr = bounds(rows, int(w * config.row_ink_ratio)), bounds(columns, int(h * config.column_ink_ratio))
    if tb is None or lr is None:
        return whole
    top, bottom, left, right = guard(h, w, *main_block(rows, config.footer_gap), *lr, config.max_crop_percent)
    p = config.padding_size
    top, bottom, left, right = max(0, top - p), min(h, bottom + p), max(0, left - p), min(w, right + p)
    part = image[top:bottom, left:right]
    if not part.size:
        return top, bottom, left, right
    ph, pw = part.shape[:2]
    rows, columns = _profiles(part)
    tb, lr = bounds(rows, int(pw * config.row_ink_ratio)), bounds(columns, int(ph * config.column_ink_ratio))
    if tb is None or lr is None:
        return top, bottom, left, right
    a, b, c, d = guard(ph, pw, *tb, *lr, config.max_crop_percent)
    return top + a, top + b, left + c, left + d


def crop(image: np.ndarray, config: EngineConfig = EngineConfig()) -> np.ndarray:
    top, bottom, left, right = crop_box(image, config)
    return image[top:bottom, left:right]


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Connected runs of a mask: row, first and last column of each run, its component, and the number of components."""
    edge = np.diff(np.pad(mask > 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    label = np.arange(len(row))
    wide, d = mask.shape[1] + 3, int(diagonal)
    # runs of the row above that touch: those from the first that ends late enough to the last that starts early enough
    low = np.searchsorted(row * wide + last + 1, (row - 1) * wide + first - d + 1, "left")
    high = np.searchsorted(row * wide + first + 1, (row - 1) * wide + last + d + 1, "right")
    n = np.where(row > 0, np.maximum(high - low, 0), 0)
    b = np.repeat(np.arange(len(row)), n)
    a = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(b))
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    names, label = np.unique(label, return_inverse=True)
    return row, first, last, label, np.array(len(names))


def _runs(shape: tuple[int, int], row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The mask of some of components' runs, between which there are gaps."""
    edge = np.zeros((shape[0], shape[1] + 1), np.int8)
    edge[row, first] = 1
    edge[row, last + 1] = -1
    return np.cumsum(edge[:, :-1], 1, dtype=np.int8) > 0


def header_blocks(mask: np.ndarray) -> int:
    """Outlines of the top third that are large and wide: areas follow from Pick's theorem on the filled shape."""
    top = mask[: mask.shape[0] // 3] > 0
    if not top.size:
        return 0
    row, first, last, label, n = components(top)
    hr, hf, hl, hole, holes = components(~np.pad(top, 1), False)
    filled = np.pad(top, 1)
    outside = hole[0] if len(hole) else -1  # the frame is the first run
    within = hole != outside
    filled |= _runs(filled.shape, hr[within], hf[within], hl[within])
    filled = filled[1:-1, 1:-1]
    inner = np.pad(filled, 1)
    rim = filled & ~(inner[:-2, 1:-1] & inner[2:, 1:-1] & inner[1:-1, :-2] & inner[1:-1, 2:])
    row, first, last, label, n = components(filled)
    size, edge = np.zeros(n), np.zeros(n)
    np.add.at(size, label, last - first + 1)
    rims = np.concatenate((np.zeros((len(filled), 1), np.int64), np.cumsum(rim, 1)), 1)
    np.add.at(edge, label, rims[row, last + 1] - rims[row, first])
    area = size - edge / 2 - 1
    box = [np.full(n, 1 << 30), np.full(n, -1), np.full(n, 1 << 30), np.full(n, -1)]
    np.minimum.at(box[0], label, row), np.maximum.at(box[1], label, row)
    np.minimum.at(box[2], label, first), np.maximum.at(box[3], label, last)
    high, wide = box[1] - box[0] + 1, box[3] - box[2] + 1
    return int(((area > 500) & (wide / (high + 1e-6) > 2)).sum())


def top_heavy(mask: np.ndarray, cap: float = 5.0) -> float:
    h = mask.shape[0]
    a, b, c = (p.sum(dtype=np.int64) / (p.size + 1e-6) for p in (mask[: h // 3], mask[h // 3 : 2 * h // 3], mask[2 * h // 3 :]))
    return float(min((a + b * 0.5) / (c + 1e-6), cap))


def row_variance(mask: np.ndarray, cap: float = 2.0) -> float:
    """Variance of the row sums after a Gaussian of sigma 2, whose results are whole numbers."""
    k = _kernel(17, 2.0)
    rows = np.floor(_along(mask.sum(1, dtype=np.int64), k, 0, "symmetric"))
    return float(min(np.var(rows) / 1000, cap))


def orientation_score(image: np.ndarray, weights: tuple[float, ...] = (0.35, 0.25, 0.15, 0.25)) -> float:
    """How much an image looks like an upright page."""
    mask = open_close(ink_mask(gaussian(to_gray(image))))
    ratio = image.shape[0] / image.shape[1]
    parts = (top_heavy(mask), row_variance(mask), min(header_blocks(mask) / 10, 1.0), 1.0 if ratio > 1.1 else 0.0 if ratio < 0.9 else 0.5)
    return sum(w * p for w, p in zip(weights, parts))


def canny(gray: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Edges: Sobel gradients, thinned along four directions, weak ones kept where they join strong ones."""
    g = np.pad(gray.astype(np.int32), 1, mode="edge")
    dx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    dy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda j, i: p[1 + j : 1 + j + h, 1 + i : 1 + i + w]
    ax, ay = np.abs(dx), np.abs(dy)
    flat, steep = ay < 0.4142135 * ax, ay > 2.4142135 * ax
    same = (dx ^ dy) >= 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    thin = (size > before) & np.where(flat | steep, size >= after, size > after)
    weak, strong = thin & (size > low), thin & (size > high)
    row, first, last, label, n = components(weak)
    strongs = np.concatenate((np.zeros((h, 1), np.int64), np.cumsum(strong, 1)), 1)
    has = np.zeros(int(n), np.int64)
    np.add.at(has, label, strongs[row, last + 1] - strongs[row, first])
    return _runs((h, w), *(x[has[label] > 0] for x in (row, first, last)))


def hough_angle(image: np.ndarray, threshold: int = 200, lines: int = 50) -> float | None:
    """Median angle of the strongest lines, or nothing without one."""
    edges = canny(gaussian(to_gray(image)))
    y, x = np.nonzero(edges)
    if not len(y):
        return None
    theta = np.arange(180) * np.pi / 180
    cos, sin = np.array([np.cos(t) for t in theta])[:, None], np.array([np.sin(t) for t in theta])[:, None]
    reach = sum(edges.shape)
    bins = 2 * reach + 1
    votes = np.zeros((180, bins), np.int32)
    for at in _blocks(180, len(y)):  # some degrees at once
        rho = np.rint(x * cos[at] + y * sin[at]).astype(np.int64) + (reach + bins * np.arange(at.stop - at.start))[:, None]
        votes[at] = np.bincount(rho.ravel(), minlength=bins * len(rho)).reshape(-1, bins)
    if votes.max() <= threshold:
        return None
    p = np.pad(votes, 1)
    v = p[1:-1, 1:-1]
    peak = (v > threshold) & (v > p[1:-1, :-2]) & (v >= p[1:-1, 2:]) & (v > p[:-2, 1:-1]) & (v >= p[2:, 1:-1])
    k, r = np.nonzero(peak)
    if not len(k):
        return None
    order = np.lexsort((k * votes.shape[1] + r, -votes[k, r]))[:lines]
    angle = np.degrees(theta[k[order]]) - 90
    return float(np.median(np.where(angle > 90, angle - 180, np.where(angle < -90, angle + 180, angle))))


def apply_rotation(image: np.ndarray, angle: int) -> np.ndarray:
    turns = {90: -1, -90: 1, 180: 2}.get(int(angle), 0)
    return np.ascontiguousarray(np.rot90(image, turns))


def detect_rotation(image: np.ndarray, config: EngineConfig = EngineConfig()) -> dict:
    """Angle, confidence, measured angle and whether to turn."""
    small = analysis_image(image, config.analysis_max_size)
    angle = hough_angle(small, config.hough_threshold)
    ratio = image.shape[0] / image.shape[1]
    lying = min((0.85 - ratio) * 2, 1.0) if ratio < 0.85 else 0.0
    turn, confidence = RotationAngle.NONE, 1.0
    if angle is None and config.use_aspect_fallback and ratio < 0.85 or angle is not None and 85 <= abs(angle) <= 95:
        turn, confidence = _quarter_turn(small, 90.0 if angle is None else angle, config)
    elif angle is not None and abs(angle) > 175:
        turn = RotationAngle.ROTATE_180
    return {"angle": int(turn), "confidence": float(confidence), "original_angle": float(angle or 0.0), "applied_rotation": turn != RotationAngle.NONE, "lying": lying}


def _quarter_turn(image: np.ndarray, angle: float, config: EngineConfig) -> tuple[RotationAngle, float]:
    cw, ccw, own = (orientation_score(apply_rotation(image, a)) for a in (90, -90, 0))
    diff = abs(cw - ccw)
    better = RotationAngle.CLOCKWISE_90 if cw > ccw else RotationAngle.COUNTER_CLOCKWISE_90
    ratio = image.shape[0] / image.shape[1]
    lying = min((0.85 - ratio) * 2, 1.0) if ratio < 0.85 else 0.0
    if max(cw, ccw) - own > 0.05:
        return better, min(diff + 0.3, 1.0)
    if config.rotate_aggressive_mode and 85 <= abs(angle) <= 95:
        wish, other, holds = (RotationAngle.COUNTER_CLOCKWISE_90, RotationAngle.CLOCKWISE_90, ccw >= cw) if angle < 0 else (RotationAngle.CLOCKWISE_90, RotationAngle.COUNTER_CLOCKWISE_90, cw >= ccw)
        return (wish, 0.7) if holds else (other, 0.6)
    if config.use_aspect_fallback and lying > 0.5:
        return better, lying
    return (RotationAngle.NONE, 0.5) if diff < config.min_score_diff else (better, min(diff, 1.0))


def auto_rotate(image: np.ndarray, config: EngineConfig = EngineConfig()) -> tuple[np.ndarray, dict]:
    found = detect_rotation(image, config)
    return apply_rotation(image, found["angle"]), found


def preprocess_for_ocr(image: np.ndarray, config: EngineConfig = EngineConfig()) -> np.ndarray:
    out = image.copy()
    if config.enable_rotate:
        out, _ = auto_rotate(out, config)
    out = enhance_contrast(normalize_height(out))
    return deskew(out, config.deskew_border) if config.enable_deskew else out


def preprocess_for_vlm(image: np.ndarray, config: EngineConfig = EngineConfig()) -> np.ndarray:
    out = image.copy()
    if config.enable_rotate:
        out, _ = auto_rotate(out, config)
    if config.enable_crop:
        out = crop(out, config)
    return adaptive_resize(out, config.post_crop_max_size) if out.size else out


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit PNG of a gray, BGR or BGRA raster, rows as they are."""
    colour = {2: 0, 3: 2 if image.shape[-1] == 3 else 6}[image.ndim]
    rows = image if image.ndim == 2 else image[..., [2, 1, 0, 3][: image.shape[2]]]
    h, w = image.shape[:2]
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rows.reshape(h, -1)), 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def encode_base64(image: np.ndarray, kind: str = "PNG", quality: int = 95) -> tuple[str, str]:
    """Base64 and MIME type. PNG is built in; JPEG and WEBP need an imaging library."""
    kind = kind.upper()
    if kind == "PNG":
        return base64.b64encode(encode_png(image)).decode(), "image/png"
    if kind not in ("JPEG", "JPG", "WEBP"):
        raise ValueError(f"format {kind} is not one of PNG, JPEG, JPG, WEBP")
    import io

    from PIL import Image  # optional

    rgb = image if image.ndim == 2 else image[..., 2::-1]
    out = io.BytesIO()
    Image.fromarray(rgb).convert("RGB").save(out, "WEBP" if kind == "WEBP" else "JPEG", quality=quality)
    return base64.b64encode(out.getvalue()).decode(), "image/webp" if kind == "WEBP" else "image/jpeg"
