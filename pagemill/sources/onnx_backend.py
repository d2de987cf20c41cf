"""The default recogniser: a detector of text and a reader of lines, both ONNX models, on the CPU.

The detector gives a map of how likely each place is text; connected places above a threshold are boxes, grown by a share
of their area over their outline. Each box is read by the second model, whose best characters, repeats and blanks
dropped, are the line.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np

from ..functions import kernels

LONGEST, TEXT, SURE, GROWN, LINE_HEIGHT = 1536, 0.3, 0.5, 1.6, 48
_MEAN, _SPREAD = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


def boxes(chance: np.ndarray) -> list[tuple[int, int, int, int]]:
    """top, bottom, left, right (half open) of the text in a map of chances."""
    row, first, last, label, n = kernels.components(chance > TEXT)
    h, w = chance.shape
    sums = np.concatenate((np.zeros((h, 1)), np.cumsum(chance, 1)), 1)
    out = []
    for k in range(int(n)):
        own = label == k
        top, bottom, left, right = int(row[own].min()), int(row[own].max()) + 1, int(first[own].min()), int(last[own].max()) + 1
        places = (last[own] - first[own] + 1).sum()
        mean = (sums[row[own], last[own] + 1] - sums[row[own], first[own]]).sum() / places
        if min(bottom - top, right - left) < 3 or mean < SURE:
            continue
        grow = round((bottom - top) * (right - left) * GROWN / (2 * (bottom - top + right - left)))
        out.append((max(0, top - grow), min(h, bottom + grow), max(0, left - grow), min(w, right + grow)))
    return out


def read(chances: np.ndarray, letters: list[str]) -> tuple[str, float]:
    """Text and mean chance of a line from (place, letter); letter 0 stands between letters."""
    best = chances.argmax(1)
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    at = np.flatnonzero(new & (best > 0))
    return "".join(letters[k] for k in best[at]), float(chances[at, best[at]].mean()) if len(at) else 0.0


def recognize(image: np.ndarray, detect: Callable, recognise: Callable, letters: list[str]) -> list:
    """(corners, text, chance) of each line of a BGR image."""
    h, w = image.shape[:2]
    scale = min(1.0, LONGEST / max(h, w))
    small = kernels.resize(image, max(32, round(h * scale / 32) * 32), max(32, round(w * scale / 32) * 32), "linear")
    chance = detect(((small.astype(np.float32) / 255 - _MEAN) / _SPREAD).transpose(2, 0, 1)[None])[0, 0]
    out = []
    for top, bottom, left, right in boxes(chance):
        a, b, c, d = (int(v * s) for v, s in ((top, h / chance.shape[0]), (bottom, h / chance.shape[0]), (left, w / chance.shape[1]), (right, w / chance.shape[1])))
        line = image[a : max(b, a + 1), c : max(d, c + 1)]
        line = kernels.resize(line, LINE_HEIGHT, max(8, round(line.shape[1] * LINE_HEIGHT / line.shape[0])), "linear")
        text, sure = read(recognise((line.astype(np.float32) / 127.5 - 1).transpose(2, 0, 1)[None])[0], letters)
        if text and sure >= SURE:
            out.append(([[c, a], [d, a], [d, b], [c, b]], text, sure))
    return out


def load(files: dict[str, Path]) -> Callable[[np.ndarray], list]:
    import onnxruntime  # optional

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1

    def runner(path: Path) -> Callable[[np.ndarray], np.ndarray]:
        model = onnxruntime.InferenceSession(str(path), options, providers=["CPUExecutionProvider"])
        name = model.get_inputs()[0].name
        return lambda x: model.run(None, {name: x})[0]

    detect, recognise = runner(files["detector"]), runner(files["recognizer"])
    letters = ["", *files["characters"].read_text("utf-8").splitlines(), " "]
    return lambda image: recognize(image, detect, recognise, letters)
