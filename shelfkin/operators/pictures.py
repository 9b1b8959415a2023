"""Numpy helpers for one decoded picture, called inside Spark tasks."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

# The picture size models expect and the per-channel scaling (R, G, B).
SHORT_SIDE = 256
CROP = 224
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]

GRID = 4


def rgb(image: Mapping) -> np.ndarray:
    """(height, width, 3) bytes from Spark's image struct, whose pixels are BGR."""
    height, width, channels = image["height"], image["width"], image["nChannels"]
    pixels = np.frombuffer(image["data"], dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def resize_weights(old: int, new: int) -> np.ndarray:
    """(new, old) bilinear weights; shrinking averages over the pixels it skips."""
    scale = old / new
    reach = max(scale, 1.0)
    centre = (np.arange(new)[:, None] + 0.5) * scale
    weights = np.maximum(0.0, 1.0 - np.abs(np.arange(old)[None, :] + 0.5 - centre) / reach)
    return weights / weights.sum(axis=1, keepdims=True)


def standard_tensor(image: Mapping) -> np.ndarray:
    """(3, 224, 224): short side to 256, centre crop, 0..1, scaled per channel.

    Only the rows and columns inside the crop are computed; columns first, whole
    bytes after each pass.
    """
    pixels = rgb(image).astype(np.float32)
    height, width = pixels.shape[:2]
    if height <= width:
        target = (SHORT_SIDE, int(SHORT_SIDE * width / height))
    else:
        target = (int(SHORT_SIDE * height / width), SHORT_SIDE)
    top, left = (int(round((side - CROP) / 2.0)) for side in target)
    across = resize_weights(width, target[1])[left : left + CROP].astype(np.float32)
    down = resize_weights(height, target[0])[top : top + CROP].astype(np.float32)
    narrow = np.clip(np.rint(across @ pixels), 0, 255)
    crop = np.clip(np.rint((down @ narrow.reshape(height, -1)).reshape(CROP, CROP, 3)), 0, 255) / np.float32(255)
    scaled = (crop - np.float32(CHANNEL_MEAN)) / np.float32(CHANNEL_STD)
    return np.ascontiguousarray(scaled.transpose(2, 0, 1))


def colour_grid(tensor: np.ndarray) -> np.ndarray:
    """Mean and deviation of each channel in each cell of a 4 x 4 grid."""
    channels, side = tensor.shape[0], tensor.shape[1] // GRID
    cells = tensor.reshape(channels, GRID, side, GRID, side)
    exact = {"axis": (2, 4), "dtype": np.float64}
    return np.concatenate([cells.mean(**exact).ravel(), cells.std(**exact).ravel()])
