"""Modality weights: how switches and a percent slider become two weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the weight of either modality when the caller names none.
DEFAULT_WEIGHT = 0.5


def resolve_weights(use_text: Column, use_image: Column, percent: Column) -> Column:
    """struct(text_weight, image_weight) for one settings row.

    Both on: the slider splits 100 percent.  One on: it gets everything.  None on:
    text alone.  A switch that is null is on, a slider that is null stands in the middle.
    """
    use_text, use_image = F.coalesce(use_text, F.lit(True)), F.coalesce(use_image, F.lit(True))
    percent = F.coalesce(percent, F.lit(100 * DEFAULT_WEIGHT))
    both = use_text & use_image
    text = F.when(both, percent / F.lit(100.0)).when(use_image & ~use_text, F.lit(0.0)).otherwise(F.lit(1.0))
    image = F.when(both, (F.lit(100) - percent) / F.lit(100.0)).when(
        use_image & ~use_text, F.lit(1.0)
    ).otherwise(F.lit(0.0))
    return F.struct(text.alias("text_weight"), image.alias("image_weight"))


def switched_weights(
    use_text: bool,
    use_image: bool,
    text_weight: float = DEFAULT_WEIGHT,
    image_weight: float = DEFAULT_WEIGHT,
    strict: bool = False,
) -> tuple[float, float]:
    """Weights of a single call; a switched-off modality weighs nothing."""
    if strict:
        if not (0.0 <= text_weight <= 1.0 and 0.0 <= image_weight <= 1.0):
            raise ValueError(f"weights must lie in 0..1: {text_weight}, {image_weight}")
        if abs(text_weight + image_weight - 1.0) > 1e-9:
            raise ValueError(f"weights must sum to 1: {text_weight} + {image_weight}")
    if not use_text and not use_image:
        return 1.0, 0.0
    return (text_weight if use_text else 0.0), (image_weight if use_image else 0.0)
