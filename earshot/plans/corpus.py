"""Training corpus preparation: transcripts normalised, aligned and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import normalizer_for
from earshot.operators.manifest import attach_labels, crop_size, filter_manifest


def training_items(
    manifest: DataFrame,
    labels: DataFrame,
    dataset: str,
    min_size: int | None = 0,
    keys: list[str] = ["split", "line_no"],
) -> DataFrame:
    """FL-1, JN-1, TX-8, FL-5: one row per usable item with its transcript and size.

    Label lines of skipped manifest lines are dropped with them; any other unmatched
    line fails the job.
    """
    kept = filter_manifest(manifest, min_size)
    skipped = manifest.filter(F.col("n_frames") < min_size) if min_size is not None else None
    rest = labels if skipped is None else labels.join(skipped.select(*keys), keys, "left_anti")
    items = attach_labels(kept, rest.select(*keys, "text"), keys)
    return items.withColumns(
        {"transcript": normalizer_for(dataset, "text"), "size": crop_size("n_frames")}
    )
