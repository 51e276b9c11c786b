"""Audio header scan (SRC-3)."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# A WAV header nearly always lies in here; files where it does not are read whole.
HEAD_BYTES = 4096

_HEADER = StructType(
    [
        StructField("sample_rate", LongType()),
        StructField("n_frames", LongType()),
        StructField("error", StringType()),
    ]
)


def wav_header(data: bytes | None):
    """(sample rate, frames, error) of a PCM WAV file, from its leading bytes."""
    if data is None:
        return None, None, None
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.getframerate(), w.getnframes(), None
    except (wave.Error, EOFError) as e:
        return None, None, str(e) or "truncated header"


@F.pandas_udf(_HEADER)
def _parse(data: pd.Series) -> pd.DataFrame:
    rows = [wav_header(d) for d in data]
    out = pd.DataFrame(rows, columns=["sample_rate", "n_frames", "error"])
    return out.astype({"sample_rate": "Int64", "n_frames": "Int64"})


def parse_wav(content) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return _parse(c)


def scan_audio(spark: SparkSession, path, glob: str = "*.wav") -> DataFrame:
    """SRC-3: ``path, n_bytes, sample_rate, n_frames, duration_s, error`` per WAV file.

    Only the leading bytes of each file go to Python. A file whose header reaches
    further is parsed from its whole content in a second step, and a file that is no
    WAV keeps its row with the reason in ``error``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )
    head = files.withColumn("_h", parse_wav(F.substring("content", 1, HEAD_BYTES)))
    again = F.when(
        F.col("_h.error").isNotNull() & (F.col("length") > HEAD_BYTES), F.col("content")
    )
    both = head.withColumn("_w", parse_wav(again))
    use_whole = F.col("_h.error").isNotNull() & (F.col("length") > HEAD_BYTES)

    def pick(name):
        return F.when(use_whole, F.col(f"_w.{name}")).otherwise(F.col(f"_h.{name}"))

    return both.select(
        "path",
        F.col("length").alias("n_bytes"),
        pick("sample_rate").alias("sample_rate"),
        pick("n_frames").alias("n_frames"),
        pick("error").alias("error"),
    ).withColumn("duration_s", F.try_divide(F.col("n_frames").cast("double"), F.col("sample_rate")))
