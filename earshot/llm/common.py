"""What the operators share: files in the shared folder, objects kept per Python worker, words."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.session import settle, shared_dir

__all__ = ["TOKENIZER", "columns_free", "file_system", "give_back", "kept", "remainder", "settle", "shared_dir", "table", "words_of"]

# White space that parts words, the tokenizer file and its end-of-document id.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
LOWER = {c: c + 32 for c in range(65, 91)}

_word = re.compile(WORD)


def words_of(text: str | None) -> list[str]:
    """Words of one text inside a task; none for null."""
    return _word.findall(text) if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(key: Column, by: int) -> Column:
    """crc32 of a key as text, modulo ``by``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def kept(name: str, make: Callable[[], Any]) -> Any:
    """An object made once per Python worker: tokenizers and caches of words outlive a task."""
    store = sys.modules.setdefault("earshot_llm_worker", types.ModuleType("earshot_llm_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def give_back() -> None:
    """Returns memory that Arrow and the C library hold for later: Python workers outlive a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def file_system(path: str):
    """The Arrow file system of a folder and the folder's name there; works for any scheme Arrow knows."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def columns_free(df: DataFrame, *names: str) -> None:
    """Stops when an operator would overwrite a column that the caller has."""
    clash = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if clash:
        raise ValueError(f"columns {clash} exist already")
