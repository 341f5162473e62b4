"""Sub-word ids of a given SentencePiece model, as Arrow UDFs.

The model's path is a parameter; each Python worker loads it once.  Tokenizers are used, never trained.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

_loaded: dict = {}


def processor(path: str):
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def special_ids(path: str) -> dict[str, int]:
    p = processor(path)
    return {"pad": p.pad_id(), "unknown": p.unk_id(), "bos": p.bos_id(), "eos": p.eos_id(), "size": p.vocab_size()}


def encode(x: Column, path: str, bos: bool = True, eos: bool = True) -> Column:
    """Ids of a text, between the ids of its begin and end; null for null."""

    def ids(texts: pd.Series) -> pd.Series:
        p = processor(path)
        found = iter(p.encode(texts.dropna().tolist(), num_threads=1))
        edge = lambda on, i: [i] if on else []
        return pd.Series([None if t is None else edge(bos, p.bos_id()) + next(found) + edge(eos, p.eos_id()) for t in texts], dtype=object)

    return F.pandas_udf(ids, ArrayType(IntegerType()))(x)


def pieces(x: Column, path: str) -> Column:
    def found(texts: pd.Series) -> pd.Series:
        p = processor(path)
        return pd.Series([None if t is None else p.encode(t, out_type=str) for t in texts], dtype=object)

    return F.pandas_udf(found, ArrayType(StringType()))(x)


def decode(ids: Column, path: str) -> Column:
    """The text of ids; those of padding, begin and end are left out by a built-in filter first."""
    marks = [v for k, v in special_ids(path).items() if k in ("pad", "bos", "eos") and v >= 0]
    kept = F.filter(ids, lambda i: ~i.isin(marks)) if marks else ids

    def text(rows: pd.Series) -> pd.Series:
        p = processor(path)
        return pd.Series([None if r is None else p.decode([int(i) for i in r]) for r in rows], dtype=object)

    return F.pandas_udf(text, StringType())(kept)
