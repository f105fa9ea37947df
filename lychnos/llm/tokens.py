"""Encoding of a corpus with a public tokenizer, and decoding from raw bytes.

Default: the tiktoken library with a local rank file. Long texts are cut before encoding at safe
boundaries, places where no pre-token can span: before a run of white space that follows a
non-space character. Encoding the pieces one after the other gives the ids of the whole text.

Defined results: null and empty texts give an empty list; blank texts give the ids of their white
space; special tokens are never produced, their strings are ordinary text; ids decode to the exact
bytes of the text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every function here.
VOCABULARIES = "/opt/tokenizers"
#: Texts longer than this many characters are encoded in pieces.
PIECE_CHARS = 65_536

#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SAFE = re.compile(r"(?<=\S)(?=\s)")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut at safe boundaries into pieces of about ``size`` characters; a stretch without white space stays whole."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


@lru_cache(maxsize=8)
def encoder(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to id lists, made once per worker."""
    tik = os.path.join(folder, f"{name}.tiktoken")
    if os.path.exists(tik):
        enc = _tiktoken(tik)

        def run(texts: list[str]) -> list[list[int]]:
            out = []
            for t in texts:
                if len(t) <= PIECE_CHARS:
                    out.append(enc.encode_ordinary(t))
                else:
                    out.append([i for p in safe_pieces(t) for i in enc.encode_ordinary(p)])
            return out

        return run
    js = os.path.join(folder, f"{name}.json")
    if os.path.exists(js):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(js)
        tok.encode_special_tokens = True
        return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
    return lambda texts: sp.encode(texts, num_threads=1) if texts else []


@lru_cache(maxsize=4)
def _tiktoken(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, out_col: str = "ids") -> DataFrame:
    """``(id_col, out_col)``: the token ids of each text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            texts = b.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            got: list[list[int]] = [[] for _ in texts]
            for i, ids in zip(some, enc([texts[i] for i in some]), strict=True):
                got[i] = ids
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=[id_col, out_col])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` array<int>")


def count_tokens(df: DataFrame, text_col: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``keep`` columns and ``n_tokens``; no id list leaves the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = [0] * len(texts)
            some = [i for i, t in enumerate(texts) if t]
            for i, ids in zip(some, enc([texts[i] for i in some]), strict=True):
                n[i] = len(ids)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint"
    return df.select(*keep, F.col(text_col).alias("text__")).mapInArrow(run, schema)


@lru_cache(maxsize=8)
def decoder(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Callable[[list[int]], str]:
    """A function from ids to text: raw bytes read as UTF-8 for byte-level vocabularies, else as the library joins the pieces."""
    tik = os.path.join(folder, f"{name}.tiktoken")
    if os.path.exists(tik):
        enc = _tiktoken(tik)
        return lambda ids: enc.decode_bytes(ids).decode("utf-8", errors="replace")
    js = os.path.join(folder, f"{name}.json")
    if os.path.exists(js):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(js)
        return lambda ids: tok.decode(ids, skip_special_tokens=False)
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model")).decode


def decode(df: DataFrame, id_col: str, ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES, out_col: str = "text") -> DataFrame:
    """``(id_col, out_col)``: the texts that the ids stand for, joined as raw bytes, then read as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = decoder(name, folder)
        for b in batches:
            got = [read(ids) if ids else "" for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=[id_col, out_col])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` string")
