"""A language model as a stage of a pipeline: messages in, reply out.

Backends implement ``ask(messages, format, temperature, stream, **options)``. A stage builds its
backend once per partition, asks row by row in Arrow batches and isolates errors per row. Replies
are not deterministic in general, so a stage is a barrier for the optimizer; materialise it before
it is read twice.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

Message = dict[str, Any]


class Backend(Protocol):
    def ask(self, messages: list[Message], format: str = "", temperature: float = 0.8, stream: bool = False, **options: Any) -> str | Iterator[str]: ...


def require_backend(backend: object) -> None:
    """Early check, on the driver, that an object can be asked."""
    if not callable(getattr(backend, "ask", None)):
        raise TypeError("a backend needs a method ask(messages, ...)")


class Rule:
    """Replies computed by a function of the messages: for tests and offline runs."""

    def __init__(self, reply: Callable[[list[Message]], str]) -> None:
        self.reply = reply

    def ask(self, messages, format="", temperature=0.8, stream=False, **options):
        text = self.reply(messages)
        return iter(text.split(" ")) if stream else text


class Scripted(Rule):
    """The same reply to everything."""

    def __init__(self, text: str) -> None:
        super().__init__(lambda _: text)


class HttpChat:
    """A chat server that takes and gives JSON."""

    def __init__(self, model: str, host: str = "http://localhost:11434", timeout: float = 120.0) -> None:
        if not model:
            raise ValueError("a model name is needed")
        self.model, self.host, self.timeout = model, host.rstrip("/"), timeout

    def ask(self, messages, format="", temperature=0.8, stream=False, **options):
        body = {"model": self.model, "messages": [{k: v for k, v in m.items() if v is not None} for m in messages], "stream": stream, "options": {"temperature": temperature, **options}}
        if format:
            body["format"] = format
        req = urllib.request.Request(f"{self.host}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        if not stream:
            with urllib.request.urlopen(req, timeout=self.timeout) as r:
                return json.load(r)["message"]["content"]
        return self._lines(req)

    def _lines(self, req) -> Iterator[str]:
        with urllib.request.urlopen(req, timeout=self.timeout) as r:
            for line in r:
                if line.strip():
                    yield json.loads(line)["message"]["content"]


def collected(stream: Iterator) -> str:
    """A streamed reply as one text; pieces may be texts or messages."""
    return "".join(x["message"]["content"] if type(x) is dict else x for x in stream)


def with_model(df: DataFrame, messages_col: str, backend: Backend | Callable[[], Backend], out_col: str = "reply", format: str = "", temperature: float = 0.8, **options: Any) -> DataFrame:
    """``df`` with ``out_col`` (null on failure) and ``<out_col>_error``; rows without messages are not asked."""
    make = backend if callable(backend) and not hasattr(backend, "ask") else (lambda: backend)
    if hasattr(backend, "ask"):
        require_backend(backend)
    err = f"{out_col}_error"
    keep = [c for c in df.columns if c not in (out_col, err)]
    src = df.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            replies, errors = [], []
            for messages in b.column(b.schema.get_field_index(messages_col)).to_pylist():
                reply = error = None
                if messages:
                    try:
                        clean = [{k: v for k, v in m.items() if v is not None} for m in messages]
                        reply = model.ask(clean, format=format, temperature=temperature, **options)
                        reply = reply if isinstance(reply, str) else collected(reply)
                    except Exception as e:  # one bad row must not end the job
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, out_col, err])

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField(out_col, StringType()), StructField(err, StringType())]))


def streamed(df: DataFrame, messages_col: str, backend: Backend | Callable[[], Backend], keys: tuple[str, ...] = ("conv_id", "turn"), format: str = "", temperature: float = 0.8, **options: Any) -> DataFrame:
    """``(keys, seq, chunk, done)``: the pieces of each streamed reply, as a message log takes them.

    The pieces of a reply are counted from 0 and the last has ``done``; a reply that fails keeps the
    pieces that came and is never done; rows without messages give no pieces.
    """
    make = backend if callable(backend) and not hasattr(backend, "ask") else (lambda: backend)
    if hasattr(backend, "ask"):
        require_backend(backend)
    src = df.select(*keys, messages_col)
    fields = [src.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            at, seq, chunks, done = [], [], [], []
            for i, messages in enumerate(b.column(len(keys)).to_pylist()):
                if not messages:
                    continue
                n, whole = 0, False
                try:
                    clean = [{k: v for k, v in m.items() if v is not None} for m in messages]
                    got = model.ask(clean, format=format, temperature=temperature, stream=True, **options)
                    for piece in [got] if isinstance(got, str) else got:
                        at.append(i)
                        seq.append(n)
                        chunks.append(piece["message"]["content"] if type(piece) is dict else piece)
                        done.append(False)
                        n += 1
                    whole = True
                except Exception:  # one bad row must not end the job
                    pass
                if n and whole:
                    done[-1] = True
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[:-1]), pa.array(seq, pa.int64()), pa.array(chunks, pa.string()), pa.array(done, pa.bool_())], names=[*keys, "seq", "chunk", "done"])

    return src.mapInArrow(run, StructType([*fields, StructField("seq", LongType()), StructField("chunk", StringType()), StructField("done", BooleanType())]))
