"""Tokenizers by name, as columns: one is made in each worker, rows come batch by batch."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.types import ArrayType, IntegerType, StringType

from millrace.batches import by_pieces, lists


class Tokenizer(ABC):
    """What the pipeline asks of a tokenizer."""

    @property
    @abstractmethod
    def vocab_size(self) -> int: ...

    @property
    def eod(self) -> int:
        """The id that ends a document."""
        raise NotImplementedError(f"{type(self).__name__} has no end of document")

    @abstractmethod
    def tokenize(self, text: str) -> list[int]: ...

    def detokenize(self, ids: list[int]) -> str:
        raise NotImplementedError(f"{type(self).__name__} can't be undone")


class Bytes(Tokenizer):
    """A token a byte of UTF-8, and one for the end."""

    vocab_size, eod = 257, 256

    def tokenize(self, text: str) -> list[int]:
        return list(text.encode())

    def detokenize(self, ids: list[int]) -> str:
        own = np.asarray(ids, np.int64)
        return own[own < 256].astype(np.uint8).tobytes().decode("utf-8", errors="replace")


class Json(Tokenizer):
    """A tokenizer file of the tokenizers library, by its content."""

    def __init__(self, raw: bytes, eod: int = 0):
        from tokenizers import Tokenizer as Library

        self.own, self._eod = Library.from_buffer(raw), eod

    @property
    def vocab_size(self) -> int:
        return self.own.get_vocab_size()

    @property
    def eod(self) -> int:
        return self._eod

    def tokenize(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def detokenize(self, ids: list[int]) -> str:
        return self.own.decode(ids)


class Pieces(Tokenizer):
    """A SentencePiece model, by its content."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)

    @property
    def vocab_size(self) -> int:
        return self.own.get_piece_size()

    @property
    def eod(self) -> int:
        return self.own.eos_id()

    def tokenize(self, text: str) -> list[int]:
        return self.own.encode(text)

    def detokenize(self, ids: list[int]) -> str:
        return self.own.decode(ids)


#: Kinds of tokenizers; more may be added.
TOKENIZERS: dict[str, Callable[..., Tokenizer]] = {"bytes": Bytes, "json": Json, "pieces": Pieces}

_made: dict[tuple, Tokenizer] = {}


def _of(kind: str, options: tuple) -> Tokenizer:
    if (kind, options) not in _made:
        _made.clear()
        _made[kind, options] = TOKENIZERS[kind](**dict(options))
    return _made[kind, options]


def encoded(text: Column, kind: str, end: bool = True, **options) -> Column:
    """The ids of a text, with the end of document after them; a null text has none but that."""
    own = tuple(sorted(options.items()))

    @by_pieces(ArrayType(IntegerType()), once=True)
    def run(s: pa.Array) -> pa.Array:
        t = _of(kind, own)
        ids = [np.array([*t.tokenize(x or ""), *([t.eod] if end else [])], np.int32) for x in s.to_pylist()]
        return lists(np.concatenate([np.zeros(0, np.int32), *ids]), [len(i) for i in ids])

    return run(text)


def decoded(ids: Column, kind: str, **options) -> Column:
    own = tuple(sorted(options.items()))

    @by_pieces(StringType(), once=True)
    def run(ids: pa.Array) -> pa.Array:
        t = _of(kind, own)
        return pa.array([t.detokenize(x.as_py() if kind != "bytes" else x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in ids], pa.string())

    return run(ids)
