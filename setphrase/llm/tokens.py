"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words.

The word BPE of ``word_bpe_49k.json`` lower-cases, drops white space and never merges across
its pre-tokens, so the ids of a text are those of its pre-tokens in order. Each worker keeps
the ids of words it has met; only new words reach the library's model, past its normaliser and
pre-tokenizer. A text with a character outside ``SAFE`` (where its normaliser does more than
lower-case), or with one of the tokenizer's special tokens, is encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setphrase.llm.common import whole_texts

TOKENIZER = "word_bpe_49k.json"
SAFE = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xff]*")
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
CACHED = 400_000
_encoders: dict[tuple[str, int], WordEncoder] = {}


class _Cache(dict):
    """Values made on demand. Past ``most`` keys a generation becomes the old one, from which what is met again is taken over."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """ids(texts): little-endian unsigned 16-bit ids of each text, as bytes."""

    def __init__(self, path: str, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=True)
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids above 65535 don't fit the 16-bit layout")
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model, self.codes = self.lib.model, [i.to_bytes(2, "little") for i in range(max(vocab.values()) + 1)]
        self.words, self.pieces = _Cache(self._word, cached // 6), _Cache(self._piece, cached // 2)

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _word(self, word: str) -> bytes:
        # the model knows words by their bytes, each a character; ASCII stands for itself
        found = self.model.tokenize(word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0])
        return self.codes[found[0].id] if len(found) == 1 else b"".join([self.codes[t.id] for t in found])

    def _piece(self, piece: str) -> bytes:
        parts = PRETOKEN.findall(piece)
        return self.words[parts[0]] if len(parts) == 1 else b"".join([self.words[w] for w in parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        get, out = self.pieces.__getitem__, []
        for text in texts:
            plain = SAFE.fullmatch(text) and not any(t in text for t in self.special)
            out.append(b"".join(map(get, text.lower().split())) if plain else self.whole(text))
            self.pieces.turn()
            self.words.turn()
        return out


def encoder(name: str = TOKENIZER, cached: int = CACHED) -> WordEncoder:
    """The worker's own encoder; name is a public file's name, or a path."""
    if (name, cached) not in _encoders:
        import public_tokenizers

        _encoders[name, cached] = WordEncoder(name if os.path.exists(name) else public_tokenizers.path(name), cached)
    return _encoders[name, cached]


def some(texts: list[str | None], chars: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null: empty) with about so many characters, each with its first index; a text is never cut."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= chars:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


def encode(docs: DataFrame, end_id: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, cached: int = CACHED) -> DataFrame:
    """Rows (doc, n, ids): the 16-bit ids of each whole text (null: empty) and then end_id; n counts both."""
    tail = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cached)
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1).to_pylist()
            for first, part in some(texts):
                ids = [x + tail for x in enc.ids(part)]
                n = pa.array([len(x) // 2 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([docs_.slice(first, len(part)), n, pa.array(ids, pa.binary())], ["doc", "n", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return whole_texts(source).mapInArrow(run, "doc long, n long, ids binary")
