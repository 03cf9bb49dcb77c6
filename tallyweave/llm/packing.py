"""Harmonic packing of tokenised documents into training sequences.

Class k holds pieces with capacity/(k+1) < length <= capacity/k, and a bin of class k is closed as soon as it holds k pieces.
Documents are cut so that all but short tails are exactly capacity/k long for a power of two k: such bins close full.
Each partition fills its own bins in one pass, without a shuffle, holding fewer than k pieces of each class. What is left open
at its end is cut anew into whole sequences and powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id

CAPACITY = 1024
#: Tails shorter than this share of the capacity are not cut further.
TAIL_SHARE = 16
END_ID = 0
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict = {}


def encoder(path: str, special: bool = True):
    """A function from texts to lists of ids, from a file of `tokenizers` (.json). Loaded once a worker.

    special: the file's added tokens, such as <|endoftext|>, are one id wherever their string stands, as in a plain call of that library;
    else their strings are ordinary text. Where the same vocabulary lies beside it as ranks for tiktoken, which is faster, that library
    encodes, with the same added tokens.
    """
    key = (path, special)
    if key not in _encoders:
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens", [])
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) or t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        if os.path.exists(ranks_file) and plain:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            tokens = {t["content"]: t["id"] for t in added} if special else {}
            coding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=tokens)
            _encoders[key] = lambda texts: (_ids(coding, t, path, special) for t in texts)
        else:
            _encoders[key] = _plain(path, special)
    return _encoders[key]


def _plain(path: str, special: bool):
    """encoder() by `tokenizers` itself."""
    key = (path, special, "plain")
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not special
        _encoders[key] = lambda texts: (e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False))
    return _encoders[key]


def _ids(coding, text: str, path: str, special: bool) -> list[int]:
    """A text's ids; what tiktoken's pattern cannot split, such as a million blanks, is left to `tokenizers`."""
    try:
        return coding.encode(text, allowed_special="all", disallowed_special=())
    except ValueError:
        return next(iter(_plain(path, special)([text])))


def cuts(n: int, capacity: int, tail: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, then powers of two down to tail, then the rest."""
    out, at, size = [], 0, capacity
    while n - at:
        if n - at >= size:
            out.append((at, size))
            at += size
        elif size > tail:
            size //= 2
        else:
            out.append((at, n - at))
            at = n
    return out


class Bins:
    """The open bins of one worker."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next, self.open, self.rows = capacity, first_id, {}, []

    def emit(self, pieces: list, ids: bool = True) -> None:
        at = 0
        for doc, start, part, total in pieces:
            self.rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), total, self.next, at))
            at += len(part)
        self.next += 1

    def add(self, doc: int, start: int, part: np.ndarray, total: int) -> None:
        k = self.capacity // len(part)
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc, start, part, total))
        if len(bin_) == k:
            self.emit(self.open.pop(k))

    def finish(self) -> None:
        """Runs of the pieces left, cut at whole sequences and then at powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        n, size, bin_, room = sum(len(p[2]) for p in left), self.capacity, [], 0
        for doc, start, part, total in left:
            while len(part):
                if not room:
                    while size > n:
                        size //= 2
                    room = size
                take = part[:room]
                bin_.append((doc, start, take, total))
                start, part, room, n = start + len(take), part[len(take) :], room - len(take), n - len(take)
                if not room:
                    self.emit(bin_)
                    bin_ = []

    def flush(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=["doc_id", *(c.split()[0] for c in PIECES.split(", "))])
        self.rows = []
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, special: bool = True) -> DataFrame:
    """One row per piece: every id of every document, its end id included, lies in exactly one piece.

    A null or empty text is one end id. Rows with repeated ids are packed each. sequence_id is unique over all workers: the
    partition's number times 2**32 plus a counter. A task that runs again gives the same pieces. An empty table gives no rows.
    """

    def each(batches):
        context = TaskContext.get()
        bins = Bins(capacity, (context.partitionId() if context else 0) << 32)
        encode = encoder(tokenizer_path, special)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for at in range(0, len(texts), 64):
                for doc, own in zip(b["doc_id"][at : at + 64], encode(texts[at : at + 64]), strict=True):
                    ids = np.array([*own, END_ID], "<u4")
                    for start, n in cuts(len(ids), capacity, max(1, capacity // TAIL_SHARE)):
                        bins.add(doc, start, ids[start : start + n], len(ids))
            yield bins.flush()
        bins.finish()
        yield bins.flush()

    return by_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), each, PIECES, "doc_id")


def op2(spark, sf_dir):
    """Pieces of all documents in sequences of 1024 tokens. Repeated ids are packed each; an empty table gives none."""
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
