"""SentencePiece BPE encoding and decoding as a streaming lattice search.

The vocabulary is a byte-fallback BPE model, so the right segmentation is not the one with the best sum of scores but
the one that its merges give.  It is still found left to right: every prefix of a text has exactly one encoding, and a
piece may follow another only if merging the two together gives back just these two.  At each boundary the search keeps
the one backpointer whose piece is compatible with the piece before it, in a window no longer than the longest piece.
When the paths of all boundaries in the window run through one boundary, everything before it is final and its ids
are committed.  A boundary before a blank that follows another character is always such a point, because no piece
spans it; texts are cut there and repeated words are looked up in a bounded cache.

Texts are encoded alone, in batches, without a shuffle.

Defined cases: a null or empty text gives no ids; repeated rows each get a row; unknown characters become byte pieces;
bytes that are no UTF-8 decode to the replacement character; an empty table gives an empty result; further columns are
not read by ``encode`` and kept by ``with_ids``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BLANK = "▁"
#: Words in each of two generations, and pairs of pieces and prefixes, remembered per worker; an entry takes some 200 bytes.
CACHE, PAIRS = 400_000, 600_000


class Pieces:
    """The vocabulary and the compatibility of neighbouring pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {i: int(self.text[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.id = {p: i for i, p in enumerate(self.text) if i not in set(special)}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.endings = {p[i:] for p in self.id for i in range(len(p))}
        self.compatible_pairs: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, str] = {}
        # Ids of words as the bytes of 32-bit integers.  A full generation becomes the old one, so frequent words stay.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        # What a piece adds to a text; a byte of ASCII is a character of its own.
        self.shown = [chr(self.bytes[i]) if i in self.bytes and self.bytes[i] < 128 else p.replace(BLANK, " ") for i, p in enumerate(self.text)]
        self.shown[0] = self.shown[1] = self.shown[2] = ""  # unknown, begin and end carry no text
        self.part_bytes = {i for i, b in self.bytes.items() if b >= 128}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short string: merge the best neighbours, leftmost first, until none is in the vocabulary."""
        parts = list(symbols)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left`` (empty at the beginning of a text)."""
        pairs = self.compatible_pairs
        known = pairs.get((left, right))
        if known is None:
            if len(pairs) >= PAIRS:
                pairs.clear()
            known = pairs[left, right] = self.merged([*left, *right]) == ([left, right] if left else [right])
        return known


def segments(pieces: Pieces, text: str) -> Iterator[list[str]]:
    """Committed runs of pieces of ``text``; their concatenation is its encoding, single characters may be unknown."""
    last = [""]  # last[i]: the piece that ends the encoding of the first i characters of the window
    size, known, endings, fits = 0, pieces.id, pieces.endings, pieces.compatible_pairs
    for end in range(1, len(text) + 1):
        size += 1
        chosen = text[end - 1]
        if size > 1:
            options = []
            for length in range(1, size + 1):
                piece = text[end - length : end]
                if piece not in endings:
                    break
                if piece in known:
                    options.append(piece)
            for piece in reversed(options):
                before = last[size - len(piece)]
                fit = fits.get((before, piece))
                if fit if fit is not None else pieces.compatible(before, piece):
                    chosen = piece
                    break
        last.append(chosen)
        # Boundaries on the path of every boundary that a later piece can still start from.
        if size >= 4 * pieces.longest:
            alive = {size - back for back in range(pieces.longest)}
            while len(alive) > 1:
                latest = max(alive)
                alive.remove(latest)
                alive.add(latest - len(last[latest]))
            root = alive.pop()
            if root > 0:
                yield _path(last, root)
                # The piece before the root stays known, as the left neighbour of what follows.
                last = [last[root], *last[root + 1 :]]
                size -= root
    done = _path(last, len(last) - 1)
    if done:
        yield done


def _path(last: list[str], at: int) -> list[str]:
    out = []
    while at > 0:
        out.append(last[at])
        at -= len(last[at])
    return out[::-1]


def ids_of(pieces: Pieces, parts: list[str]) -> list[int]:
    out: list[int] = []
    for part in parts:
        known = pieces.id.get(part)
        if known is not None:
            out.append(known)
        else:
            out += [pieces.byte_id[b] for b in part.encode("utf-8", "replace")]
    return out


# A run of blanks and the word after it: no piece holds a blank after another character.
_WORD = re.compile(f"{BLANK}*[^{BLANK}]*")


def last_piece(pieces: Pieces, prefix: str) -> str:
    """The backpointer at the end of a short prefix: the piece that ends its encoding.

    The same choice as in ``segments``, made only for the boundaries that it asks for and remembered for other words.
    """
    held = pieces.prefixes
    known = held.get(prefix)
    if known is not None:
        return known
    options, size = [], len(prefix)
    for length in range(1, size + 1):
        piece = prefix[size - length :]
        if piece not in pieces.endings:
            break
        if piece in pieces.id:
            options.append(piece)
    chosen = prefix[-1]
    for piece in reversed(options):
        rest = prefix[: size - len(piece)]
        before = last_piece(pieces, rest) if rest else ""
        fit = pieces.compatible_pairs.get((before, piece))
        if fit if fit is not None else pieces.compatible(before, piece):
            chosen = piece
            break
    if len(held) >= PAIRS:
        held.clear()
    held[prefix] = chosen
    return chosen


def word_ids(pieces: Pieces, word: str) -> bytes:
    """Ids of one word, found in the cache or by the search."""
    found = pieces.old_words.get(word)
    if found is None:
        if len(word) <= 64:
            parts, rest = [], word
            while rest:
                parts.append(last_piece(pieces, rest))
                rest = rest[: len(rest) - len(parts[-1])]
            parts.reverse()
        else:
            parts = [p for run in segments(pieces, word) for p in run]
        found = np.array(ids_of(pieces, parts), np.int32).tobytes()
    if len(word) <= 64:
        if len(pieces.words) >= CACHE:
            pieces.old_words, pieces.words = pieces.words, {}
        pieces.words[word] = found
    return found


def encode_bytes(pieces: Pieces, text: str) -> bytes:
    """Ids of a text as the bytes of 32-bit integers."""
    if not text:
        return b""
    words = pieces.words
    out = []
    for word in _WORD.findall(BLANK + text.replace(" ", BLANK)):
        ids = words.get(word)
        if ids is None:
            ids = word_ids(pieces, word)
            words = pieces.words
        out.append(ids)
    return b"".join(out)


def encode_text(pieces: Pieces, text: str) -> list[int]:
    return np.frombuffer(encode_bytes(pieces, text), np.int32).tolist()


def decode_ids(pieces: Pieces, ids) -> str:
    shown = pieces.shown
    if pieces.part_bytes.isdisjoint(ids):
        whole = "".join([shown[i] for i in ids])
    else:
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in pieces.part_bytes:
                pending.append(pieces.bytes[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(shown[i])
        whole = "".join(out) + pending.decode("utf-8", "replace")
    return whole[whole.startswith(" ") :]


@lru_cache(maxsize=2)
def load_pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def with_ids(docs: DataFrame, path: str = MODEL, text: str = "text", ids: str = "ids", same: str = "round_trip") -> DataFrame:
    """``docs`` with the text replaced by its ids and whether decoding them gives the text back."""
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(same, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        for whole in batches:
            # Small slices: the ids of a batch of long texts take more room than the texts.
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(len(others)).to_pylist()]
                found = [encode_bytes(pieces, t) for t in texts]
                flat = pa.array(np.frombuffer(b"".join(found), np.int32))
                ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
                good = [decode_ids(pieces, np.frombuffer(f, np.int32).tolist()) == t.replace(BLANK, " ") for f, t in zip(found, texts)]
                columns = [*(batch.column(i) for i in range(len(others))), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, ids, same])

    return docs.select(*others, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the ids replaced by their text."""
    others = [c for c in encoded.columns if c != ids]
    schema = T.StructType([*[encoded.schema[c] for c in others], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load_pieces(path)
        for batch in batches:
            out = batch[others].copy()
            out[text] = [None if i is None else decode_ids(pieces, list(i)) for i in batch[ids]]
            yield out

    return encoded.select(*others, ids).mapInPandas(run, schema)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) for every document."""
    out = with_ids(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
