"""SentencePiece BPE encoding and decoding, in vectorised merge rounds.

A text's white space becomes the piece mark, and no piece has the mark behind another character, so a text falls into
words that merge on their own. The distinct words of a batch stand in one flat array of symbols. Each round finds the
smallest rank of a pair in every word (a segmented minimum) and merges that word's pairs of the rank at once, from the left
and without overlap; then merged symbols close up, and words without a pair leave. Merging at once equals merging one after
the other unless a new pair ranks as low as those merged: there a word's later merges wait for the next round.
Characters without a piece become byte pieces.

The model file is read by the driver; the tables made of it travel to the tasks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, widened

MARK = "▁"
#: Text of one batch.
BATCH_BYTES = 6 << 20
#: Rank of a pair that is no piece.
NONE = np.int32(2**31 - 1)
#: A free place of the table of pairs.
FREE = -(2**63)

# Fixed values of the model file's format: piece types, and the number of the model type BPE.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    """Where the search for each key begins in a table of ``size`` places (a power of two)."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


def load(path: str) -> dict:
    """The tables of a model file: BPE with byte fallback, text taken as it is but for a mark at its beginning.

    Models of another kind (other normalisation, unused or user-defined pieces, white space behind a word) raise a ValueError.
    """
    with open(path, "rb") as f:
        model = list(_fields(f.read()))
    pieces, scores, kinds = [], [], []
    for part in (dict(_fields(v)) for k, v in model if k == 1):
        pieces.append(part.get(1, b"").decode())
        scores.append(struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0])
        kinds.append(part.get(3, NORMAL))
    trainer, normal = ({k: v for n, part in model if n == number for k, v in _fields(part)} for number in (2, 3))
    wanted = trainer.get(3, 1) == BPE and trainer.get(35, 0) and not trainer.get(24, 0) and not normal.get(2, b"") and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1)
    if not wanted or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("not a BPE model with byte fallback, plain pieces, no normalisation and a mark before the text")
    number = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
    rank = np.unique(-np.array(scores), return_inverse=True)[1]
    symbol = -1 - np.arange(0x110000, dtype=np.int32)  # a character without a piece is its own negative number
    pairs = {}
    for p, i in number.items():
        if len(p) == 1:
            symbol[ord(p)] = i
    of = lambda s: number.get(s, int(symbol[ord(s)]) if len(s) == 1 else None)
    for p, i in number.items():
        for cut in range(1, len(p)):
            a, b = of(p[:cut]), of(p[cut:])
            if a is not None and b is not None:
                pairs[(a << 32) + b] = i
    keys = np.full(1 << max(4, (4 * len(pairs)).bit_length()), FREE, np.int64)
    made = np.zeros(len(keys), np.int64)
    wanted = np.fromiter(pairs, np.int64, len(pairs))
    for slot, key in zip(_slot(wanted, len(keys)).tolist(), wanted.tolist(), strict=True):
        while keys[slot] != FREE:
            slot = (slot + 1) & (len(keys) - 1)
        keys[slot], made[slot] = key, pairs[key]
    surface = [b"" if k in (CONTROL, BYTE) else (trainer.get(44, b" \xe2\x81\x87 ") if k == UNKNOWN else p.replace(MARK, " ").encode()) for p, k in zip(pieces, kinds, strict=True)]
    byte = np.full(256, -1, np.int64)
    for i, k in enumerate(kinds):
        if k == BYTE:
            byte[int(pieces[i][3:5], 16)] = i
            surface[i] = bytes([int(pieces[i][3:5], 16)])
    tables = {
        "symbol": symbol, "keys": keys, "made": made, "ranks": rank.astype(np.int32)[made], "byte": byte, "surface": surface, "control": np.array(kinds) == CONTROL,
        "plain": np.array(kinds) == NORMAL, "is_byte": np.array(kinds) == BYTE, "words": not any(re.search(f"[^{MARK}]{MARK}", p) for p in number), "long": 0,
    }
    # A long run of marks begins with its longest piece and goes on as a shorter run does; where that holds it may be cut.
    longest = max((len(p) for p in number if set(p) == {MARK}), default=0)
    if longest > 1 and tables["words"]:
        alone = [merge([MARK * k], tables)[0].tolist() for k in range(1, 4 * longest + 1)]
        if all(alone[k - 1] == [number[MARK * longest], *alone[k - longest - 1]] for k in range(2 * longest, 4 * longest + 1)):
            tables["long"] = longest
    return tables


def _pairs(model: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece that each pair of symbols makes, and its rank (NONE without a piece), from an open hash table."""
    key = (a << 32) + b
    slot = _slot(key, len(model["keys"]))
    there = model["keys"][slot]
    open_ = np.flatnonzero((there != key) & (there != FREE))
    while len(open_):
        slot[open_] = (slot[open_] + 1) & (len(model["keys"]) - 1)
        there = model["keys"][slot[open_]]
        open_ = open_[(there != key[open_]) & (there != FREE)]
    return model["made"][slot], np.where(model["keys"][slot] == key, model["ranks"][slot], NONE)


def merge(words: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of all words in a row, and how many each has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbol = model["symbol"][np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    done_word, done = [word[:0]], [symbol[:0]]
    made, rank = _pairs(model, symbol, np.append(symbol[1:], 0))
    rank[np.append(word[1:], -1) != word] = NONE
    while len(symbol):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.minimum.reduceat(rank, first)
        open_ = least < NONE
        length = np.diff(np.append(first, len(word)))
        if not open_.all():
            live = np.repeat(open_, length)
            done_word.append(word[~live])
            done.append(symbol[~live])
            word, symbol, made, rank = word[live], symbol[live], made[live], rank[live]
            if not len(word):
                break
            least, length = least[open_], length[open_]
        here = np.repeat(least, length)
        at = np.flatnonzero(rank == here)
        # Of pairs that overlap in a chain every other one is merged, from the left.
        start = np.concatenate([[True], at[1:] != at[:-1] + 1])
        at = at[(np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]) % 2 == 0]
        new = made[at]
        # What a merge makes with its neighbours: the left one as it is after its own merge, the right one before.
        other = symbol[at - 1]
        chained = np.concatenate([[False], at[1:] == at[:-1] + 2])
        other[chained] = new[np.flatnonzero(chained) - 1]
        made_before, before = _pairs(model, other, new)
        before[(at == 0) | (word[at - 1] != word[at])] = NONE
        right = np.minimum(at + 2, len(word) - 1)
        made_after, after = _pairs(model, new, symbol[right])
        after[(at + 2 >= len(word)) | (word[right] != word[at])] = NONE
        early = np.minimum(before, after) <= here[at]
        if early.any():
            # A word's merges up to the first that makes such a pair.
            count = np.cumsum(early) - early
            own = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            ok = count == count[np.flatnonzero(own)[np.cumsum(own) - 1]]
            at, new, made_before, before, made_after, after = (x[ok] for x in (at, new, made_before, before, made_after, after))
        symbol[at] = new
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        where = (np.cumsum(keep) - 1)[at]
        word, symbol, made, rank = word[keep], symbol[keep], made[keep], rank[keep]
        made[where], rank[where] = made_after, after
        inner = where > 0
        # After those to the right: a left neighbour merged in the same round is seen as it is now.
        made[where[inner] - 1] = np.where(before[inner] < NONE, made_before[inner], made[where[inner] - 1])
        rank[where[inner] - 1] = before[inner]
    word, symbol = np.concatenate(done_word), np.concatenate(done)
    order = np.argsort(word, kind="stable")
    word, symbol = word[order], symbol[order]
    # Characters without a piece: their bytes.
    bare = np.flatnonzero(symbol < 0)
    if len(bare):
        chars, which = np.unique(-1 - symbol[bare], return_inverse=True)
        coded = [chr(c).encode() for c in chars.tolist()]
        width = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = model["byte"][np.frombuffer(b"".join(coded), np.uint8)]
        times = np.ones(len(symbol), np.int64)
        times[bare] = width[which]
        begin = np.zeros(len(symbol), np.int64)
        begin[bare] = (np.cumsum(width) - width)[which]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        symbol, begin, word = (np.repeat(x, times) for x in (symbol, begin, word))
        symbol = np.where(symbol < 0, flat[np.minimum(begin + step, len(flat) - 1)], symbol)
    return symbol, np.bincount(word, minlength=len(words))


def encode(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of all texts in a row, and how many each has."""
    if not model["words"]:
        split = lambda t: [t]
    else:
        n = model["long"]
        cut = f"{MARK}{{{n}}}(?={MARK}{{{n}}})|" if n else ""
        split = re.compile(f"{cut}{MARK}*[^{MARK}]+|{MARK}+").findall
    parts = [split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    coded = pa.array([w for p in parts for w in p], pa.large_string()).dictionary_encode()
    symbols, sizes = merge(coded.dictionary.to_pylist(), model)
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    length, begin = sizes[which], (np.cumsum(sizes) - sizes)[which]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    ids = symbols[np.arange(total) + np.repeat(begin - (ends - length), length)]
    upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return ids.astype(np.int32), np.diff(upto)


def _readable(data: bytes) -> str:
    """Bytes as text, each byte that belongs to no character as a replacement character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def decode(ids: np.ndarray, model: dict) -> str:
    """The text of one row of piece numbers: marks are spaces, but for one before the text; byte pieces in a row are bytes.

    Pieces of control give nothing and end a row of bytes.
    """
    if not len(ids):
        return ""
    control, surface = model["control"][ids], model["surface"]
    text = None
    if not control.any():
        try:
            text = b"".join(map(surface.__getitem__, ids.tolist())).decode()
        except UnicodeDecodeError:
            pass
    if text is None:
        in_bytes = model["is_byte"][ids]
        edge = np.flatnonzero(np.diff(in_bytes, prepend=not in_bytes[0]))
        parts = [(in_bytes[a], b"".join(surface[i] for i in ids[a:b].tolist())) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True)]
        text = "".join(_readable(part) if raw else part.decode() for raw, part in parts)
    shown = ids[~control]
    return text[1:] if len(shown) and model["plain"][shown[0]] and text[:1] == " " else text


def _packed(df: DataFrame, source: str, *targets: str) -> DataFrame:
    rest = df.drop(*targets)
    return rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("_row"), F.col(source).alias("_in"))


def encode_texts(df: DataFrame, model_path: str, text_col: str = "text", to: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the piece numbers of its texts as ``to`` (array of int), without marks of beginning or end, and, if
    ``decoded`` names a column, with the text that decode() makes of them.

    They are those of the sentencepiece library for the same model. Null and empty texts have none. Columns of those names
    are replaced, all others stay; every row gives one row, and an empty table an empty one. Texts are taken whole; memory
    goes with a batch of BATCH_BYTES or one longer text.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(model_path))
    targets = [to, *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for small in (s for batch in batches for s in bounded(batch, "_in", BATCH_BYTES)):
            ids, counts = encode(small.column("_in").to_pylist(), model)
            ends = np.concatenate([[0], np.cumsum(counts)])
            columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
            if decoded:
                columns.append(pa.array([decode(ids[a:b], model) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([small.column("_row"), *columns], ["_row", *targets])

    rows = _packed(df, text_col, *targets)
    return rows.mapInArrow(run, widened(rows.select("_row"), ", ".join([f"`{to}` array<int>", *([f"`{decoded}` string"] if decoded else [])]))).select("_row.*", *[f"`{t}`" for t in targets])


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of its piece numbers as ``to``; null and empty arrays give an empty text.

    Pieces of control give nothing, bytes that are no character a replacement character each. Columns and rows as in
    encode_texts(). A number outside the model is an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(x.values.to_numpy(zero_copy_only=False), shared.value) if x.is_valid and len(x.values) else "" for x in batch.column("_in")]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", to])

    rows = _packed(df, ids_col, to)
    return rows.mapInArrow(run, widened(rows.select("_row"), f"`{to}` string")).select("_row.*", f"`{to}`")
