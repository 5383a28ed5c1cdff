"""Packing of documents into fixed-length token sequences by the sum-of-squares rule."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import fresh, worker_store
from logloom.session import materialize

#: Rows that one task packs together. More rows per group leave fewer half-empty sequences.
GROUP_ROWS = 100_000
#: Entries that a worker keeps of texts it has encoded; the store is emptied when full.
KEPT_CHUNKS = 900_000
#: After white space, a space or a line feed does not start a chunk of its own.
_NOT_PLAIN = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Letters below this code point are spelled out for the model directly.
LATIN_END = "\u0250"
_SIGNS = ".,;:!?*%$&#|)\"'"


class ChunkEncoder:
    """Ids of a byte-level BPE `tokenizers` file, with a store of chunks already encoded.

    The tokenizer never joins a space or line feed that stands between two other characters with
    what comes before it, so a text may be cut there and its chunks encoded one by one: most chunks
    are repeated words. It also parts letters from signs that follow them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.chunks: dict[str, bytes] = {}  # by the text after the space, or from the line feed on
        self.signs: dict[str, bytes] = {}
        starts = tuple(self.tokenizer.encode(c, add_special_tokens=False).tokens[0] for c in " \n")
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(starts)
                                for i in range(self.tokenizer.get_vocab_size())])
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.feed = self._alone("\n")
        # how the model spells the space and the letters of Latin alphabets
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.space = spell(" ")[0][0]
        self.letters = {i: spell(chr(i))[0][0][-2:] for i in range(0x80, ord(LATIN_END)) if chr(i).isalpha()}
        self.merge = self.tokenizer.model.tokenize

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fill(self, parts: set[str]) -> None:
        """Encodes new chunks: Latin words, and such words with signs behind them, by the tokenizer's
        model, which they reach unsplit; all others together in one call of the tokenizer."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
            self.signs.clear()
        chunks, raw, merge, others = self.chunks, self.raw, self.merge, []
        for p in parts.difference(chunks):
            feed = p[:1] == "\n"
            body = p[1:] if feed else p
            word = body.rstrip(_SIGNS)
            if not word.isalpha() or not word.isascii() and max(word) >= LATIN_END:
                others.append(p)
                continue
            stem = p[:len(word) + feed]
            ids = chunks.get(stem)
            if ids is None:
                spelled = word if word.isascii() else word.translate(self.letters)
                ids = b"".join([raw[t.id] for t in merge(spelled if feed else self.space + spelled)])
                chunks[stem] = ids = self.feed + ids if feed else ids
            rest = body[len(word):]
            if rest:
                if rest not in self.signs:
                    self.signs[rest] = self._alone(rest)
                chunks[p] = ids + self.signs[rest]
        plain = [p for p in others if p and not p[0 if p[0] != "\n" else 1:][:1].isspace() and p != "\n"]
        # Each begins with the only space or line feed in it, so its first id shows.
        ids = np.array(self.tokenizer.encode("".join([p if p[0] == "\n" else " " + p for p in plain]),
                                             add_special_tokens=False).ids, "<u4")
        at = (4 * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
        line = ids.tobytes()
        chunks.update((p, line[a:b]) for p, a, b in zip(plain, at, at[1:]))
        for p in others:
            if p not in chunks:
                chunks[p] = self._alone(p if p[:1] == "\n" else " " + p)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers. Unknown chunks are looked for
        in about a megabyte of text at a time."""
        held: list[tuple[str, list[str] | None]] = []
        wanted: set[str] = set()
        size = 0
        for k, text in enumerate(texts):
            if text[:1] == "\n" or _NOT_PLAIN.search(text):
                held.append((text, None))
            else:
                first, *parts = text.replace("\n", " \n").split(" ")
                held.append((first, parts))
                wanted.update(parts)
            size += len(text)
            if size > 1_000_000 or k == len(texts) - 1:
                self._fill(wanted)
                for first, parts in held:
                    if parts is None:
                        yield b"".join([self._alone(c) for c in _CUT.split(first)])
                    else:
                        yield self._alone(first) + b"".join(map(self.chunks.__getitem__, parts))
                held, wanted, size = [], set(), 0


def encoder(path: str) -> ChunkEncoder:
    return worker_store(("encoder", path), lambda: ChunkEncoder(path))


def pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids (little-endian 32-bit), ids_crc32.

    A document is its ids and then `end_id`. Longer ones are cut into pieces of `limit` ids; the
    first takes what is left over. A null text counts as empty: one piece that holds `end_id` alone.
    Null and repeated ids are kept as they are. An empty table gives no pieces."""
    stop = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            out = []
            texts = [text if isinstance(text, str) else "" for text in batch[text_col]]
            for doc, ids in zip(batch[id_col], enc.encode(texts)):
                ids += stop
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    step = (n % limit or limit) if k == 0 else limit
                    part = ids[4 * at:4 * (at + step)]
                    out.append((doc, k, at, step, part, zlib.crc32(part)))
                    at, k = at + step, k + 1
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = [id_col, "piece", "start", "length", "ids", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    if kind in ("bigint", "int", "smallint", "tinyint"):  # a null among numbers would turn them into floats
        source = source.withColumn(id_col, F.col(id_col).cast("string"))
    schema = f"`{id_col}` string, piece int, start long, length long, ids binary, ids_crc32 long"
    return source.mapInPandas(cut, schema).withColumn(id_col, F.col(id_col).cast(kind))


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order.

    counts[g] is the number of open sequences with g free places. A piece of length s goes where
    the sum of squared counts becomes smallest: into a sequence with gap g (one fewer at g, one more
    at g - s) or into a new one (one more at limit - s). Full sequences are not counted. Of equal
    choices the fullest sequence wins, and a new one comes last."""
    counts = np.zeros(limit + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(limit + 1)]
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = counts[s:limit]
        best, where = (2 * int(counts[limit - s]) + 1 if s < limit else 0), limit
        used = np.flatnonzero(gaps)
        if len(used):
            after = counts[used].copy()
            closes = used[0] == 0
            cost = 2 * (after - gaps[used] + 1)
            if closes:  # a gap of exactly s: the sequence closes and leaves the count
                cost[0] = 1 - 2 * int(gaps[0])
            k = int(np.argmin(cost))
            if cost[k] <= best:
                where = int(used[k]) + s
        if where == limit:
            seq[i], off[i], left = made, 0, limit - s
            bin_no, made = made, made + 1
        else:
            bin_no = open_at[where].pop()
            counts[where] -= 1
            seq[i], off[i], left = bin_no, limit - where, where - s
        if left:
            counts[left] += 1
            open_at[left].append(bin_no)
    return seq, off


def placing_order(lengths: np.ndarray, seed: int) -> np.ndarray:
    """The rule balances the gaps when lengths arrive mixed, and short pieces fill gaps best at the
    end: the longer nine tenths come in a seeded random order, then the rest from long to short."""
    down = lengths.argsort(kind="stable")[::-1]
    head = len(down) * 9 // 10
    return np.concatenate([np.random.default_rng(seed).permutation(down[:head]), down[head:]])


def pack(parts: DataFrame, limit: int = 2048, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length` of 1 to `limit`; all columns stay.

    Rows are dealt into groups of about `group_rows` by a hash of their columns, so that no task
    packs the whole input; the number of groups follows the row count. Pieces in one sequence have gapless offsets from 0. Repeated rows are packed each for
    itself. Columns named sequence_id or offset are replaced."""
    parts = parts.drop("sequence_id", "offset")
    group = fresh(parts.columns, "_group")
    n = max(1, math.ceil(parts.count() / group_rows))
    keys = [c for c, kind in parts.dtypes if kind != "binary"]
    dealt = parts.withColumn(group, F.pmod(F.xxhash64(*keys), F.lit(n)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[placing_order(rows["length"].to_numpy(), int(rows[group].iloc[0]))]
        seq, off = sum_of_squares(rows["length"].to_numpy(), limit)
        first = int(rows[group].iloc[0]) << 40
        return rows.drop(columns=group).assign(sequence_id=seq + first, offset=off)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in parts.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy(group).applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The written table of pieces with their ids, and the place of each piece in a sequence.
    Join both on (id, piece) for the token sequences themselves."""
    cut = materialize(pieces(docs, tokenizer, limit, end_id, id_col, text_col), "pieces")
    return cut, pack(cut.drop("ids"), limit)
