"""Byte-level BPE encoding and decoding over length-bucketed matrices.

A text is cut into pieces by the vocabulary's pattern. Distinct pieces of an
Arrow batch that are no tokens themselves go into padded matrices of pieces of
like length: one row per piece, one column per remaining symbol. In each round
every row merges its leftmost pair of minimum rank; ranks of pairs come from a
hash table in two numpy arrays (open addressing), and the merged-away column
and the finished rows are compacted out. Ranks of all pairs are kept beside
the symbols, so a round looks up only the two pairs that a merge has changed.

The vocabulary (about 1 MB) and its pair table (a few MB) are read on the
driver and broadcast: their size depends on the vocabulary file alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ship_by_value

NO_RANK = np.int32(2**31 - 1)
#: Longer pieces are a matrix each, as a row costs the square of its length where a round is one merge.
LONGEST_ROW = 2048
#: Cells of one matrix, and pieces that a task remembers; work sizes only.
MATRIX_CELLS = 1 << 20
REMEMBERED = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the text of a rank file: one base64 token and rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def mergeable_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """(left, right, merged) of every pair of tokens that together are a token."""
    out = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left = ranks.get(token[:cut])
            if left is not None:
                right = ranks.get(token[cut:])
                if right is not None:
                    out.append((left, right, rank))
    return np.array(out, np.int32).reshape(-1, 3)


class PairTable:
    """Hash table from a pair of token ids to the merged id."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1]
        values, slot = pairs[:, 2], self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.view(np.uint64) ^ (keys.view(np.uint64) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NO_RANK where there is none or where an id is -1."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        keys[((left < 0) | (right < 0)).ravel()] = -2
        out = np.full(len(keys), NO_RANK, np.int32)
        at = np.flatnonzero(keys != -2)
        slot = self._slots(keys[at])
        while len(at):
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            at, slot = at[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts; remembers the token ids of pieces it has seen, all in
    one array with a start and a length per piece."""

    def __init__(self, ranks: dict[bytes, int], pairs: np.ndarray, pattern: str):
        import regex

        self.token_ids = ranks
        self.pairs = PairTable(pairs)
        self.find = regex.compile(pattern).findall
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and how many each has."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        look, find = self.numbers.__getitem__, self.find
        numbers = [np.fromiter(map(look, find(t)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        if self.numbers.new:
            new, self.numbers.new = [p.encode("utf-8", "surrogatepass") for p in self.numbers.new], []
            ids, lengths = self._encode(new)
            ends = np.cumsum(lengths) + len(self.ids)
            self.ids, self.lengths = np.r_[self.ids, ids], np.r_[self.lengths, lengths]
            self.starts = np.r_[self.starts, ends - lengths]
        flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        lengths = self.lengths[flat]
        upto = np.r_[0, np.cumsum(lengths)]
        last = np.cumsum([len(n) for n in numbers], dtype=np.int64)
        return self.ids[spread(self.starts[flat], lengths)], np.diff(np.r_[0, upto[last]])

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.token_ids.get(p, -1) for p in pieces), np.int64, len(pieces))
        tokens = np.flatnonzero(whole >= 0)
        found = [(tokens, whole[tokens].astype(np.int32), np.ones(len(tokens), np.int64))]
        for i in np.flatnonzero((whole < 0) & (sizes > LONGEST_ROW)):
            ids = self._long_row(pieces[i])
            found.append((np.array([i]), ids, np.array([len(ids)])))
        rest = np.flatnonzero((whole < 0) & (sizes <= LONGEST_ROW))
        step = np.where(sizes[rest] <= 12, 1, 1 << np.maximum(np.log2(np.maximum(sizes[rest], 1)).astype(np.int64) - 3, 0))
        widths = -(-sizes[rest] // step) * step
        order = np.argsort(widths, kind="stable")
        rest, widths = rest[order], widths[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, widths[1:] != widths[:-1]]), len(rest)] if len(rest) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = max(1, MATRIX_CELLS // int(widths[a]))
            for at in range(a, b, rows):
                members = rest[at:min(b, at + rows)]
                found += self._matrix([pieces[i] for i in members], members, sizes[members], int(widths[a]))
        lengths = np.zeros(len(pieces), np.int64)
        for rows, _, counts in found:
            lengths[rows] = counts
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.int32)
        for rows, ids, counts in found:
            out[spread(starts[rows], counts)] = ids
        return out, lengths

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int) -> list[tuple]:
        """(rows, ids one after the other, number of ids) as rows are finished."""
        filled = np.arange(width) < sizes[:, None]
        raw = np.zeros((len(rows), width), np.uint8)
        raw[filled] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(filled, self.of_byte[raw], np.int32(-1))
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        out = []
        while True:
            if ids.shape[1] > 1:
                at = ranks.argmin(axis=1)  # the leftmost of the least
                best = ranks[np.arange(len(ids)), at]
                done = best == NO_RANK
            else:
                done = np.ones(len(ids), bool)
            if done.any():
                ready = ids[done]
                there = ready >= 0
                out.append((rows[done], ready[there], there.sum(axis=1)))
                go = np.flatnonzero(~done)
                if not len(go):
                    return out
                ids, ranks, rows, at, best = ids[go], ranks[go], rows[go], at[go], best[go]
            n, w = ids.shape
            line = np.arange(n)
            ids[line, at] = best
            keep = np.ones((n, w), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[line, np.minimum(at + 1, w - 2)] = False
            ranks = ranks[keep].reshape(n, w - 2)
            right, left = np.flatnonzero(at < w - 2), np.flatnonzero(at > 0)
            changed, place = np.r_[right, left], np.r_[at[right], at[left] - 1]
            ranks[changed, place] = self.pairs.ranks(ids[changed, place], ids[changed, place + 1])

    def _long_row(self, piece: bytes) -> np.ndarray:
        """A matrix of one row, for a very long piece. A round merges the pair
        of least rank at all its places, from the left, up to the first merge
        that brings a pair of lower rank: the merges and their order are those
        of a merge a round."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = np.r_[self.pairs.ranks(ids[:-1], ids[1:]), NO_RANK]  # of each id with the next one
        while (best := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == best)
            starts = np.r_[True, np.diff(at) > 1]  # places that overlap are a run: every other one is merged
            at = at[(at - at[starts][np.cumsum(starts) - 1]) % 2 == 0]
            before = np.where(at > 0, ids[np.maximum(at - 1, 0)], np.int32(-1))
            before[1:][np.diff(at) == 2] = best  # just merged itself
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], np.int32(-1))
            merged = np.full(len(at), best, np.int32)
            lower = np.flatnonzero((self.pairs.ranks(before, merged) < best) | (self.pairs.ranks(merged, after) < best))
            if len(lower):
                at = at[:lower[0] + 1]
            ids[at] = best
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, ranks = ids[stays], ranks[stays]
            at -= np.arange(len(at))
            ranks[-1] = NO_RANK
            for place in (at[at < len(ids) - 1], at[at > 0] - 1):
                ranks[place] = self.pairs.ranks(ids[place], ids[place + 1])
        return ids


class Decoder:
    """Bytes of token ids: all tokens' bytes in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.lengths = np.full(size, -1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.bytes = np.frombuffer(b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        if (lengths < 0).any():
            raise ValueError("an id that is not in the vocabulary")
        return self.bytes[spread(self.starts[ids], lengths)].tobytes()


def bpe_encode(df: DataFrame, text_col: str, rank_file: str, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of whole texts as array<int> in ``ids_col``
    (which replaces a column of that name). Null and empty texts have no
    tokens. Rows, repeated ones too, stay as they are.

    ``rank_file`` is read on the driver: one base64 token and its rank a line.
    """
    with open(rank_file, "rb") as f:
        ranks = read_ranks(f.read())
    shared = df.sparkSession.sparkContext.broadcast((ranks, mergeable_pairs(ranks)))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(*shared.value, pattern)
        for texts in batches:
            ids, counts = encoder.texts(texts.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))

    return df.withColumn(ids_col, encode(F.col(text_col)))


def bpe_decode(df: DataFrame, ids_col: str, rank_file: str, *, bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the token ids in ``bytes_col``; null ids: empty.
    An id outside the vocabulary raises."""
    with open(rank_file, "rb") as f:
        ranks = read_ranks(f.read())
    shared = df.sparkSession.sparkContext.broadcast(Decoder(ranks))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder, none = shared.value, np.empty(0, np.int64)
        for batch in batches:
            yield pa.array([decoder(row.values.to_numpy() if row.is_valid else none) for row in batch], pa.binary())

    return df.withColumn(bytes_col, decode(F.col(ids_col)))


def bpe_round_trip(df: DataFrame, id_col: str, text_col: str, rank_file: str, pattern: str) -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded_sha256): whole texts encoded,
    and the ids decoded again."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    encoded = bpe_encode(src, "text", rank_file, pattern).drop("text")
    decoded = bpe_decode(encoded, "ids", rank_file)
    return decoded.select(
        "id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


ship_by_value(__name__)
