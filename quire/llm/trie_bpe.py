"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte-pair encoding has one valid last token for every prefix of a word: the
encoding of a prefix is that of a shorter prefix and one token more, and a
token may follow another if no merge crosses their border before both are
whole. So the state of a trie node is the last token of the word that the node
spells, and it follows from the states of its ancestors alone.

The distinct words of an Arrow batch form the trie. It's kept as its words in
sorted order with the length of the prefix that each shares with the one before
it, which is the trie's preorder: the walk keeps the states of one
root-to-node path, goes back to the shared prefix and computes states only of
nodes that no word before had. A word's encoding is read off the path from
its end. Words seen before are remembered with their ids.

At a node, the tokens that end there are tried from the longest down: an
Aho-Corasick automaton over the tokens gives the longest, each token knows
the next shorter one. Whether a token may follow another is remembered per
pair. All of this has one cost per byte, so long words need no other way.

The vocabulary file is read on the driver; what is broadcast depends on that
file alone (some MB).
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import _Numbers, spread
from quire.llm.common import ship_by_value

#: Words and token pairs that a task remembers, and characters that it encodes
#: at once; work sizes only, which bound what a Python worker holds.
REMEMBERED_WORDS, REMEMBERED_PAIRS, SLICE_CHARS = 200_000, 400_000, 1_000_000

#: The published word pattern of byte-level pre-tokenizers (fixed value).
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: itself if it is visible Latin-1, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in set(own) else next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the ``tokenizers`` library.

    Raises ValueError for what this operator doesn't do: other model kinds,
    normalizers, post-processors, added tokens with stripping options.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError(f"not a plain byte-level BPE file: {odd or model.get('type')}")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("the pre-tokenizer has to be ByteLevel with its pattern and without a prefix space")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = model["vocab"]
        if max(vocab.values()) >> 20:
            raise ValueError("more than 2**20 tokens")
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        if any(a.get("single_word") or a.get("lstrip") or a.get("rstrip") or a.get("normalized") for a in spec.get("added_tokens") or []):
            raise ValueError("added tokens with options")
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.id_of_byte = [vocab[c] for c in byte_characters()]
        #: id of the merged token and its rank by pair; halves of each merged token, by its first merge
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merges.setdefault((a, b), (rank, whole))
            if self.halves.setdefault(whole, (rank, a, b))[1:] != (a, b):
                raise ValueError("a token with two merges")


def may_follow(vocab: Vocabulary, left: int, right: int) -> bool:
    """Whether ``left`` and ``right`` side by side stay two tokens.

    Goes back in time along the border: the last merge of either side is taken
    back, and at each moment the symbols at the border must not have merged.
    A crossing merge of the same rank as the merge that ends the left symbol
    comes after it (the leftmost goes first), as the right symbol's before it.
    """
    never = len(vocab.merges)
    left_ends = right_ends = never
    while True:
        crossing = vocab.merges.get((left, right))
        if crossing and crossing[0] < left_ends and crossing[0] <= right_ends:
            return False
        a, b = vocab.halves.get(left), vocab.halves.get(right)
        if a is None and b is None:
            return True
        if b is None or a is not None and a[0] > b[0]:
            left_ends, left = a[0], a[2]
        else:
            right_ends, right = b[0], b[1]


class SuffixTokens:
    """Aho-Corasick automaton over the tokens' bytes: the longest token that
    ends at a place, and for each token the longest shorter one that ends it."""

    def __init__(self, tokens: dict[bytes, int]):
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        token_at, last = [-1], [0]
        for text, token in tokens.items():
            state = 0
            for byte in text:
                key = state << 8 | byte
                after = self.step.get(key)
                if after is None:
                    after = self.step[key] = len(token_at)
                    token_at.append(-1)
                    last.append(byte)
                state = after
            token_at[state] = token
        children: list[list[int]] = [[] for _ in token_at]
        for key, after in self.step.items():
            children[key >> 8].append(after)
        self.fail = [0] * len(token_at)
        self.longest = token_at[:]
        self.shorter: dict[int, int] = {}
        todo = deque([0])
        while todo:
            state = todo.popleft()
            for after in children[state]:
                if state:
                    back = self.fail[state]
                    while back and back << 8 | last[after] not in self.step:
                        back = self.fail[back]
                    self.fail[after] = self.step.get(back << 8 | last[after], 0)
                below = self.longest[self.fail[after]]
                if token_at[after] < 0:
                    self.longest[after] = below
                else:
                    self.shorter[token_at[after]] = below
                todo.append(after)


def sound_tokens(vocab: Vocabulary) -> dict[bytes, int]:
    """Tokens that the encoding can yield: bytes, and merged tokens whose
    halves are such tokens and would stand side by side until that merge."""
    sound = set(vocab.id_of_byte)
    for whole, (rank, a, b) in sorted(vocab.halves.items(), key=lambda x: x[1][0]):
        if a in sound and b in sound and _first_border_merge(vocab, a, b) == rank:
            sound.add(whole)
    return {vocab.bytes_of[t]: t for t in sound}


def _first_border_merge(vocab: Vocabulary, left: int, right: int) -> int:
    """Rank of the merge of the two whole tokens, -1 if one crosses before."""
    rank, whole = vocab.merges[left, right]
    hidden = vocab.merges.pop((left, right))
    try:
        return rank if may_follow(vocab, left, right) else -1
    finally:
        vocab.merges[left, right] = hidden


class TrieEncoder:
    def __init__(self, vocab: Vocabulary, automaton: SuffixTokens):
        import regex

        self.vocab, self.automaton = vocab, automaton
        self.find = regex.compile(BYTE_LEVEL_WORDS).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.added, key=len, reverse=True))) + ")").split if vocab.added else None
        self.size = [len(vocab.bytes_of.get(t, b"")) for t in range(max(vocab.bytes_of) + 1)]
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Words have numbers; their ids lie in one array."""
        self.numbers = _Numbers()
        self.ids, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and how many each has."""
        if len(self.numbers) > REMEMBERED_WORDS:
            self._forget()
        look = self.numbers.__getitem__
        cut = [np.fromiter(map(look, self._words(t)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        if self.numbers.new:
            new, self.numbers.new = self.numbers.new, []
            found = self._walk(new)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ends = np.cumsum(lengths) + len(self.ids)
            self.ids = np.r_[self.ids, np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))]
            self.starts, self.lengths = np.r_[self.starts, ends - lengths], np.r_[self.lengths, lengths]
        flat = np.concatenate(cut) if cut else np.empty(0, np.int64)
        lengths = self.lengths[flat]
        upto = np.r_[0, np.cumsum(lengths)]
        last = np.cumsum([len(n) for n in cut], dtype=np.int64)
        return self.ids[spread(self.starts[flat], lengths)], np.diff(np.r_[0, upto[last]])

    def _words(self, text: str) -> list[str]:
        """Words by the pattern, and added tokens as words of their own."""
        if self.apart is None or not any(a in text for a in self.vocab.added):
            return self.find(text)
        return [w for part in self.apart(text) for w in ([part] if part in self.vocab.added else self.find(part))]

    def _walk(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct words: depth first through their trie."""
        step, fail, longest, shorter = self.automaton.step, self.automaton.fail, self.automaton.longest, self.automaton.shorter
        size, pairs, vocab, added = self.size, self.pairs, self.vocab, self.vocab.added
        out: list[list[int]] = [[added[w]] if w in added else [] for w in words]
        states, last = [0], [-1]  # of the path's nodes: automaton state, last token
        before = b""
        for spelled, i in sorted((w.encode("utf-8", "surrogatepass"), i) for i, w in enumerate(words) if w not in added):
            n = min(len(spelled), len(before))
            if spelled[:n] == before[:n]:
                shared = n
            else:
                differs = int.from_bytes(spelled[:n]) ^ int.from_bytes(before[:n])
                shared = n - (differs.bit_length() + 7) // 8
            del states[shared + 1:], last[shared + 1:]
            if len(pairs) > REMEMBERED_PAIRS:
                pairs.clear()
            before, state, depth = spelled, states[-1], shared
            for byte in spelled[shared:]:
                depth += 1
                after = step.get(state << 8 | byte)
                while after is None:
                    state = fail[state]
                    after = step.get(state << 8 | byte)
                state = after
                token = longest[state]
                start = depth - size[token]
                while start:
                    key = last[start] << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = may_follow(vocab, last[start], token)
                    if fits:
                        break
                    token = shorter[token]
                    start = depth - size[token]
                states.append(state)
                last.append(token)
            ids = out[i]
            while depth:
                token = last[depth]
                ids.append(token)
                depth -= size[token]
            ids.reverse()
        return out


def slices(texts: pa.Array, chars: int) -> Iterator[list[str | None]]:
    """The texts in order, in lists that reach ``chars`` characters with their last."""
    some, held = [], 0
    for text in texts:
        some.append(text.as_py())
        held += len(some[-1] or "")
        if held >= chars:
            yield some
            some, held = [], 0
    if some:
        yield some


class TokenBytes:
    """Bytes of token ids, one after the other in one array."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.lengths = np.full(max(bytes_of) + 1, -1, np.int64)
        for token, text in bytes_of.items():
            self.lengths[token] = len(text)
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.bytes = np.frombuffer(b"".join(text for _, text in sorted(bytes_of.items())), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id that is not in the vocabulary")
        return self.bytes[spread(self.starts[ids], self.lengths[ids])].tobytes()


def trie_encode(df: DataFrame, text_col: str, vocab_file: str, *, ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of whole texts as array<int> in ``ids_col``
    (which replaces a column of that name), as the ``tokenizers`` library gives
    them for that file without special tokens put around a text; added tokens
    that a text spells out become their ids. Null and empty texts have no ids.
    Rows, repeated ones too, stay as they are."""
    with open(vocab_file, encoding="utf-8") as f:
        vocab = Vocabulary(f.read())
    tokens = sound_tokens(vocab)
    if any(bytes([b]) not in tokens for b in range(256)):
        raise ValueError("a byte without a token")
    shared = df.sparkSession.sparkContext.broadcast((vocab, SuffixTokens(tokens)))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = TrieEncoder(*shared.value)
        for texts in (some for batch in batches for some in slices(batch, SLICE_CHARS)):
            ids, counts = encoder.encode(texts)
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))

    return df.withColumn(ids_col, encode(F.col(text_col)))


def trie_decode(df: DataFrame, ids_col: str, vocab_file: str, *, text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``text_col``; bytes that aren't UTF-8
    become U+FFFD. Null ids: the empty text. An unknown id raises."""
    return df.withColumn(text_col, _decoded(df, ids_col, vocab_file))


def _decoded(df: DataFrame, ids_col: str, vocab_file: str) -> Column:
    with open(vocab_file, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(TokenBytes(Vocabulary(f.read()).bytes_of))

    @F.arrow_udf("string")
    def decode(batch: pa.Array) -> pa.Array:
        spelled, none = shared.value, np.empty(0, np.int64)
        return pa.array([spelled(row.values.to_numpy() if row.is_valid else none).decode("utf-8", "replace") for row in batch], pa.string())

    return decode(F.col(ids_col))


def ids_as_bytes(df: DataFrame, ids_col: str, *, bytes_col: str) -> DataFrame:
    """``df`` with the ids as little-endian 32-bit integers; null ids: empty."""
    return df.withColumn(bytes_col, _packed(ids_col))


def _packed(ids_col: str) -> Column:

    @F.arrow_udf("binary")
    def packed(batch: pa.Array) -> pa.Array:
        return pa.array([row.values.to_numpy().astype("<i4").tobytes() if row.is_valid else b"" for row in batch], pa.binary())

    return packed(F.col(ids_col))


def trie_round_trip(df: DataFrame, id_col: str, text_col: str, vocab_file: str) -> DataFrame:
    """(id, ids, n_tokens, ids_bytes, decoded): whole texts encoded, and the
    ids decoded again. Other columns are not read. One Python worker of a task
    encodes, one packs and decodes."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    encoded = trie_encode(src, "text", vocab_file).drop("text")
    return encoded.select("id", "ids", _packed("ids").alias("ids_bytes"), _decoded(encoded, "ids", vocab_file).alias("decoded"),
                          F.size("ids").cast("long").alias("n_tokens"))


ship_by_value(__name__)
