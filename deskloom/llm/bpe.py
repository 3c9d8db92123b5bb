"""BPE encoding and decoding: distinct words in a trie, encoded along its paths.

The state of a trie node is the last token of its prefix's encoding. It is the
one token that ends the prefix, starts where an encoded shorter prefix ends, and
that no merge across that border forestalls. So a node's state follows from the
states above it, prefixes that words share are computed once, and a word's tokens
are read back from its node to the root.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm.shared import worker_cache

#: Fixed value: the pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words whose encodings a worker keeps at least, and at most half of those it holds; pairs of tokens that it keeps. Both together take about 170 MB.
KEPT, PAIRS_KEPT = 300_000, 600_000
#: Bytes by whose end tokens are looked up, and the lengths of tokens that are shorter.
TAIL, SHORT = 3, (2, 1)
#: Characters of the longest word that is kept.
LONGEST_KEPT = 200
#: Rows that are turned into Python objects at once, and characters of text after which their words are encoded.
ROWS, CHUNK = 500, 2 << 20


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones as they are, others from U+0100 on."""
    plain = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level BPE vocabulary, read from the JSON file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["model"].get("ignore_merges") or any(not x["special"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has a normalizer, ignore_merges or added tokens that aren't special, which aren't supported")
        letters = byte_letters()
        self.id_of = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lengths = {i: len(b) for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]):
            left, right = (self.id_of[bytes(letters[c] for c in x)] for x in (a, b))
            made = self.id_of[bytes(letters[c] for c in a + b)]
            self.rank[left, right] = (rank, made)
            self.parts.setdefault(made, (rank, left, right))
        #: By their last bytes the lengths of tokens, the longest first: what may end a prefix at all.
        tails: dict[bytes, set[int]] = {}
        for b in self.id_of:
            if len(b) >= TAIL:
                tails.setdefault(b[-TAIL:], set()).add(len(b))
        self.tails = {b: [*sorted(n, reverse=True), *SHORT] for b, n in tails.items()}
        self.fits_cache: dict[tuple[int, int], bool] = {}
        self.stop = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN)

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves left and right as neighbours.

        Both are taken apart in the reverse order of their merges. If at some point
        the two tokens at the border form a merge that ranks before the merges taken
        apart so far, BPE would have made that one first. An equal rank is decided by
        place: BPE merges from the left.
        """
        key = (left, right)
        if (known := self.fits_cache.get(key)) is not None:
            return known
        out, undone, from_right = True, 1 << 30, False
        a, b = left, right
        while True:
            found = self.rank.get((a, b))
            if found and (found[0] < undone or found[0] == undone and from_right):
                out = False
                break
            pa_, pb_ = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb_ is None:
                break
            # the later merge is undone first; of equal ones the right one, which BPE made last
            if pb_ is None or pa_ is not None and pa_[0] > pb_[0]:
                undone, a, from_right = pa_[0], pa_[2], False
            else:
                undone, b, from_right = pb_[0], pb_[1], True
        if len(self.fits_cache) >= PAIRS_KEPT:
            self.fits_cache.clear()
        self.fits_cache[key] = out
        return out

    def extend(self, word: bytes, path: list[int]) -> None:
        """Adds the last tokens of word's prefixes to path, which has those of the first ones."""
        id_of, fits, tails = self.id_of.get, self.fits, self.tails.get
        for end in range(len(path) + 1, len(word) + 1):
            for n in tails(word[end - TAIL : end], SHORT) if end >= TAIL else SHORT:
                start = end - n
                if start < 0:
                    continue
                token = id_of(word[start:end])
                if token is not None and (not start or fits(path[start - 1], token)):
                    path.append(token)
                    break
            else:
                raise ValueError(f"no token ends {word[:end]!r}")

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words, by a depth-first walk through their trie.

        The trie is held as its depth-first listing: the words in order, each of
        which leaves the path of the one before where they part. path has the states
        of the nodes from the root to the current one.
        """
        out, path, before = {}, [], b""
        length = self.lengths
        for word in sorted(words):
            shared, least = 0, min(len(before), len(word))
            while shared < least and before[shared] == word[shared]:
                shared += 1
            del path[shared:]
            self.extend(word, path)
            before, ids, at = word, [], len(word)
            while at:
                ids.append(path[at - 1])
                at -= length[path[at - 1]]
            ids.reverse()
            out[word] = ids
        return out


def merges(path: str) -> tuple[Merges, list[dict[str, bytes]]]:
    """The vocabulary of a file and the words that this worker has encoded with it, as int32 bytes: recent and older ones."""
    path, loaded = os.path.abspath(path), worker_cache("bpe")
    if path not in loaded:
        loaded[path] = (Merges(path), [{}, {}])
    return loaded[path]


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, list[int]]:
    """All texts' ids one after the other, and how many each has; null counts as empty."""
    vocabulary, kept = merges(path)
    split, out, lengths = vocabulary.words.findall, [], []
    specials = {f"\0{x}": array("i", [i]).tobytes() for x, i in vocabulary.special.items()}

    def flush(pending: list[list[str]]) -> None:
        words = set().union(*pending) - specials.keys()
        if len(kept[0]) > KEPT:
            kept[:] = [{}, kept[0]]
        known, older = kept
        todo, long = {}, []
        for w in words - known.keys():
            if (ids := older.get(w)) is not None:
                known[w] = ids
            else:
                todo[w.encode("utf-8")] = w
                if len(w) > LONGEST_KEPT:
                    long.append(w)
        for b, ids in vocabulary.encode_words(list(todo)).items():
            known[todo[b]] = array("i", ids).tobytes()
        known.update(specials)
        for pieces in pending:
            got = b"".join(map(known.__getitem__, pieces))
            out.append(got)
            lengths.append(len(got) // 4)
        for w in long:
            del known[w]

    pending, size = [], 0
    for text in texts:
        pieces: list[str] = []
        text, at = text or "", 0
        if vocabulary.stop:
            for m in vocabulary.stop.finditer(text):
                pieces += split(text, at, m.start())
                pieces.append(f"\0{m.group()}")  # no word has a letter after NUL
                at = m.end()
        pieces += split(text[at:] if at else text)
        pending.append(pieces)
        size += len(text)
        if size >= CHUNK:
            flush(pending)
            pending, size = [], 0
    flush(pending)
    return np.frombuffer(b"".join(out), np.int32), lengths


def _arrow(df: DataFrame, made: dict[str, T.DataType], run) -> DataFrame:
    """df with columns, replaced if there are such: what run makes of each part of an Arrow batch."""
    kept = [f for f in df.schema.fields if f.name not in made]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *run(batch)], [*(f.name for f in kept), *made])

    return df.mapInArrow(batches, T.StructType([*kept, *(T.StructField(x, t) for x, t in made.items())]))


def _encoded(texts: pa.Array, path: str) -> pa.Array:
    flat, lengths = encode_texts(texts.to_pylist(), path)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(flat))


def _decoded(ids: pa.Array, path: str) -> pa.Array:
    table = merges(path)[0].bytes_of
    rows = (x.values.to_numpy().tolist() if x.is_valid else [] for x in ids)
    return pa.array([b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") for x in rows], pa.string())


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with an array of token ids for each text.

    As the tokenizers library does without special tokens added, truncation or
    padding: the special tokens' own strings in a text are those tokens. A null or
    empty text has no ids. path: a byte-level BPE vocabulary in the library's JSON
    format, at the same place on every executor. Rows stay as they are; an existing
    column ids is replaced.
    """

    return _arrow(df, {ids: T.ArrayType(T.IntegerType())}, lambda batch: [_encoded(batch.column(text), path)])


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each array of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD. A null array is empty."""

    return _arrow(df, {text: T.StringType()}, lambda batch: [_decoded(batch.column(ids), path)])


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of each text as of bpe_encode and what bpe_decode makes of them, in one pass over the rows."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = _encoded(batch.column(text), path)
        return [found, _decoded(found, path)]

    return _arrow(df, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, run)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of docs (doc_id, text), encoded and decoded."""
    coded = bpe_round_trip(docs.select("doc_id", "text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
