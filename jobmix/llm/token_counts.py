"""Token counts of word-end BPE by rank-synchronous array merging.

The texts of a batch become one bag of distinct pre-tokens.  Their symbols
lie one after the other in a ragged NumPy array; every round looks up the
merge rank of every neighbouring pair, finds each sequence's lowest rank and
applies that pair in all sequences at once.  A sequence whose lowest rank is
"none" is finished; what it still holds is its token count.

Results for odd input: a null or empty text has 0 bytes and 0 tokens; a null
``doc_id`` stays null; repeated rows are counted each; other columns of the
input are not read.  Character classes and case come from the installed
``regex`` and ``unicodedata``; letters assigned only in the newest Unicode
versions (five small blocks) may be classed otherwise by the tokenizer.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from jobmix.llm.common import arrow_schema, map_batches, table

SCHEMA = arrow_schema({"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(),
                       "over_limit": pa.bool_()})
SEPARATORS = re.compile("[\x1c-\x1f]")
WORDS = regex.compile(r"[^\s]+")
NO_RANK = np.iinfo(np.int64).max
# Texts of at most this many characters are split and merged together.
BATCH_CHARS = 4_000_000
# Counts of about this many distinct words are remembered per task, and as many older ones.
CACHE_WORDS = 500_000


def byte_alphabet() -> str:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the code
    points from 256 on, in byte order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(moved)) for b in range(256))


class MergeRanks:
    """Vocabulary ids and merge ranks of a BPE file with word ends, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.size = max(vocab.values()) + 1
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        self.first_id = np.array([vocab[c] for c in letters], np.int64)
        self.last_id = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        steps = {s["type"]: s for s in spec["pre_tokenizer"]["pretokenizers"]}
        self.pattern = regex.compile(steps["Split"]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, ``NO_RANK`` where there is none."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NO_RANK)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each (non-empty) pre-token."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.first_id[flat]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.last_id[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        result = np.ones(len(words), np.int64)
        rank = np.full(len(ids), NO_RANK)
        self._rank_pairs(ids, owner, rank, np.arange(len(ids) - 1))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_RANK
            result[owner[starts[done]]] = lengths[done]
            hit = (rank != NO_RANK) & (rank == np.repeat(lowest, lengths))
            hit = _every_other(hit)
            ids[hit] = self.made[rank[hit]]
            stay = np.repeat(~done, lengths)
            stay[1:] &= ~hit[:-1]
            # Only pairs with a merged symbol in them have a new rank.
            at = np.flatnonzero(hit[stay])
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            self._rank_pairs(ids, owner, rank, np.unique(np.r_[at, at[at > 0] - 1]))
        return result

    def _rank_pairs(self, ids: np.ndarray, owner: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Set ``rank`` of the pairs that begin at ``at``; across sequences there is none."""
        rank[at] = NO_RANK
        at = at[at < len(ids) - 1]
        at = at[owner[at] == owner[at + 1]]
        if len(at):
            rank[at] = self.ranks(ids[at], ids[at + 1])


def _every_other(hit: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring hits keep the first, third, ...: pairs may not overlap."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    at = np.flatnonzero(hit)
    first = np.r_[True, np.diff(at) != 1]
    run_start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    out = np.zeros_like(hit)
    out[at[(np.arange(len(at)) - run_start) % 2 == 0]] = True
    return out


def words_of(text: str) -> list[str]:
    """The parts of a text between white space.

    ``str.split()`` also parts at the four ASCII separators, which are not
    white space to the tokenizer.
    """
    if SEPARATORS.search(text):
        return WORDS.findall(text)
    return text.split()


def normalize(text: str) -> str:
    """NFC, white space to single blanks, each character's own lower case.

    Lower-casing is by character: a capital sigma becomes the same small
    letter at the end of a word as elsewhere.
    """
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Counter:
    """Counts tokens of texts; remembers the counts of words between batches.

    No pre-token holds white space, so a text's count is the sum over its
    words (its parts between white space), and a word is worked out once.
    """

    def __init__(self, path: str):
        self.ranks = MergeRanks(path)
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def _pieces(self, word: str) -> tuple[list[str], int]:
        """Pre-tokens of a word and the number of special strings in it."""
        plain = normalize(word)
        if plain.isalpha():
            return [plain], 0
        if plain[-1] in ",.!?;:" and plain[:-1].isalpha():
            return [plain[:-1], plain[-1]], 0
        parts = [word]
        if self.ranks.special is not None and "<|" in word:
            parts = self.ranks.special.split(word)
        find = self.ranks.pattern.findall
        return [w for p in parts for w in find(normalize(p))], len(parts) - 1

    def _learn(self, words: list[str]) -> None:
        split = [self._pieces(w) for w in words]
        pieces = list({p for found, _ in split for p in found})
        count = dict(zip(pieces, self.ranks.counts([p.encode() for p in pieces]).tolist()))
        for word, (found, special) in zip(words, split):
            self.known[word] = sum(map(count.__getitem__, found)) + special

    def count(self, texts: list[str]) -> list[int]:
        split = [words_of(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            # What the coming batches do not ask for is forgotten at the next turn.
            self.known, self.before = {}, self.known
        missing = {w for words in split for w in words}.difference(self.known)
        again = missing & self.before.keys()
        self.known.update((w, self.before[w]) for w in again)
        if new := list(missing - again):
            self._learn(new)
        return [sum(map(self.known.__getitem__, words)) for words in split]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text of ``docs``.

    ``path`` is a vocabulary file of the ``tokenizers`` library (BPE with
    word ends, lower case, white space dropped) that every executor can open.
    Map-only: no shuffle, one batch of texts in memory.
    """
    def run(batches):
        counter = Counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                chunk, size = [], 0
                start = at
                while at < batch.num_rows and (not chunk or size < BATCH_CHARS):
                    text = texts[at].as_py() or ""
                    chunk.append(text)
                    size += len(text)
                    at += 1
                tokens = counter.count(chunk)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, at - start), pa.array([len(t.encode()) for t in chunk], pa.int64()),
                     pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    schema=SCHEMA)

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
