"""SentencePiece (merge type) encoding by a table of each prefix's last token.

In a merge-type vocabulary every prefix of a text has exactly one last token:
cutting the last token off an encoding leaves the encoding of what is before
it.  So one pass over the text fills a table, *last token of the prefix that
ends here*: an Aho-Corasick automaton over the pieces names the candidates
that end at a position, and a candidate holds when it is compatible with the
last token of the prefix before it.  The ids are then read backwards from the
table.  Two tokens are compatible when encoding their joined text gives just
these two, which :meth:`PieceModel.compatible` decides by undoing merges.

Pieces hold the blank mark only at their start, so no merge crosses from a
letter to a following blank mark; texts are encoded word by word and the
words' results remembered.  The model file is checked for that property; for
a model without it the whole text is one word.

Results for odd input: a null or empty text has no tokens, and decodes to the
empty text; a null ``doc_id`` stays null; repeated rows are encoded each;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from jobmix.llm.common import arrow_schema, map_rows, table

BLANK = "▁"
SCHEMA = arrow_schema({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(),
                       "decoded_sha256": pa.string()})
# Words up to this length are remembered, at most twice this many at a time.
CACHE_CHARS, CACHE_WORDS = 40, 300_000
# Remembered outcomes of the compatibility test.
CACHE_PAIRS = 1_000_000
# Larger than any piece id: a pair of ids as one number.
PAIR_BASE = 1 << 32


class RecentWords:
    """A bounded memory of results: when it is full, what was not asked for since goes."""

    def __init__(self, limit: int = CACHE_WORDS):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PieceModel:
    """Pieces, their merge order and the encoder of one ``.model`` file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        self.unknown = sp.unk_id()
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.id = {self.piece[i]: i for i in normal}
        # Merge order: best score first.  Single characters are there from the start.
        score = {i: sp.get_score(i) for i in normal}
        self.order = {i: (-1.0 if len(self.piece[i]) == 1 else -score[i]) for i in normal}
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.id)
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            parts = self._last_merge(self.piece[i])
            if parts is not None:
                self.parts[i] = parts
                self.automaton.add_word(self.piece[i], i)
        self.automaton.make_automaton()
        self.length = list(map(len, self.piece))
        self.pairs: dict[int, bool] = {}
        self.words = RecentWords()

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece``; None if merging never makes it.

        Works on the piece alone, one best merge at a time.
        """
        symbols = list(piece)
        if len(symbols) == 1:
            return (-1, -1)
        while len(symbols) > 2:
            best = min(((self.order[j], i) for i in range(len(symbols) - 1)
                        if (j := self.id.get(symbols[i] + symbols[i + 1])) is not None), default=None)
            if best is None:
                return None
            at = best[1]
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        left, right = (self.id.get(s) for s in symbols)
        return None if left is None or right is None else (left, right)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of both tokens ends in just these two.

        Goes back in time from the finished pair.  At each point two symbols
        meet at the border, until one of them is merged away from it; if the
        two would have merged with each other before that (between equal
        pieces the one further left goes first), the pair is impossible.
        Then the younger of the two is taken apart, down to single characters.
        """
        a, b, until, last_wins = left, right, float("inf"), False
        order, result = self.order, True
        while True:
            joined = self.id.get(self.piece[a] + self.piece[b])
            if joined is not None:
                when = order[joined]
                if when < until or (last_wins and when == until):
                    result = False
                    break
            if order[a] < 0 and order[b] < 0:
                break
            if order[a] > order[b]:
                until, last_wins = order[a], False
                a = self.parts[a][1]
            else:
                until, last_wins = order[b], True
                b = self.parts[b][0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left * PAIR_BASE + right] = result
        return result

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a text part that no merge leaves; unknown characters become bytes."""
        last = [-1] * len(word)  # the last token of the prefix ending here; -1: an unknown character
        known, length = self.pairs.get, self.length
        filled = -1
        # Matches come in order of their end; the first that fits is the only one.
        for end, token in self.automaton.iter(word):
            if end == filled:
                continue
            before = end - length[token]
            if before >= 0 and (prev := last[before]) >= 0:
                fits = known(prev * PAIR_BASE + token)
                if fits is None:
                    fits = self.compatible(prev, token)
                if not fits:
                    continue
            last[end] = token
            filled = end
        ids: list[int] = []
        at = len(word) - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= length[token]
            else:
                ids.extend(self.byte_id[b] for b in reversed(word[at].encode()))
                at -= 1
        ids.reverse()
        return tuple(ids)

    def words_of(self, text: str) -> list[str]:
        """The marked text in parts that are encoded on their own."""
        if not text:
            return []
        marked = text.replace(" ", BLANK)
        if not self.by_word:
            return [BLANK + marked]
        if BLANK + BLANK not in marked and marked[0] != BLANK:
            return [BLANK + w for w in marked.split(BLANK)] if marked[-1] != BLANK else \
                [BLANK + w for w in marked[:-1].split(BLANK)] + [BLANK]
        # A part is a run of marks and the characters up to the next mark.
        parts, run = [], BLANK
        for w in marked.split(BLANK):
            if w:
                parts.append(run + w)
                run = BLANK
            else:
                run += BLANK
        if len(run) > 1:
            parts.append(run[1:])
        return parts

    def word_ids(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.encode_word(word)
            if len(word) <= CACHE_CHARS:
                self.words.put(word, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words_of(text) for i in self.word_ids(w)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces joined, byte tokens read as UTF-8, first blank dropped."""
        out, raw = [], bytearray()
        first_byte = self.byte_id[0]
        for i in ids:
            if first_byte <= i < first_byte + 256:
                raw.append(i - first_byte)
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.piece[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    ``path`` is a merge-type ``.model`` file that every executor can open.
    ``with_ids`` / ``with_text`` add the ids and the decoded text themselves.
    Map-only: no shuffle, a few texts in memory at a time.
    """
    fields = dict(zip(SCHEMA.names, SCHEMA.types))
    if with_ids:
        fields["ids"] = pa.list_(pa.int64())
    if with_text:
        fields["decoded"] = pa.string()

    def make():
        model = PieceModel(path)
        shown = RecentWords()

        def of_word(word: str) -> tuple[int, str, str, tuple[int, ...]]:
            """Of a word: number of ids, ids as text, decoded text (first blank kept), ids."""
            found = shown.get(word)
            if found is None:
                ids = model.encode_word(word)
                found = len(ids), ",".join(map(str, ids)), " " + model.decode(ids), ids if with_ids else ()
                if len(word) <= CACHE_CHARS:
                    shown.put(word, found)
            return found

        def row(doc_id, text):
            known = shown.young.get
            parts = [known(w) or of_word(w) for w in model.words_of(text or "")]
            decoded = "".join([p[2] for p in parts])[1:]
            result = (doc_id, sum([p[0] for p in parts]),
                      hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest(),
                      hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                result += ([i for p in parts for i in p[3]],)
            if with_text:
                result += (decoded,)
            return result
        return row

    columns = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return map_rows(columns, make, arrow_schema(fields))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
