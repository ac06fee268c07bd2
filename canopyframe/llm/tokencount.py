"""Greedy word-piece lengths by a linear longest-match automaton.

A word is matched as the vocabulary's word mark followed by its characters: the longest piece at its
start, then the longest at what is left, and so on. The automaton is the vocabulary's trie; a node
that cannot go on pops the pieces that greedy matching would have taken from its string and falls
back, over a failure link, to the node of what remains. Popped counts are summed beforehand, so a
word costs a few steps per character and no piece is built. A character that is no piece of its own
counts as one token per UTF-8 byte (byte fallback).

Scale. One pass over the texts, no shuffle; the automaton is built once in each Python worker from a
vocabulary path, which must be at hand on every executor. A worker remembers the lengths of at most
``REMEMBERED`` distinct words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.textio import byte_slices, space_words

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
REMEMBERED = 200_000
RESULT = "struct<n_words:bigint,n_tokens:bigint,n_byte_tokens:bigint>"


class Automaton:
    """``child[node][char]``, ``fail[node]`` and the popped ``tokens[node]`` and ``by_bytes[node]``."""

    def __init__(self, pieces: list[str]):
        pieces = [x for x in dict.fromkeys(pieces) if x]
        self.child: list[dict[str, int]] = [{}]
        last: list[tuple[int, int] | None] = [None]  # (tokens, of them bytes) of a node that is a piece
        singles = {c for x in pieces for c in x}.difference(pieces)
        for piece in [*pieces, *sorted(singles)]:
            node = 0
            for c in piece:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    last.append(None)
                node = self.child[node][c]
            size = len(piece.encode())
            last[node] = (size, size) if piece in singles else (1, 0)
        self.fail, self.tokens, self.by_bytes = ([0] * len(self.child) for _ in range(3))
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if last[v] is not None:
                        self.tokens[v], self.by_bytes[v] = last[v]
                        continue
                    # every character is a piece, so falling back always ends at a node with this child
                    z, t, b = self.fail[u], self.tokens[u], self.by_bytes[u]
                    while c not in self.child[z]:
                        t, b, z = t + self.tokens[z], b + self.by_bytes[z], self.fail[z]
                    self.fail[v], self.tokens[v], self.by_bytes[v] = self.child[z][c], t, b
            level = below

    def length(self, word: str) -> tuple[int, int]:
        """Tokens of a marked word, and how many of them are single bytes."""
        child, fail, pops, byte_pops = self.child, self.fail, self.tokens, self.by_bytes
        node = tokens = in_bytes = 0
        for c in word:
            while c not in child[node]:
                if not node:
                    size = len(c.encode())
                    tokens, in_bytes = tokens + size, in_bytes + size
                    break
                tokens, in_bytes, node = tokens + pops[node], in_bytes + byte_pops[node], fail[node]
            else:
                node = child[node][c]
        while node:
            tokens, in_bytes, node = tokens + pops[node], in_bytes + byte_pops[node], fail[node]
        return tokens, in_bytes


class Lengths(dict):
    """Lengths of words as bytes, worked out when first met."""

    def __init__(self, automaton: Automaton, mark: str = MARK):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self.automaton.length(self.mark + word.decode())
        if len(word) < 100:
            self[word] = got
        return got


def load_pieces(path: str | None = None) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary: no control, unknown or byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if plain(i)]


_lengths: dict[str | None, Lengths] = {}


def count_column(text: Column, vocabulary: str | None = None) -> Column:
    @F.arrow_udf(RESULT)
    def kernel(texts: pa.Array) -> pa.Array:
        if vocabulary not in _lengths:
            _lengths[vocabulary] = Lengths(Automaton(load_pieces(vocabulary)))
        lengths, rows = _lengths[vocabulary], []
        for part in byte_slices(texts):
            for x in part:
                words = space_words(x)
                got = [lengths[w] for w in words]
                rows.append((len(words), sum(t for t, _ in got), sum(b for _, b in got)))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_tokens", "n_byte_tokens"])

    return kernel(text)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_words, n_tokens, n_byte_tokens``.

    Words are runs without space, tab or line end. Null and empty texts have none. Rows with a null id
    and repeated rows stay. Other columns are not looked at. An empty table gives an empty result.
    Texts are read whole.
    """
    return docs.select(F.col(id_col), count_column(F.col(text_col), vocabulary).alias("v")).select(id_col, "v.*")
