"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix ends in one token, and what stands before that token is
the encoding of a shorter prefix. So the state of a trie node is its last token
alone. The distinct words of a batch are put in a trie (their sorted list, where
a common prefix is a shared path) and walked depth first; a node's last token is
the one token that ends there and may follow the last token of the node where it
starts. Shared prefixes are worked out once; a word's ids are read back along
its last tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = "</w>"
TAIL = 3
CHUNKS_KEPT, PAIRS_KEPT, TRIE_WORDS = 300_000, 300_000, 20_000


class WordBPE:
    """Ids of words under ranked merges whose last symbol carries END."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocab = vocab
        self.rank = {pair: n for n, pair in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = {}
        for n, (a, b) in enumerate(merges):
            self.parts.setdefault(a + b, (a, b))
            self.made.setdefault(a + b, n)
        #: A token is made of earlier ones, else states may depend on more than the last token.
        self.proper = all(self.made.get(a, -1) < n and self.made.get(b, -1) < n for n, (a, b) in enumerate(merges))
        # Merging a token's own symbols must give it back: some entries can never be reached.
        self.inner = {t for t in vocab if not t.endswith(END) and self._merge(list(t)) == [t]}
        self.final = {t[: -len(END)]: t for t in vocab if t.endswith(END) and t != END and self.merged(t[: -len(END)]) == [t]}
        self.longest = max((len(t) for t in self.final), default=0)
        #: Lengths, longest first, of the tokens that end in the same TAIL symbols or have no more.
        tails: dict[str, set[int]] = {}
        for t in self.inner:
            tails.setdefault(t[-TAIL:], set()).add(len(t))
        for t, own in tails.items():
            for k in range(1, len(t)):
                own |= {n for n in tails.get(t[k:], ()) if n < TAIL}
        self.tails = {t: sorted(own, reverse=True) for t, own in tails.items()}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, word: str) -> list[str]:
        """Plain merging, lowest rank first, leftmost first: the definition."""
        symbols = [*word[:-1], word[-1] + END] if word else []
        return self._merge(symbols)

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.rank):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one end of a token while it is merged, with the rank of
        the merge that consumes it."""
        out, until = [], len(self.rank) + 1
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.made[token]
            token = self.parts[token][side]

    def follows(self, left: str, right: str) -> bool:
        """Whether both stay as they are side by side: no merge across the border
        comes before those that consume its two sides (the left one first, if
        they are the same merge)."""
        got = True
        ends = self._edge(right, 0)
        for x, x_until in self._edge(left, 1):
            for y, y_until in ends:
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    got = False
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[left, right] = got
        return got

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word, shared prefixes once."""
        out: dict[str, list[str]] = {}
        inner, final, longest, tails, follows, pairs = self.inner, self.final, self.longest, self.tails, self.follows, self.pairs
        path, last = "", [""]  # last[d]: last token of path[:d], None if the vocabulary lacks a symbol of it
        for word in sorted(set(words)):
            n = len(word)
            got: list[str] | None = None
            if self.proper:
                d, most = 0, min(len(path), n - 1)
                while d < most and path[d] == word[d]:
                    d += 1
                del last[d + 1 :]
                path = word[:-1]
                while d < n - 1:
                    d += 1
                    token = None
                    tail = path[d - TAIL if d > TAIL else 0 : d]
                    while tail not in tails and len(tail) > 1:
                        tail = tail[1:]
                    for size in tails.get(tail, ()):
                        if size > d:
                            continue
                        a = d - size
                        token = path[a:d]
                        if token in inner:
                            if not a:
                                break
                            left = last[a]
                            fits = pairs.get((left, token))
                            if (follows(left, token) if fits is None else fits) if left is not None else False:
                                break
                    else:
                        token = None
                    last.append(token)
                for a in range(n - longest if n > longest else 0, n):
                    if word[a:] in final:
                        token, left = final[word[a:]], last[a]
                        if not a or left is not None and (follows(left, token) if (fits := pairs.get((left, token))) is None else fits):
                            got = [token]
                            while a:
                                got.append(last[a])
                                a -= len(last[a])
                            got.reverse()
                            break
            out[word] = self.merged(word) if got is None else got
        return out


class Codec:
    """A tokenizer file: normalizer and word splitting are the library's, the
    encoding of words is WordBPE's. Chunks between spaces are remembered: no
    normalization, split or merge reaches over a space."""

    def __init__(self, path: str, chunks_kept: int = CHUNKS_KEPT) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        tok = Tokenizer.from_file(path)
        self.normalize, self.split = tok.normalizer.normalize_str if tok.normalizer else str, tok.pre_tokenizer.pre_tokenize_str
        self.bpe = WordBPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        names = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(names) + ")") if names else None
        self.token = {i: t for t, i in (model["vocab"] | self.added).items()}
        self.chunks = common.Known(chunks_kept)
        byte = tok.pre_tokenizer.pre_tokenize_str
        #: Letters whose normalized form is their lower case and that stand in one piece, with what the library makes of each.
        letters = [c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "\xaa\xb5\xba"]
        self.letter = {ord(c): "".join(p for p, _ in byte(self.normalize(c))) for c in letters}
        self.plain = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([,.!?;:]?)")

    def _learn(self, chunks: list[str]) -> None:
        """Put what the chunks give into the cache. A chunk of letters, with or
        without a stop, goes by way of its lower-case letters."""
        known, plain, letter = self.chunks, self.plain.fullmatch, self.letter
        bases: dict[str, tuple[str, str]] = {}
        words: dict[str, list[str]] = {}
        for c in chunks:
            if m := plain(c):
                bases[c] = (m[1].lower(), m[2])
            else:
                words[c] = [w for w, _ in self.split(self.normalize(c))]
        for base in known.unknown({base for base, _ in bases.values()} | {stop for _, stop in bases.values() if stop}):
            words[base] = [base.translate(letter)]
        order = list(words)
        for at in range(0, len(order), TRIE_WORDS):
            part = order[at : at + TRIE_WORDS]
            text = {w: self._written(tokens) for w, tokens in self.bpe.encode_words([w for c in part for w in words[c]]).items()}
            for c in part:
                known.new[c] = text[words[c][0]] if len(words[c]) == 1 else self._together([text[w] for w in words[c]])
        for c, (base, stop) in bases.items():
            if c != base:
                known.new[c] = self._together([known.new[base], known.new[stop]]) if stop else known.new[base]

    def _written(self, tokens: list[str]) -> tuple[str, str]:
        tokens = [t for t in tokens if t in self.bpe.vocab]
        return " ".join([str(self.bpe.vocab[t]) for t in tokens]), " ".join(tokens)

    @staticmethod
    def _together(parts: list[tuple[str, str]]) -> tuple[str, str]:
        return " ".join([p[0] for p in parts if p[0]]), " ".join([p[1] for p in parts if p[0]])

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(ids in decimal joined by spaces, decoded text, number of ids): as the
        library's encode(text, add_special_tokens=False) and its
        decode(ids, skip_special_tokens=False), which joins tokens by spaces."""
        known, cut = self.chunks, []
        known.turn()
        for text in texts:
            chunks: list[str] = []
            for k, piece in enumerate(self.special.split(text) if self.special and "<" in text else [text]):
                if k % 2:
                    known.new[piece] = (str(self.added[piece]), piece)
                    chunks.append(piece)
                else:
                    chunks += piece.split(" ")
            cut.append(chunks)
        self._learn(list(known.unknown(set().union(*cut))))
        out, get = [], known.new.__getitem__
        for chunks in cut:
            ids, back = zip(*map(get, chunks))
            if "" in ids:
                ids, back = filter(None, ids), filter(None, back)
            ids = " ".join(ids)
            out.append((ids, " ".join(back), ids.count(" ") + 1 if ids else 0))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces; ids that are not in the vocabulary are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def codec(path: str, chunks_kept: int = CHUNKS_KEPT) -> Codec:
    """The worker's codec for a file; its chunks outlive a task."""
    return common.worker_state(f"bpe {path} {chunks_kept}", lambda: Codec(path, chunks_kept))


def encoded(docs: DataFrame, path: str, text: str = "text", chunks_kept: int = CHUNKS_KEPT) -> DataFrame:
    """docs without the text, plus n_tokens long, token_ids (decimal ids joined
    by one space) and decoded (the text that those ids decode to); a column of
    docs of one of these names is replaced.

    Null is as empty: no ids and an empty text. Repeated rows are answered once
    each, an empty table gives no rows. chunks_kept bounds a worker's
    memory (two generations of about 300 bytes each), not what is encoded."""
    common.prepare(docs.sparkSession)
    kept = [c for c in common.without(docs, ["n_tokens", "token_ids", "decoded"]) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, chunks_kept)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            with common.uncollected():
                ids, back, n = zip(*coder.encode(texts)) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [*kept, "n_tokens", "token_ids", "decoded"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    return docs.mapInArrow(run, f"{kinds}n_tokens long, token_ids string, decoded string")


def id_array(token_ids: str = "token_ids"):
    """token_ids as array<int>."""
    c = F.col(token_ids)
    return F.when(F.length(c) == 0, F.array().cast("array<int>")).otherwise(F.split(c, " ").cast("array<int>"))
