"""BPE encoding by a depth-first walk over the trie of distinct words, and decoding.

Of a batch of texts every distinct word is encoded once. Sorted words are the pre-order of
their trie: what a word shares with the one before it is the branch that both lie on, and the
stack holds the state of each node of the current branch. The state of a node is the last
token of its prefix's encoding. A token may follow the encoding of the text before it exactly
if BPE, run on it and the token before it, leaves the two as they are; so a node's state
follows from the states above it, and prefixes shared by words are worked out once.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
#: Words and token pairs that a worker remembers; reached, they are forgotten and met anew.
CACHED_WORDS = 500_000
CACHED_PAIRS = 1_500_000
#: Characters of text whose distinct words share a trie.
BATCH_CHARS = 4_000_000


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Vocabulary with word ends, lower case, white space dropped. Ids and texts as the tokenizers library gives them."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.letters = _byte_letters()
        self.spelled = {v: k for k, v in model["vocab"].items()}
        self.spelled |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        as_byte = {c: bytes([b]) for b, c in enumerate(self.letters)}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            where, stem = (self.final, token[: -len(self.end)]) if token.endswith(self.end) and token != self.end else (self.inner, token)
            where[b"".join(as_byte[c] for c in stem)] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, str, str]] = {}

    def _symbols(self, token: int) -> list[str]:
        text = self.spelled[token]
        if token in self.special.values():
            return [text]
        stem = text.removesuffix(self.end)
        symbols = list(stem)
        if text != stem:
            symbols[-1] += self.end
        return symbols

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the pair of lowest rank merges first, the leftmost of equals."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def follows(self, before: int, token: int) -> bool:
        """Whether BPE leaves the two tokens as they are; ``before`` -1 stands for the start of a word."""
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            first = [] if before < 0 else [before]
            symbols = [s for t in [*first, token] for s in self._symbols(t)]
            known = self.pairs[key] = self._merged(symbols) == [self.spelled[t] for t in [*first, token]]
        return known

    def _last(self, word: bytes, stop: int, table: dict[bytes, int], states: list[int]) -> tuple[int, int]:
        """Last token of the encoding of ``word[:stop]`` and where it starts."""
        for start in range(max(0, stop - self.longest), stop):
            token = table.get(word[start:stop])
            if token is not None and self.follows(states[start], token):
                return token, start
        raise ValueError(f"no token ends at {stop} of {word!r}")

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Ids of distinct words, in sorted order: the walk over their trie."""
        before = b""
        states, starts = [-1], [0]
        for word in sorted(words):
            shared, most = 0, min(len(states), len(word)) - 1
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], starts[shared + 1 :]
            for stop in range(shared + 1, len(word)):
                token, start = self._last(word, stop, self.inner, states)
                states.append(token)
                starts.append(start)
            token, at = self._last(word, len(word), self.final, states)
            ids = [token]
            while at:
                ids.append(states[at])
                at = starts[at]
            before = word
            yield word, ids[::-1]

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if "<|" in text and len(parts := self.parts.split(text)) > 1:
            return [w for part in parts for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Letters become small one by one, so a final sigma is not treated as such.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pieces.findall(text.lower())

    def learn(self, words: set[str]) -> None:
        """Encode what is not known yet: number of tokens, ids as text, tokens as text."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = list(words)
        for text, token in self.special.items():
            self.words[text] = (1, str(token), text)
        spelled = {w.encode(): w for w in new if w not in self.special}
        for raw, ids in self.encode_words(list(spelled)):
            self.words[spelled[raw]] = (len(ids), " ".join(map(str, ids)), " ".join(self.spelled[i] for i in ids))

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.words[w][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens as they are spelled, with a blank between two: the vocabulary names no other way to join them."""
        return " ".join(self.spelled[i] for i in ids)


@lru_cache(maxsize=2)
def vocabulary(file: str | None = None) -> WordBpe:
    """The worker's own copy, loaded once. Without a path the installed vocabulary file is used."""
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path(TOKENIZER)
    return WordBpe(file)


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _known(bpe: WordBpe, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, str, str]]]]:
    """For each text its words' entries, learned batch by batch."""
    for start, stop in _batches(texts):
        words = [bpe.split(t) for t in texts[start:stop]]
        bpe.learn(set().union(*words))
        for i, of in enumerate(words, start):
            yield i, list(map(bpe.words.__getitem__, of))


def encode(docs: DataFrame, file: str | None = None) -> DataFrame:
    """Rows (doc_id, ids): the encoding of every whole text.

    Cases: a null or empty text, and one of white space only, has no ids; texts of special
    tokens' spelling give those tokens, as in the library; repeated rows are encoded each;
    an empty table gives no rows; extra columns are ignored. Texts are worked through in
    batches of bounded size; a single long text is a batch of its own.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(file)
        for frame in frames:
            ids: list[list[int]] = [[] for _ in range(len(frame))]
            for i, entries in _known(bpe, frame["text"].tolist()):
                ids[i] = [int(x) for _, text, _ in entries for x in text.split()]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": ids})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, file: str | None = None) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids); null ids give empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(file)
        for frame in frames:
            texts = [bpe.decode(list(ids) if ids is not None else []) for ids in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts})

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")


def token_digests(docs: DataFrame, file: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every whole text, and keeps digests.

    Cases as in ``encode``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(file)
        for frame in frames:
            n: list[int] = [0] * len(frame)
            ids: list[str] = [""] * len(frame)
            decoded: list[str] = [""] * len(frame)
            for i, entries in _known(bpe, frame["text"].tolist()):
                n[i] = sum(e[0] for e in entries)
                ids[i] = hashlib.sha256(" ".join([e[1] for e in entries]).encode()).hexdigest()
                decoded[i] = hashlib.sha256(" ".join([e[2] for e in entries]).encode()).hexdigest()
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
