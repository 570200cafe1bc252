"""Byte-pair encoding by a pair occurrence index, and its decoding.

The distinct words of a batch are laid out as one array of symbols with links to the neighbours. An index maps every pair
that has a rank to all its positions. Ranks that are active are taken in ascending order from a heap; a rank's positions
are merged from left to right, and only the lists of the pairs that this breaks or makes are updated. A merge only makes
pairs of higher rank (checked when the vocabulary is read), so this gives what merging word by word gives.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from keyloom.llm.common import documents, map_slices, map_texts

#: Characters of texts that are encoded together, of distinct words that one index holds, and words that a task remembers.
TEXT_CHARS, INDEX_CHARS, REMEMBERED = 1_000_000, 300_000, 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is a visible Latin-1 character, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary file of the `tokenizers` library with byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in self.ids.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            if max(made.get(a, -1), made.get(b, -1)) >= rank or c in made:
                raise ValueError(f"merge {rank} doesn't follow the merges it builds on")
            self.rank[a, b] = made[c] = rank
            self.merged.append(c)
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        self.steps = [(s["type"], regex.compile(s["pattern"]["Regex"]) if "pattern" in s else None, s.get("content")) for s in steps]
        pre = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        cut = next(p for p in pre if p["type"] in ("Split", "ByteLevel"))
        self.words = regex.compile(cut["pattern"]["Regex"] if cut["type"] == "Split" else r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        letters = byte_letters()
        self.plain = [self.ids[x] for x in letters]
        self.last = [self.ids[x + self.suffix] for x in letters]
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.decoder = spec["decoder"] and spec["decoder"]["type"]
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"no decoder {self.decoder}")
        self.of_letter = {x: b for b, x in enumerate(letters)}

    def normal(self, text: str) -> str:
        for kind, pattern, content in self.steps:
            if kind == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = pattern.sub(content, text)
            elif kind == "Lowercase":
                text = lower(text)
            else:
                raise ValueError(f"no normalizer {kind}")
        return text

    def pieces(self, text: str) -> list[str | int]:
        """Words in order; ids where the text holds an added token's own string."""
        if not self.special or "<|" not in text:
            return self.words.findall(self.normal(text))
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(text):
            out += self.words.findall(self.normal(text[at : m.start()]))
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.words.findall(self.normal(text[at:]))

    def decode(self, ids: list[int]) -> str:
        """Without a decoder, the tokens' strings with a space between; else the bytes they stand for."""
        if self.decoder is None:
            return " ".join(map(self.names.__getitem__, ids))
        out = bytearray()
        for i in ids:
            name = self.names[i]
            out += bytes(self.of_letter[x] for x in name) if all(x in self.of_letter for x in name) else name.encode()
        return out.decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary_at(path: str) -> Vocabulary:
    """Read once a Python worker, not once a task."""
    return Vocabulary(path)


def lower(text: str) -> str:
    """Lower case a character at a time, so that a final sigma doesn't depend on its place."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def encode_words(vocabulary: Vocabulary, words: list[str]) -> dict[str, list[int]]:
    """The ids of each distinct word, by one pair occurrence index over all of them."""
    symbol: list[int] = []
    starts = []
    plain = vocabulary.plain
    for w in words:
        starts.append(len(symbol))
        raw = w.encode()
        symbol += [plain[b] for b in raw]
        symbol[-1] = vocabulary.last[raw[-1]]
        symbol.append(-1)  # no pair reaches over it
    n = len(symbol)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    ranks, merged = vocabulary.rank.get, vocabulary.merged
    index: dict[int, list[int]] = {}
    for at, pair in enumerate(zip(symbol, symbol[1:], strict=False)):
        if (rank := ranks(pair)) is not None:
            index.setdefault(rank, []).append(at)
    heap = list(index)
    heapq.heapify(heap)
    pair_of = list(vocabulary.rank)
    while heap:
        rank = heapq.heappop(heap)
        a, b = pair_of[rank]
        c = merged[rank]
        for at in sorted(index.pop(rank)):
            right = after[at]
            if symbol[at] != a or symbol[right] != b:  # a merge since then took one of the two
                continue
            symbol[at], symbol[right] = c, -2
            beyond = after[at] = after[right]
            before[beyond] = at
            if (other := ranks((c, symbol[beyond]))) is not None:
                if other not in index:
                    index[other] = []
                    heapq.heappush(heap, other)
                index[other].append(at)
            left = before[at]
            if left >= 0 and (other := ranks((symbol[left], c))) is not None:
                if other not in index:
                    index[other] = []
                    heapq.heappush(heap, other)
                index[other].append(left)
    ends = [*starts[1:], n]
    return {w: [x for x in symbol[s : e - 1] if x != -2] for w, s, e in zip(words, starts, ends, strict=True)}


def _slices(doc_ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """So many documents at a time that memory goes with the longest text and not with the batch."""
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= TEXT_CHARS or k == len(texts) - 1:
            yield doc_ids[at : k + 1], texts[at : k + 1]
            at, size = k + 1, 0


class _Encoder:
    """A task's vocabulary and the words that it remembers."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary_at(path)
        self.known: dict[str, list[int]] = {}

    def encoded(self, doc_ids: list, texts: list[str]) -> Iterator[tuple[int | None, list[int]]]:
        """Document and token ids; the index of a slice covers its words not yet known."""
        for ids, some in _slices(doc_ids, texts):
            cut = [self.vocabulary.pieces(t) for t in some]
            if len(self.known) > REMEMBERED:
                self.known = {}
            known = self.known
            new: dict[str, None] = {}
            size = 0
            for words in cut:
                for w in words:
                    if w not in known and w not in new and w.__class__ is str:
                        new[w] = None
                        size += len(w)
                if size > INDEX_CHARS:
                    known |= encode_words(self.vocabulary, list(new))
                    new, size = {}, 0
            known |= encode_words(self.vocabulary, list(new)) if new else {}
            for doc_id, words in zip(ids, cut, strict=True):
                one: list[int] = []
                for w in words:
                    one += known[w] if w.__class__ is str else [w]
                yield doc_id, one


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: a row for each row of docs, repeated and null ids included; whole texts, however long, null and
    empty ones give no ids. No special tokens are added; a special token's own string in a text becomes that token. Of
    pairs of one rank the leftmost is merged first. An empty table gives no rows; other columns are ignored. The vocabulary
    file has to be at this path on every executor."""

    def rows(encoder, doc_ids, texts):
        return encoder.encoded(doc_ids, texts)

    return map_slices(documents(docs, id_col, text_col), rows, "doc_id long, ids array<int>", lambda: _Encoder(vocabulary_path))


def decode(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows with token ids, special tokens included; null ids as none."""

    def row(vocabulary, doc_id, ids):
        return doc_id, vocabulary.decode(ids or [])

    return map_texts(encoded.select("doc_id", ids_col), row, "doc_id long, text string", lambda: vocabulary_at(vocabulary_path))


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes, and keeps digests of both in one pass. Rows as encode."""

    def rows(encoder, doc_ids, texts):
        for doc_id, ids in encoder.encoded(doc_ids, texts):
            yield doc_id, len(ids), _sha(" ".join(map(str, ids))), _sha(encoder.vocabulary.decode(ids))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(documents(docs, id_col, text_col), rows, schema, lambda: _Encoder(vocabulary_path))
