"""BPE encoding and decoding by a prefix-sharing trie of the distinct words.

The encoding of a prefix is fixed by its last token: that token's start is a shorter
prefix, whose encoding comes before it.  A token may follow another one exactly if
merging their two strings leaves them as two tokens.  So the distinct words of a block
go into a trie, a depth-first walk gives every node the last token of its prefix from the
nodes above, and shared prefixes are encoded once.  Words are ends of paths; their last
token is one that closes a word.

Texts are encoded where they are read: nothing is shuffled, a task's memory is the block,
the vocabulary and two bounded caches.  Lost tasks are simply run again.

Defined cases: null and empty texts have no tokens; texts of any length and words of any
length are encoded whole; strings of the special tokens in a text become those tokens, as
the library does by default; repeated rows are repeated in the result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import blocks, release, with_fields

INF = 1 << 60
LONG_WORD = 512
"""Longer words are walked alone instead of being put into the trie, with the same steps."""
STABLE = "\u0250"
"""Below it, the categories of letters are the same in all versions of Unicode."""
BLOCK = 4 * 1024 * 1024
"""Bytes of text whose words share a trie."""
CACHE = 250_000
"""Entries of each of the two generations of a worker's caches."""

# fixed values: the normalisation and splitting rules that the vocabulary file states
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


def ends(table: dict[str, int]) -> dict[str, list[int]]:
    """The lengths of the tokens that end with two given characters, longest first."""
    found: dict[str, set[int]] = {}
    for s in table:
        if len(s) > 1:
            found.setdefault(s[-2:], set()).add(len(s))
    return {k: sorted(v, reverse=True) for k, v in found.items()}


class Recent:
    """A cache of two generations: entries that are used stay, the size is bounded."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def clear(self) -> None:
        self.new, self.old = {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are not held; those of the older generation move up."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        left = keys - self.new.keys()
        for k in left & self.old.keys():
            self.new[k] = self.old[k]
        return list(left - self.new.keys())


class Vocabulary:
    """The tables of a vocabulary file, and the trie walk over them."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or SPLIT not in text.encode().decode("unicode_escape") or not self.suffix:
            raise ValueError("this operator reads word-level vocabularies: NFC, white space, lower case, word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        reach = [self.ids[s] for c in byte_alphabet() for s in (c, c + self.suffix) if s in self.ids]
        for (a, b), r in self.rank.items():
            new = self.ids[self.strings[a] + self.strings[b]]
            if new not in self.parts and self.meet(a, b):
                self.parts[new] = (a, b, r)
                reach.append(new)
        #: Tokens inside a word, and tokens that close one, by their characters.
        self.inner = {self.strings[i]: i for i in reach if not self.strings[i].endswith(self.suffix)}
        self.final = {self.strings[i][: -len(self.suffix)]: i for i in reach if self.strings[i].endswith(self.suffix)}
        self.chars = {i: len(s) for t in (self.inner, self.final) for s, i in t.items()}
        self.longest = max(self.chars.values())
        self.inner_ends, self.final_ends = ends(self.inner), ends(self.final)
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.words = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_str(text)
        self.word_cache, self.chunk_cache = Recent(CACHE), Recent(CACHE)

    def edge(self, token: int, side: int) -> tuple:
        """The tokens that stand at one end of a token while it is being merged, each with the merge that ends it."""
        known = self.left if side == 0 else self.right
        if token not in known:
            if token in self.parts:
                part, r = self.parts[token][side], self.parts[token][2]
                below = self.edge(part, side)
                known[token] = (*below[:-1], (below[-1][0], max(r, below[-2][1] if len(below) > 1 else r)), (token, INF))
            else:
                known[token] = ((token, INF),)
        return known[token]

    def meet(self, a: int, b: int) -> bool:
        """Whether merging the characters of both first gives exactly these two tokens."""
        xs, ys = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while i < len(xs) - 1 or j < len(ys) - 1:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            across = self.rank.get((x, y), INF)
            # Of equal merges the leftmost comes first: the one inside a, then the one across, then the one inside b.
            if x_ends <= y_ends:
                if across < x_ends:
                    return False
                i += 1
            else:
                if across <= y_ends:
                    return False
                j += 1
        return True

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may come right after token ``a``."""
        key = a << 32 | b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 8 * self.word_cache.most // 3:
                self.fits.clear()
            ok = self.fits[key] = (a, b) not in self.rank and self.meet(a, b)
        return ok

    def last_token(self, tail: str, depth: int, last: list[int], table: dict[str, int], lengths: dict[str, list[int]]) -> int:
        """Last token of the prefix of ``depth`` characters that ends with ``tail``."""
        fits = self.fits
        for n in lengths.get(tail[-2:], ()):
            if n <= depth and (t := table.get(tail[-n:])) is not None:
                if n == depth:
                    return t
                before = last[depth - n]
                ok = fits.get(before << 32 | t)
                if ok or ok is None and self.follows(before, t):
                    return t
        return table[tail[-1]]

    def path_tokens(self, tail: str, depth: int, last: list[int]) -> list[int]:
        """The tokens of the word whose characters but the closing state lie on the path."""
        t = self.last_token(tail, depth, last, self.final, self.final_ends)
        out = [t]
        depth -= self.chars[t]
        while depth:
            out.append(last[depth])
            depth -= self.chars[last[depth]]
        return out[::-1]

    def walk(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Tokens of distinct words in byte letters: a trie, walked depth first."""
        root: dict = {}
        out: dict[str, list[int]] = {}
        for w in words:
            if len(w) > LONG_WORD:
                out[w] = self.chain(w)
                continue
            node = root
            for c in w:
                nxt = node.get(c)
                if nxt is None:
                    nxt = node[c] = {}
                node = nxt
            node[""] = w
        last = [0] * (LONG_WORD + 1)
        stack = [(root, "", 0)]
        window, final, inner = self.longest, self.path_tokens, self.last_token
        while stack:
            node, tail, depth = stack.pop()
            if depth:
                if "" in node:
                    out[node[""]] = final(tail, depth, last)
                    if len(node) == 1:
                        continue
                last[depth] = inner(tail, depth, last, self.inner, self.inner_ends)
            for c, child in node.items():
                if c:
                    stack.append((child, (tail + c)[-window:], depth + 1))
        return out

    def chain(self, word: str) -> list[int]:
        last = [0] * (len(word) + 1)
        for d in range(1, len(word)):
            last[d] = self.last_token(word[max(0, d - self.longest) : d], d, last, self.inner, self.inner_ends)
        return self.path_tokens(word[-self.longest :], len(word), last)

    def split(self, chunk: str) -> list[str | int]:
        """Words in byte letters, and ids of special tokens, of a text without white space."""
        out: list[str | int] = []
        for part in self.marks.split(chunk) if self.marks else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out += [w.translate(self.bytes) for w in self.words.findall(part.lower())]
            elif part and max(part) < STABLE:
                out += [w.encode().decode("latin-1").translate(self.bytes) for w in self.words.findall(unicodedata.normalize("NFC", part).lower())]
            elif part:
                # Letters of other scripts: the library's own tables, which may be of another Unicode version.
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the encodings of white-space-free chunks into the cache."""
        missing = self.chunk_cache.missing(chunks)
        split = {c: self.split(c) for c in missing}
        unknown = self.word_cache.missing({w for ws in split.values() for w in ws if isinstance(w, str)})
        self.word_cache.new.update(self.walk(unknown))
        known = self.word_cache.new
        for c, ws in split.items():
            ids: list[int] = []
            for w in ws:
                if isinstance(w, str):
                    ids += known[w]
                else:
                    ids.append(w)
            self.chunk_cache.new[c] = (" ".join(map(str, ids)), self.decode(ids))

    def encode_block(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids joined by one space, and those ids decoded."""
        cut = [pieces(t) for t in texts]
        self.learn({c for cs in cut for c in cs})
        get = self.chunk_cache.new
        out = []
        for cs in cut:
            both = [x for c in cs if (x := get[c])[0]]
            out.append((" ".join([x[0] for x in both]), " ".join([x[1] for x in both])))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the file names no decoder, so tokens are joined by one space; unknown ids are left out."""
        get = self.strings.get
        return " ".join([s for i in ids if (s := get(i)) is not None])


def pieces(text: str | None) -> list[str]:
    """The parts of a text between white space (which these separators are not)."""
    if not text:
        return []
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return regex.findall(r"\S+", text)
    return text.split()


@lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def read_vocabulary(path: str) -> str:
    """The file's text; it is of fixed size (a few MB) and goes to the tasks with the function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, column: str = "text", digests: bool = False, ids: bool = True, cache: int = CACHE, block: int = BLOCK, keep: bool = True) -> DataFrame:
    """The other columns of ``docs``, ``n_tokens`` and, as asked, ``ids`` (array) and digests of ids and decoded text.

    Columns of ``docs`` with one of these names give way to the new ones.  ``cache`` and
    ``block`` trade a worker's memory for time, as does ``keep`` (the cache stays for the
    worker's next task); the result is the same.
    """
    new = {"n_tokens": "bigint"} | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {}) | ({"ids": "array<int>"} if ids else {})
    kept = [c for c in docs.columns if c != column and c.lower() not in new]
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(spec.value)
        vocab.word_cache.most = vocab.chunk_cache.most = cache
        collecting = gc.isenabled()
        gc.disable()  # tries are many small objects without cycles
        try:
            for batch in blocks(batches, column, block):
                both = vocab.encode_block(batch.column(column).to_pylist())
                arrays = [batch.column(c) for c in kept]
                counts = [i.count(" ") + 1 if i else 0 for i, _ in both]
                arrays.append(pa.array(counts, pa.int64()))
                if digests:
                    arrays += [pa.array([hashlib.sha256(x[k].encode()).hexdigest() for x in both], pa.string()) for k in (0, 1)]
                if ids:
                    flat = np.fromstring(" ".join(i for i, _ in both if i), np.int32, sep=" ")
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])
        finally:  # the worker goes on with tasks of other stages
            if collecting:
                gc.enable()
            if not keep:
                vocab.word_cache.clear()
                vocab.chunk_cache.clear()
                vocab.fits.clear()
                release()

    return docs.select(*kept, column).mapInArrow(run, with_fields(kept, docs.schema, **new))


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The other columns and ``text``, the ids decoded (null and empty arrays: empty text)."""
    kept = [c for c in encoded.columns if c != column and c.lower() != "text"]
    spec = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(spec.value)
        for batch in batches:
            texts = [vocab.decode(x or ()) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return encoded.select(*kept, column).mapInArrow(run, with_fields(kept, encoded.schema, text="string"))
