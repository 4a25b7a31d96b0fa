"""BPE encoding and decoding with a tokenizers vocabulary file, by tree concatenation for long unsplit text.

White space always ends a word in the vocabularies this operator takes (BPE with a word-end suffix, no decoder),
so a text is the concatenation of its white-space chunks: chunks repeat and their ids are cached. A chunk without
a break longer than LEAF symbols is encoded as a tree: halves first, then growing windows around each join are
encoded again until their first and last token are those of the two halves. Every neighbouring pair of tokens of
the result then stands in some part that was encoded as a whole, which makes the result the encoding of the whole.
Texts of more than `split_bytes` are cut into pieces at white space, or into leaves inside a long chunk; pieces and
leaves are encoded in parallel tasks and put together by document.

Null and empty texts have no tokens and decode to the empty text. Null ids, repeated rows and other columns are
kept as they are; columns named `ids` or `n_tokens` are replaced by the operator's.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, written

#: Symbols in a leaf of the tree; shorter unsplit text goes to the library at once.
LEAF = 2048
#: Bytes from which a text is dealt out over tasks.
SPLIT_BYTES = 1 << 16
#: Bytes, about, of the chunks and words whose ids a task remembers: twice as many for either at most.
CACHE_BYTES = 8 << 20
#: Bytes that an entry takes besides its text and ids.
ENTRY_BYTES = 190
#: Chunks whose normal form is their lower case, and their words as the vocabulary parts them.
PLAIN = re.compile("[!-;=-~À-ÖØ-öø-įı-ɏ]+")
PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^a-zß-öø-ɏ0-9]+")
SPACE = re.compile(r"[ \t-\r]+")
#: Control characters that Python takes for white space and the vocabulary doesn't, and wide spaces.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


class Recent:
    """What was made lately; it forgets in halves, and everything when a task ends."""

    def __init__(self, make):
        self.make, self.new, self.old, self.size = make, {}, {}, 0

    def forget(self) -> None:
        self.new, self.old, self.size = {}, {}, 0

    def one(self, k: str):
        if (x := self.new.get(k)) is None:
            if (x := self.old.get(k)) is None:
                x = self.make(k)
            if len(k) < 64:
                if self.size >= CACHE_BYTES:
                    self.old, self.new, self.size = self.new, {}, 0
                self.new[k] = x
                self.size += len(k) + len(x) + ENTRY_BYTES
        return x

    def __call__(self, keys: list[str]) -> list:
        got = list(map(self.new.get, keys))
        for i in [i for i, x in enumerate(got) if x is None]:
            got[i] = self.one(keys[i])
        return got


class Bpe:
    """One vocabulary in one worker."""

    def __init__(self, path: str, leaf: int = LEAF):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core

        from tokenizers import Tokenizer

        self.lib, self.leaf = Tokenizer.from_file(path), leaf
        self.chunks, self.plain_words = Recent(self.chunk), Recent(self.plain_word)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if spec.get("decoder") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("a BPE vocabulary without decoder, subword prefix and byte fallback is needed")
        self.suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        self.ids = vocab
        self.text = {i: s for s, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = [x["content"] for x in spec["added_tokens"]]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (n, vocab[a + b]) for n, (a, b) in enumerate(pairs)}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.model, self.letters = self.lib.model, self._letters()
        #: Whether the vocabulary parts words as WORDS does: lower case, and no other special token than with <.
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lower = any(x["type"] == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        self.plain = parts[0].get("pattern") == {"Regex": PARTED} and lower and all("<" in x for x in self.special)
        self.table = np.array([self.text.get(i, "") for i in range(max(self.text) + 1)], dtype=object)

    def forget(self) -> None:
        self.chunks.forget()
        self.plain_words.forget()

    def _letters(self) -> dict[int, str]:
        """The byte-level alphabet: bytes that print stand for themselves, the others for code points from 256."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        return {b: chr(256 + n) for n, b in enumerate(rest)}

    def symbols(self, word: str, last: bool = True) -> list[int]:
        """The ids of a byte-level word's letters; the last carries the word-end suffix."""
        out = [self.ids[c] for c in word[: len(word) - last]]
        return [*out, self.ids[word[-1] + self.suffix]] if last and word else out

    def expand(self, tokens: list[int]) -> list[int]:
        out: list[int] = []
        for i in tokens:
            s = self.text[i]
            end = bool(self.suffix) and s.endswith(self.suffix) and s != self.suffix
            out += self.symbols(s[: len(s) - len(self.suffix)] if end else s, end)
        return out

    def merge(self, sym: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals."""
        n, sym = len(sym), list(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.rank.get((sym[i], sym[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if r := self.rank.get((new, sym[after[j]])):
                    heapq.heappush(heap, (r[0], i, r[1], new, sym[after[j]]))
            if (h := before[i]) >= 0 and (r := self.rank.get((sym[h], new))):
                heapq.heappush(heap, (r[0], h, r[1], sym[h], new))
        return [x for x in sym if x >= 0]

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        m = 4
        while a and b:
            left, right = a[-m:], b[:m]
            new = self.merge(self.expand(left) + self.expand(right))
            if (m >= len(a) or new[0] == left[0]) and (m >= len(b) or new[-1] == right[-1]):
                return a[:-m] + new + b[m:]
            m *= 2
        return a or b

    def tree(self, parts: list[list[int]]) -> list[int]:
        """The encoding of leaves that follow each other, joined two by two."""
        while len(parts) > 1:
            parts = [self.joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def words(self, chunk: str) -> Iterator[str | int]:
        """The byte-level words of a text, and ids of special tokens."""
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.special:
                yield self.lib.token_to_id(part)
            elif part:
                for word, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part)):
                    yield word

    def leaves(self, word: str) -> list[tuple[str, bool]]:
        return [(word[i : i + self.leaf], i + self.leaf >= len(word)) for i in range(0, len(word), self.leaf)]

    def long(self, chunk: str) -> list[int]:
        out: list[int] = []
        for w in self.words(chunk):
            out += [w] if isinstance(w, int) else self.tree([self.merge(self.symbols(*x)) for x in self.leaves(w)])
        return out

    def plain_word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def chunk(self, chunk: str) -> bytes:
        if len(chunk) > self.leaf:
            return np.array(self.long(chunk), "<u4").tobytes()
        if self.plain and PLAIN.fullmatch(chunk):
            known = self.plain_words.new
            return b"".join([known.get(w) or self.plain_words.one(w) for w in WORDS.findall(chunk.lower())])
        return np.array(self.lib.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(self.chunks(SPACE.split(text) if ODD_SPACE.search(text) else text.split()))

    def decode(self, ids: bytes) -> str:
        return " ".join(self.table[np.frombuffer(ids, "<u4")])

    def pieces(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """A long text as (word, piece, last): word -1 for text that is encoded by itself, else the leaves of one
        word carry the same number."""
        start, word = 0, 0
        for m in SPACE.finditer(text):
            if m.start() - start > SPLIT_BYTES // 8 and m.start() - start <= SPLIT_BYTES:
                yield -1, text[start : m.start()], True
                start = m.end()
            elif m.start() - start > SPLIT_BYTES:
                for x, piece, last in self.unsplit(text[start : m.start()]):
                    yield (x + word if x >= 0 else x), piece, last
                word, start = word + 1_000_000, m.end()
        for x, piece, last in self.unsplit(text[start:]):
            yield (x + word if x >= 0 else x), piece, last

    def unsplit(self, text: str) -> Iterator[tuple[int, str, bool]]:
        for n, chunk in enumerate(SPACE.split(text) if len(text) > SPLIT_BYTES else [text]):
            if len(chunk) <= SPLIT_BYTES:
                yield -1, chunk, True
                continue
            for k, w in enumerate(self.words(chunk)):
                if isinstance(w, int):
                    yield -1, self.text[w], True
                else:
                    for leaf, last in self.leaves(w):
                        yield n * 100_000 + k, leaf, last


_made: dict[str, Bpe] = {}


@contextmanager
def bpe(path: str) -> Iterator[Bpe]:
    """The vocabulary, which a worker keeps; what it remembers of texts goes with the task."""
    if path not in _made:
        _made[path] = Bpe(path)
    try:
        yield _made[path]
    finally:
        _made[path].forget()


def _replaced(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def encode(docs: DataFrame, path: str, text: str = "text", split_bytes: int = SPLIT_BYTES, decoded: str | None = None) -> DataFrame:
    """docs with n_tokens and ids (binary: little-endian unsigned 32-bit integers). With `decoded`, a column of that
    name holds what the ids decode to, made by the same worker, so that a task needs the vocabulary once."""
    small_batches(docs.sparkSession)
    docs = _replaced(docs, "ids", "n_tokens", *[x.lower() for x in (decoded,) if x])
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *[T.StructField(x, T.StringType()) for x in (decoded,) if x]]
    schema = T.StructType([*docs.schema.fields, *more])

    def columns(coder: Bpe, ids: list[bytes]) -> list[pa.Array]:
        own = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return [*own, pa.array([coder.decode(x) for x in ids], pa.string())] if decoded else own

    def whole(batches):
        with bpe(path) as coder:
            for b in batches:
                ids = [coder.encode(x or "") for x in b.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns(coder, ids)], names=schema.names)

    is_long = F.coalesce(F.octet_length(text) > split_bytes, F.lit(False))
    short = docs.where(~is_long).mapInArrow(whole, schema)

    row = "__row"
    # the few long texts are written once with their numbers, so that both uses see the same ones
    rows = written(docs.where(is_long).withColumn(row, F.monotonically_increasing_id()), "long")
    cut = T.StructType([T.StructField(row, T.LongType()), T.StructField("seq", T.LongType()), T.StructField("word", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("last", T.BooleanType())])
    done = T.StructType([*cut.fields[:3], T.StructField("ids", T.BinaryType())])

    def cut_up(batches):
        with bpe(path) as coder:
            for b in batches:
                for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    out = [(r, n, *p) for n, p in enumerate(coder.pieces(t))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_arrow(cut))

    def encode_pieces(batches):
        with bpe(path) as coder:
            for b in batches:
                p = b.to_pydict()
                ids = [coder.encode(s) if w < 0 else np.array(coder.merge(coder.symbols(s, e)), "<u4").tobytes() for w, s, e in zip(p["word"], p["piece"], p["last"], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())], names=done.names)

    def together(table: pa.Table) -> pa.Table:
        with bpe(path) as coder:
            out, run, at = [], [], -1
            table = table.sort_by("seq")

            def close():
                if run:
                    out.append(np.array(coder.tree(run[:]), "<u4").tobytes())
                    run.clear()

            for w, ids in zip(table.column("word").to_pylist(), table.column("ids").to_pylist(), strict=True):
                if w < 0 or w != at:
                    close()
                at = w
                if w < 0:
                    out.append(ids)
                else:
                    run.append(np.frombuffer(ids, "<u4").tolist())
            close()
            return pa.table([table.column(row).slice(0, 1), *columns(coder, [b"".join(out)])], names=[row, *[f.name for f in more]])

    cuts = rows.select(row, text).mapInArrow(cut_up, cut).repartition(F.col(row), F.col("seq")).mapInArrow(encode_pieces, done)
    whole_ids = cuts.groupBy(row).applyInArrow(together, T.StructType([cut.fields[0], *more]))
    return short.unionByName(rows.join(whole_ids, row).select(*schema.names))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of its ids, special tokens kept."""
    small_batches(encoded.sparkSession)
    encoded = _replaced(encoded, out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        with bpe(path) as coder:
            for b in batches:
                texts = [coder.decode(x or b"") for x in b.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
