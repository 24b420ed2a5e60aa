"""BPE encoding and decoding in batched numpy merge rounds.

The text is split at white space into chunks, which no token crosses. A task keeps a bounded memory of the
chunks it has met; those it has not are encoded together: their symbols lie in one flat array, each round
looks all neighbouring pairs up by binary search over the sorted pair keys, and in every word the pair of
lowest rank is merged wherever it stands. Rounds end when no word holds a known pair.

The vocabulary is a tokenizers file (JSON) whose words end in ``</w>``; its path is a parameter and its file is
read once by each worker process.

Defined cases: a null text counts as empty and gives no tokens; special tokens that stand in a text get their
own ids, as the tokenizers library gives them; columns other than the text pass through unchanged.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import output_schema

#: Fixed values of the vocabulary's own pre-tokenizer: its pattern, and the printable bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SUFFIX = "</w>"

#: Below this character, chunks are normalised and split together.
BEYOND = "\u0250"
#: Chunks remembered by one worker, and characters encoded at a time.
MEMORY = 300_000
SLICE = 500_000

#: What encode_decode can return, with its type.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}

_NO_RANK = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    out, spare = [], 256
    own = set(PRINTABLE)
    for b in range(256):
        out.append(chr(b) if b in own else chr(spare))
        spare += b not in own
    return out


class Vocabulary:
    """Tokens by id, and the merges as sorted pair keys with rank and resulting id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(max([*ids.values(), *self.special.values()]) + 1, object)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.decimal = np.array([str(i) for i in range(len(self.tokens))], object)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, new = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in merges)))
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.rank, self.new = keys[order], order.astype(np.int64), new[order]
        symbols = byte_symbols()
        self.first = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + SUFFIX] for s in symbols], np.int64)
        letters, digits = ("".join(re.escape(c) for c in map(chr, range(ord(BEYOND))) if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.common = re.compile(" |" + PATTERN.replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", " \t\n\v\f\r\x85\xa0")).findall
        self.path, self.library = path, None
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def words_of(self, chunk: str) -> list[str]:
        """The chunk's normalised words. Beyond Latin letters, whose tables are settled, the library's own tables of letters are asked."""
        if is_common(chunk):
            return self.common(normal(chunk))
        if self.library is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(self.path)
            self.library = whole.normalizer, whole.pre_tokenizer[0]
        normalizer, splitter = self.library
        return [w for w, _ in splitter.pre_tokenize_str(normalizer.normalize_str(chunk))]


def normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def is_common(text: str) -> bool:
    """Whether the text lies below BEYOND as it stands and as normalised: some letters below have a lower case beyond."""
    return max(text) < BEYOND and max(normal(text)) < BEYOND


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and each word's number of ids. Lengths must be positive."""
    n = len(lengths)
    word = np.repeat(np.arange(n), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    at = np.zeros(symbols.size, np.int64)  # of each symbol and its successor: the place of the pair's key, and its rank
    rank = np.full(symbols.size, _NO_RANK)
    stale = np.arange(symbols.size)
    while symbols.size:
        # only pairs beside a symbol merged in the last round have changed
        left = stale[stale + 1 < symbols.size]
        rank[stale] = _NO_RANK
        left = left[word[left] == word[left + 1]]
        key = symbols[left] << 20 | symbols[left + 1]
        pos = np.searchsorted(v.keys, key)
        pos[pos == len(v.keys)] = 0
        found = v.keys[pos] == key
        left, pos = left[found], pos[found]
        at[left], rank[left] = pos, v.rank[pos]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, symbols.size])
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        keep = least < _NO_RANK
        if not keep.all():
            done.append((word[~keep], symbols[~keep]))
        place = np.flatnonzero(keep & (rank == least))
        if not place.size:
            break
        # a pair of two equal symbols can overlap itself: take every other place of a run
        begins = np.r_[True, np.diff(place) > 1]
        place = place[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        symbols[place] = v.new[at[place]]
        keep[place + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, word, at, rank = symbols[keep], word[keep], at[keep], rank[keep]
        place = moved[place]
        fresh = np.zeros(symbols.size, bool)
        fresh[place] = True
        fresh[np.maximum(place - 1, 0)] = True
        stale = np.flatnonzero(fresh)
    words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
    ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    return ids[order], np.bincount(words, minlength=n)


class Encoder:
    """Encodes texts with a bounded memory of chunks."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.count = np.zeros(MEMORY, np.int64), np.zeros(MEMORY, np.int64)

    def learn(self, chunks: list[str]) -> None:
        rare = [] if is_common(" ".join(chunks)) else [c for c in chunks if not is_common(c)]
        if rare:
            own = set(rare)
            chunks = [*(c for c in chunks if c not in own), *rare]
        # common ones all at once: a space after each chunk marks where it ends
        plain = chunks[: len(chunks) - len(rare)]
        found = self.v.common(normal(" ".join(plain)))
        for k, c in enumerate(rare):
            found += [" ", *self.v.words_of(c)] if plain or k else self.v.words_of(c)
        data = np.frombuffer("\n".join(found).encode(), np.uint8)
        ends = np.r_[np.flatnonzero(data == 10), data.size]
        starts = np.r_[0, ends[:-1] + 1]
        mark = data[starts] == 32
        owners = np.cumsum(mark)[~mark]
        data = data[(data != 10) & (data != 32)]
        lengths = (ends - starts)[~mark]
        symbols = self.v.first[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.v.last[data[ends]]
        ids, per_word = merge_rounds(symbols, lengths, self.v)
        per_chunk = np.bincount(owners, weights=per_word, minlength=len(chunks)).astype(np.int64)
        have = len(self.index)
        need = have + len(chunks)
        if need > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * need), np.resize(self.count, 2 * need)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[have:need] = self.used + np.cumsum(per_chunk) - per_chunk
        self.count[have:need] = per_chunk
        self.index.update(zip(chunks, range(have, need)))
        self.used += len(ids)

    def lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids in one array, and the number of ids of each chunk."""
        n = len(chunks)
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, n)
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys([chunks[i] for i in missing]))
            if len(self.index) + len(new) > MEMORY and self.index:
                self.forget()
                return self.lookup(chunks)
            self.learn(new)
            at[missing] = np.fromiter(map(self.index.__getitem__, [chunks[i] for i in missing]), np.int64, len(missing))
        count = self.count[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if n else 0
        return self.ids[np.repeat(self.start[at] - ends + count, count) + np.arange(total)], count

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of chunks of about SLICE characters at most (or one longer chunk), and ids of special tokens."""
        special = any(t in text for t in self.v.special)
        for part in self.v.split_special(text) if special else [text]:
            if part in self.v.special:
                yield self.v.special[part]
                continue
            a = 0
            while a < len(part):
                b = a + SLICE
                if b < len(part):
                    b = next((m.end() for m in re.compile(r"[ \t\n\r]").finditer(part, b)), len(part))
                yield chunks_of(part[a:b])
                a = b

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """The text's ids, in order, in arrays of bounded size."""
        for piece in self.pieces(text or ""):
            yield np.array([piece], np.int32) if isinstance(piece, int) else self.lookup(piece)[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts are short enough to be held together."""
        lists = [list(self.pieces(t)) for t in texts]
        ids, count = self.lookup([c for x in lists for p in x if not isinstance(p, int) for c in p])
        ends = np.r_[0, np.cumsum(count)]
        out, at = [], 0
        for x in lists:
            parts = []
            for p in x:
                if isinstance(p, int):
                    parts.append(np.array([p], np.int32))
                else:
                    parts.append(ids[ends[at] : ends[at + len(p)]])
                    at += len(p)
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else ids[:0])
        return out


def chunks_of(text: str) -> list[str]:
    """str.split also splits at U+001C to U+001F, which aren't white space to the vocabulary's pattern."""
    if re.search("[\x1c-\x1f]", text):
        import regex

        return [c for c in regex.split(r"\s+", text) if c]
    return text.split()


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """This vocabulary has no decoder of its own: its tokens are joined by a space."""
    return " ".join(v.tokens[ids].tolist())


def encode_decode(df: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """df without its text, with ids and the text decoded from them again (or their digests); one row for each row.

    A very long text passes through in slices, so besides its own ids (if asked for) it takes no more memory than others.
    """
    outputs = tuple(outputs)
    clash = set(outputs) & {c.lower() for c in df.columns if c != text}
    df = df.drop(*clash)
    schema = output_schema(df, (text,), ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs))
    kept = [c for c in df.columns if c != text]
    types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        v = encoder.v
        for whole in batches:
            for batch in sliced(whole, text):
                rows: dict[str, list] = {o: [] for o in outputs}
                column = batch.column(text).to_pylist()
                short = sum(map(len, filter(None, column))) <= 2 * SLICE
                arrays = encoder.encode_many([t or "" for t in column]) if short else None
                for i in range(batch.num_rows):
                    for o, x in row([arrays[i]] if arrays else encoder.encode(column[i]), v).items():
                        rows[o].append(x)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(rows[o], types.get(o, pa.string())) for o in outputs)], names=[*kept, *outputs])

    def row(parts, v: Vocabulary) -> dict:
        n, ids, texts = 0, [], []
        id_hash, text_hash = hashlib.sha256(), hashlib.sha256()
        for part in parts:
            if not len(part):
                continue
            gap = b" " if n else b""
            n += len(part)
            if "ids" in outputs:
                ids.append(part)
            if "ids_sha256" in outputs:
                id_hash.update(gap + " ".join(v.decimal[part].tolist()).encode())
            if "decoded" in outputs or "decoded_sha256" in outputs:
                piece = decode(part, v)
                text_hash.update(gap + piece.encode())
                if "decoded" in outputs:
                    texts.append(piece)
        all_ = {"ids": np.concatenate(ids) if ids else np.zeros(0, np.int32), "decoded": " ".join(texts), "n_tokens": n, "ids_sha256": id_hash.hexdigest(), "decoded_sha256": text_hash.hexdigest()}
        return {o: all_[o] for o in outputs}

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE characters."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    a, total = 0, 0
    for b, size in enumerate(sizes):
        if b > a and total + size > SLICE:
            yield batch.slice(a, b - a)
            a, total = b, 0
        total += size
    if a < batch.num_rows:
        yield batch.slice(a)
