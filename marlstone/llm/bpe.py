"""Word-level BPE with a lexicon automaton.

The corpus's most frequent words are encoded once and compiled into a minimal acyclic automaton: words share prefixes and
suffixes, and every edge carries the number of words that are passed over, so that a path's sum is the word's rank and the
rank points at its ids. The automaton is a file of flat arrays that each worker maps into memory. A task splits a block
of texts into pieces, looks each distinct piece up in the automaton, all pieces a byte at a time, and merges the pieces
that it does not have exactly, by rank and then from the left.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import persisted

END = "</w>"
LEXICON_WORDS = 65_536
CHUNK_CHARS = 500_000
#: Distinct words after which a task hands its counts on.
FLUSH_WORDS = 300_000
#: Steps of the histogram of counts for each doubling.
STEPS = 16
#: Longer pieces are merged one by one with a heap.
LONG_PIECE = 64
NO_RANK = np.iinfo(np.int32).max
#: The split that tokenizer files of this make have; ``\\s`` there is white space as Unicode has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


def _refuse_others(path: str, data: dict) -> None:
    """ValueError unless everything in the file that decides ids or decoding is as this module has it."""
    model, flags = data["model"], ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
    normalizers, splits = (data.get("normalizer") or {}).get("normalizers", []), (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
    own = {
        "model": model["type"] == "BPE" and model.get("end_of_word_suffix") == END and not any(model.get(f) for f in flags),
        "normalizer": [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"] and (normalizers[1]["pattern"], normalizers[1]["content"]) == ({"Regex": r"\s+"}, " "),
        "pre_tokenizer": [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": SPLIT} and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True) and (splits[1]["add_prefix_space"], splits[1]["use_regex"]) == (False, False),
        "decoder": data.get("decoder") is None,
        "added tokens": not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in data["added_tokens"]),
    }
    if wrong := [k for k, ok in own.items() if not ok]:
        raise ValueError(f"{path} has another {', '.join(wrong)} than a lower-casing BPE with word ends")


class WordBpe:
    """Vocabulary, merges and added tokens of a tokenizer file with word ends, as arrays. Files of another make are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        _refuse_others(path, data)
        model, added = data["model"], data["added_tokens"]
        vocab = model["vocab"]
        self.tokens = [b""] * (max([*vocab.values(), *(a["id"] for a in added)]) + 1)
        for token, i in [*vocab.items(), *((a["content"], a["id"]) for a in added)]:
            self.tokens[i] = token.encode()
        self.added = {a["content"]: a["id"] for a in added}
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + END] for c in chars], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.merge_order = np.argsort(keys, kind="stable")
        self.merge_keys = keys[self.merge_order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)

    def pieces(self, text: str | None) -> list[str]:
        """Pieces of a text in order; an added token's string stays whole."""
        if not text:
            return []
        if any(x in text for x in self.added):
            out = []
            for part in self.added_pattern.split(text):
                out += [part] if part in self.added else PIECES.findall(normalised(part))
            return out
        return PIECES.findall(normalised(text))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; NO_RANK where there is none or a symbol is negative."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where((self.merge_keys[at] == key) & (left >= 0) & (right >= 0), self.merge_order[at], NO_RANK).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: exact merges, all words of like length at once."""
        out: list[np.ndarray] = [None] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        for i in np.flatnonzero(sizes > LONG_PIECE).tolist():
            out[i] = self._merge_long(words[i])
        low = 0
        for high in (4, 8, 12, 16, 24, 32, LONG_PIECE):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for part in np.array_split(own, max(1, -(-len(own) // 20_000))):
                if len(part):
                    for i, ids in zip(part.tolist(), self._merge_block([words[i] for i in part.tolist()], sizes[part], high)):
                        out[i] = ids
        return out

    def _merge_block(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[np.ndarray]:
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        column = np.arange(width)
        symbols = np.where(column < sizes[:, None] - 1, self.inner[flat], np.where(column == sizes[:, None] - 1, self.last[flat], -1)).astype(np.int32)
        result, lengths = symbols.copy(), sizes.copy()
        rows = np.arange(len(words))
        rank = np.full(symbols.shape, NO_RANK, dtype=np.int32)
        rank[:, :-1] = self.ranks(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            live = best < NO_RANK
            if not live.all():
                done = ~live
                result[rows[done]] = symbols[done]
                rows, symbols, rank, at, best = rows[live], symbols[live], rank[live], at[live], best[live]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            symbols[n, at] = self.merged[best]
            source = np.minimum(column + (column > at[:, None]), width - 1)
            symbols, rank = np.take_along_axis(symbols, source, 1), np.take_along_axis(rank, source, 1)
            symbols[:, -1], rank[:, -1] = -1, NO_RANK
            lengths[rows] -= 1
            right = np.minimum(at + 1, width - 1)
            rank[n, at] = np.where(at + 1 < width, self.ranks(symbols[n, at], symbols[n, right]), NO_RANK)
            left = np.maximum(at - 1, 0)
            rank[n, left] = np.where(at > 0, self.ranks(symbols[n, left], symbols[n, at]), rank[n, left])
        return [result[i, :k] for i, k in enumerate(lengths.tolist())]

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        before, after, alive = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1], [True] * len(ids)
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.ranks(np.array([a]), np.array([b]))[0])
            return known[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(ids[i], ids[i + 1])) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (n := rank(ids[i], ids[after[i]])) < NO_RANK:
                    heapq.heappush(heap, (n, i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (n := rank(ids[before[i]], ids[i])) < NO_RANK:
                heapq.heappush(heap, (n, before[i], ids[before[i]], ids[i]))
        return np.array([x for x, ok in zip(ids, alive) if ok], dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        return b" ".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def normalised(text: str) -> str:
    """NFC, then lower case character by character (a final sigma is as any other)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def compile_lexicon(words: Iterable[bytes], ids_of: dict[bytes, np.ndarray]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of the sorted words, built from left to right; its edges as sorted arrays."""
    words = sorted(set(words))
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []
    last = b""

    def minimise(keep: int) -> None:
        while len(path) > keep:
            parent, label, child = path.pop()
            key = (final[child], tuple(edges[child].items()))
            edges[parent][label] = register.setdefault(key, child)

    for word in words:
        n = os.path.commonprefix([last, word]).__len__()
        minimise(n)
        state = path[-1][2] if path else 0
        for label in word[n:]:
            edges.append({})
            final.append(False)
            edges[state][label] = child = len(edges) - 1
            path.append((state, label, child))
            state = child
        final[state] = True
        last = word
    minimise(0)
    reach: dict[int, int] = {}
    order, stack = [], [0]
    while stack:
        s = stack.pop()
        if s not in reach:
            reach[s] = len(order)
            order.append(s)
            stack += edges[s].values()
    below: dict[int, int] = {}

    def count(state: int) -> int:
        todo = [state]
        while todo:
            s = todo[-1]
            if s in below:
                todo.pop()
            elif missing := [t for t in edges[s].values() if t not in below]:
                todo += missing
            else:
                below[todo.pop()] = final[s] + sum(below[t] for t in edges[s].values())
        return below[state]

    count(0)
    rows = []
    for s in order:
        passed = int(final[s])
        for label, t in sorted(edges[s].items()):
            rows.append((reach[s] << 8 | label, reach[t], passed))
            passed += below[t]
    rows.sort()
    outputs = [ids_of[w] for w in words]
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return {
        "keys": table[:, 0],
        "targets": table[:, 1],
        "passed": table[:, 2],
        "final": np.array([final[s] for s in order], dtype=np.int64),
        "first": np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int64),
        "ids": np.concatenate([np.asarray(o, dtype=np.int64) for o in outputs]) if outputs else np.zeros(0, dtype=np.int64),
    }


_PARTS = ("keys", "targets", "passed", "final", "first", "ids")


def write_lexicon(parts: dict[str, np.ndarray], path: str) -> None:
    sizes = np.array([len(parts[p]) for p in _PARTS], dtype=np.int64)
    np.concatenate([sizes, *(parts[p] for p in _PARTS)]).tofile(path)


class Lexicon:
    """The automaton, mapped into memory."""

    def __init__(self, path: str):
        flat = np.memmap(path, dtype=np.int64, mode="r")
        at = len(_PARTS)
        for name, size in zip(_PARTS, flat[: len(_PARTS)].tolist()):
            setattr(self, name, flat[at : at + size])
            at += size

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for those that the automaton does not have."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        state, total, out = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
        rows, depth = np.arange(len(words)), 0
        while len(rows) and len(self.keys):
            ended = sizes[rows] == depth
            done = rows[ended]
            out[done] = np.where(self.final[state[done]] > 0, total[done], -1)
            rows = rows[~ended]
            key = state[rows] << 8 | flat[starts[rows] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            rows, at = rows[found], at[found]
            state[rows] = self.targets[at]
            total[rows] += self.passed[at]
            depth += 1
        return out


def frequent_words(docs: DataFrame, n: int, text_col: str = "text") -> list[bytes]:
    """The most frequent words (runs of letters, lower-cased) of all documents, at most ``n``: all whose count reaches a cut-off.

    The cut-off comes from a histogram of the counts, so that no more than ``n`` words leave the executors, however many
    partitions there are. Words that occur once are never among them.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(text.encode().translate(_LETTERS).split())
                if len(counts) > FLUSH_WORDS:
                    yield handed()
                    counts.clear()
        if counts:
            yield handed()

    total = persisted(docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    # counts fall into steps of a few per cent; from the top, those steps are taken whole that stay within n words
    step = F.floor(F.log2("n") * STEPS).cast("int")
    left, least = n, None
    for r in total.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        if r["words"] > left:
            break
        left, least = left - r["words"], r["step"]
    return [] if least is None else [bytes(r["word"]) for r in total.where(step >= least).select("word").collect()]


class Encoder:
    """Encodes blocks of texts with the lexicon first and exact merges for the rest."""

    def __init__(self, model: WordBpe, lexicon: Lexicon | None = None):
        self.model, self.lexicon = model, lexicon

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.model.pieces(t) for t in texts]
        number: dict[str, int] = {}
        for pieces in split:
            for p in pieces:
                if p not in number:
                    number[p] = len(number)
        first, ids = self._table(list(number))
        many = np.diff(first)
        out = []
        for pieces in split:
            codes = np.fromiter(map(number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            sizes = many[codes]
            ends = np.cumsum(sizes)
            out.append(ids[np.repeat(first[codes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def _table(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """first and ids: those of piece i are ids[first[i]:first[i + 1]]."""
        words = [p.encode() for p in pieces]
        found: list[np.ndarray] = [None] * len(words)
        for i, p in enumerate(pieces):
            if p in self.model.added:
                found[i] = np.array([self.model.added[p]])
        if self.lexicon is not None and words:
            first, ids = self.lexicon.first, self.lexicon.ids
            ranks = self.lexicon.ranks(words)
            for i, (a, b) in zip(np.flatnonzero(ranks >= 0).tolist(), zip(first[ranks[ranks >= 0]].tolist(), first[ranks[ranks >= 0] + 1].tolist())):
                if found[i] is None:
                    found[i] = ids[a:b]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self.model.merge([words[i] for i in rest])):
            found[i] = x
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(found).astype(np.uint32) if found else np.zeros(0, dtype=np.uint32)


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each."""
    start, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text or "")
        if n >= limit:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Ids of every text and the text they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids``
    also ids (array<int>), with ``with_text`` also decoded.

    ``tokenizer`` is a tokenizer file; its contents travel with the job. A file whose normaliser, split, decoder or flags are others
    is refused. No special tokens are added; their strings in a
    text are read as the tokens. ``lexicon_words`` bounds the automaton, and with it what the driver holds.

    Null and empty texts have no ids and decode to an empty text. Texts of any length are encoded whole. Rows are
    independent, so repeated rows come out as often; an empty table gives an empty result. Letters that were assigned
    after the Unicode version of the ``regex`` module count as symbols.
    """
    spark = docs.sparkSession
    model = WordBpe(tokenizer)
    words = frequent_words(docs, lexicon_words, text_col)
    words = sorted({w for w in words if PIECES.fullmatch(w.decode("utf-8", "replace")) and normalised(w.decode("utf-8", "replace")).encode() == w})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(SparkFiles.getRootDirectory(), name)  # Spark's own folder for files that it sends out; it goes with the session
    write_lexicon(compile_lexicon(words, dict(zip(words, model.merge(words)))), path)
    spark.sparkContext.addFile(path)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        encoder = Encoder(own, Lexicon(SparkFiles.get(name)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids = encoder.encode(texts[a:b])
                decoded = [b" ".join(map(own.tokens.__getitem__, x.tolist())) for x in ids]
                columns = [batch.column(0).slice(a, b - a)]
                columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                columns += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] * with_ids + [pa.array([x.decode("utf-8", "replace") for x in decoded])] * with_text
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text])

    return rows.mapInArrow(run, ddl)
