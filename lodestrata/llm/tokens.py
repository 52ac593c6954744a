"""Token ids and counts of whole texts, piece by piece.

A text is cut where its tokenizer cuts in any case, so the pieces' tokens are the text's tokens. Pieces repeat much more
often than texts: each task encodes a piece once, with others in one batch, and keeps it in a table of bounded size.

Ids: texts are cut at ASCII white space, which the tokenizer drops, and turned into numbers of distinct words by Arrow; only
words that are new in a batch of texts are looked at one by one, and ids are gathered by numpy for all words of the batch.
Counts: texts are cut before white space that follows other characters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE, PARTS = 600_000, 500_000  # pieces that a Python worker remembers when it counts, some 150 MB at most
CORES = 250_000  # words without the punctuation at their ends in each of two generations, when it needs the ids; some 100 MB
PIECE = 200  # longer pieces aren't remembered
BATCH_BYTES = 1 << 20  # text that is looked at together; a longer text is alone
ID_BATCH_BYTES = 4 << 20
_BEFORE_SPACE = re.compile(r"\S+|\s+\S*")
# İ is left out: it becomes an i and a mark that belongs to what follows
_ENDS = re.compile(r"(.*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)", re.S)
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII, without the apostrophe
_LETTER_LAST = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]$"
_models: dict[str, object] = {}
_counted: dict[str, tuple[dict, dict]] = {}
_ids: dict[str, "Ids"] = {}


def load(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, once for each Python worker."""
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece

            _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import os

            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _models[path] = model
    return _models[path]


def encode(model, texts: list[str]) -> list[list[int]]:
    if hasattr(model, "encode_batch"):
        return [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return model.encode(texts, num_threads=1)


def word_ends(model) -> np.ndarray | None:
    """By id, whether a token ends a word; None where the vocabulary doesn't tell for every byte."""
    suffix = getattr(getattr(model, "model", None), "end_of_word_suffix", None)
    vocab = model.get_vocab() if suffix else {}
    if sum(len(t) == len(suffix) + 1 and t.endswith(suffix) for t in vocab) < 256:
        return None
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    return ends


def _one_word(piece: str) -> bool:
    """Letters only, which normalization leaves as they are but for A-Z: one word to every word-level vocabulary."""
    return piece.isalpha() and (piece.isascii() or piece == piece.lower() and is_normalized("NFC", piece))


class Pieces:
    """Cuts texts into pieces and counts the tokens of each, for vocabularies whose tokens hold the white space before them.

    sentencepiece normalizes across white space, so its texts are not cut. A piece that is not known is cut once more,
    between a letter and the punctuation that ends it, and the parts are looked up among the parts that are known."""

    def __init__(self, path: str):
        self.model, self.whole = load(path), path.endswith(".model")
        self.known, self.parts = _counted.setdefault(path, ({}, {}))

    def cut(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        parts = text.split(" ")
        if "" in parts or any(p[-1].isspace() for p in parts):  # runs of white space
            return _BEFORE_SPACE.findall(text)
        return [parts[0], *map(" ".__add__, parts[1:])]

    def _part(self, piece: str) -> tuple[str, str]:
        found = None if self.whole or piece[-1:].isalpha() or "<|" in piece else _ENDS.fullmatch(piece)
        return found.groups() if found else (piece, "")

    def _learn(self, new: set[str]) -> None:
        cut = {p: self._part(p) for p in new}
        missing = list(set(chain.from_iterable(cut.values())).difference(self.parts, ("",)))
        if len(self.parts) + len(missing) > PARTS:
            self.parts.clear()
            missing = list(set(chain.from_iterable(cut.values())) - {""})
        parts = self.parts
        parts[""] = 0
        for k in range(0, len(missing), 5_000):
            parts.update(zip(missing[k : k + 5_000], map(len, encode(self.model, missing[k : k + 5_000]))))
        self.known.update((p, parts[a] + parts[b] if b else parts[a]) for p, (a, b) in cut.items())
        for p in [x for x in missing if len(x) > PIECE]:
            del parts[p]

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        used = set(chain.from_iterable(cut))
        new = used.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = used
        self._learn(new)
        out = [sum(map(self.known.__getitem__, ps)) for ps in cut]
        for p in new:
            if len(p) > PIECE:
                del self.known[p]
        return out


class Ids:
    """The ids of texts for a vocabulary that lower-cases and drops white space.

    Of each batch of texts, Arrow numbers the distinct words, and of these the distinct cores (words without the ASCII
    punctuation after their last letter). Ids of cores are remembered in two generations of bounded size: when the younger
    one is full it becomes the older one, so what was not used for a while is forgotten."""

    def __init__(self, path: str):
        self.model = load(path)
        self.ends = word_ends(self.model)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, cores: list[str]) -> Iterator[tuple[str, bytes]]:
        """Plain words are encoded many at a time, as one text, whose ids are cut where words end."""
        plain = [w for w in cores if _one_word(w)] if self.ends is not None else []
        left = list(set(cores).difference(plain))
        groups = [plain[k : k + 200] for k in range(0, len(plain), 200)]
        for k in range(0, len(groups), 25):
            for group, ids in zip(groups[k : k + 25], encode(self.model, list(map(" ".join, groups[k : k + 25])))):
                ids = np.array(ids, np.uint32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(group) or cuts[-1] != len(ids):
                    left += group
                    continue
                raw, cuts = ids.tobytes(), (cuts * ids.itemsize).tolist()
                yield from ((w, raw[a:b]) for w, a, b in zip(group, [0, *cuts], cuts))
        for k in range(0, len(left), 5_000):
            yield from zip(left[k : k + 5_000], (np.array(x, np.uint32).tobytes() for x in encode(self.model, left[k : k + 5_000])))

    def _look_up(self, cores: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, cores))
        missing = [k for k, x in enumerate(found) if x is None]
        if not missing:
            return found
        if len(young) + len(missing) > CORES:
            self.old, self.young = young, {}
            young = self.young
        more = {cores[k]: old[cores[k]] for k in missing if cores[k] in old}
        more.update(self._encode([cores[k] for k in missing if cores[k] not in more]))
        for k in missing:
            found[k] = more[cores[k]]
        young.update((w, x) for w, x in more.items() if len(w) <= PIECE)
        return found

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin and end. Null texts are empty."""
        texts = pc.fill_null(texts, "")
        # special tokens are told from other text before it is put in lower case
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        first, words = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        first, own = first - first[0], words.dictionary
        core = pc.utf8_rtrim(own, _PUNCTUATION)
        n = pc.binary_length(own).to_numpy().astype(np.int64)
        more = n - pc.binary_length(core).to_numpy()
        cut = (more > 0) & (more <= 8) & pc.match_substring_regex(core, _LETTER_LAST).to_numpy(zero_copy_only=False) & ~pc.match_substring(own, "<|").to_numpy(zero_copy_only=False)
        core = pc.if_else(pa.array(cut), core, own).dictionary_encode()
        # the punctuation, as the bytes of a number
        data, begin = np.frombuffer(own.buffers()[2] or b"", np.uint8), np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
        at = np.flatnonzero(cut)
        code = np.zeros(len(at), np.uint64)
        for k in range(8):
            has = more[at] > k
            code[has] |= data[begin[at[has] + 1] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        codes, which = np.unique(code, return_inverse=True)
        marks = [int(x).to_bytes(8, "big").lstrip(b"\0").decode() for x in codes]
        raw = self._look_up([*core.dictionary.to_pylist(), *marks])
        # ids of each core and mark, then of each distinct word (a core and a mark or nothing), then of all words
        flat, size = np.frombuffer(b"".join(raw), np.uint32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        size, begin = np.append(size, 0), np.concatenate([[0], np.cumsum(size)])
        parts = np.full((len(own), 2), len(raw), np.int64)
        parts[:, 0] = core.indices.to_numpy()
        parts[at, 1] = len(core.dictionary) + which
        flat, size = _gather(flat, begin, size, parts.reshape(-1))
        size = size.reshape(-1, 2).sum(axis=1)
        ids, size = _gather(flat, np.cumsum(size) - size, size, words.indices.to_numpy())
        return ids, np.concatenate([[0], np.cumsum(size)])[first]


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start[k] : start[k] + size[k]] for each k of at, and their sizes."""
    n = size[at]
    ends = np.cumsum(n)
    return flat[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


def byte_ranges(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Positions of consecutive texts in batches of about equal bytes; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = held = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, held + most, "right")))
        yield start, end
        start, held = end, int(ends[end - 1])


def by_bytes(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts in batches of about equal bytes: the first one's position and the texts, null as empty. Only one
    batch at a time is turned into Python strings."""
    for start, end in byte_ranges(texts, most or BATCH_BYTES):
        yield start, [t or "" for t in texts.slice(start, end - start).to_pylist()]


def ids_of(batches: Iterator[pa.RecordBatch], column: str, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, with the ids of all their texts, end_id after each, and where each text's begin and end."""
    own = _ids.get(path) or _ids.setdefault(path, Ids(path))
    for b in batches:
        for start, end in byte_ranges(b.column(column), ID_BATCH_BYTES):
            part = b.slice(start, end - start)
            ids, at = own.of(part.column(column))
            yield part, np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
