"""BPE encoding by backtracking over longest token matches, and decoding.

A word's BPE encoding is the only sequence of tokens that spells it in which
every two neighbours are compatible: merging the spelling of the pair alone
gives the same two tokens. So no merge is ever replayed. An Aho-Corasick
automaton finds the longest token at every place of the word; the encoder
takes it if it is compatible with the token before, else the next shorter
token that is a prefix of it, and steps back a token where none is left. Places
found to lead nowhere are marked, so each is left at most once and the work is
linear in the word. Compatibility is decided by undoing merges at the border of
the two tokens, latest first, and kept in a table.

Texts are cut at ASCII white space, each different chunk of a batch is
normalised and cut into words as the tokenizer's file says, each different
word is encoded once, and ids are gathered from words to chunks to documents by
numpy. Decoding
gathers the token strings by a table of their offsets. Both are narrow: no
shuffle, nothing on the driver, any lost task is simply run again.

Tokenizers: BPE files with byte-level words whose cutting drops white space and
never joins across it, without a decoder (tokens are then joined by a space).

Defined results: a null or empty text, or one of white space, has no ids and
decodes to the empty text; the strings of special tokens in a text are those
tokens; repeated rows, ties and null ids of documents are ordinary rows; very
long texts and words are whole (linear time; a batch holds one of them at
most); an empty table gives an empty result; other columns never enter.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from logloom.llm.common import with_row_key

# marks the last symbol of a word: the vocabulary has own tokens for it
_LAST = 0x400
# words whose ids a worker remembers, in two generations; longer ones are not kept
CACHE_WORDS = 150_000
CACHE_CHARS = 64
# pairs of tokens whose compatibility is kept
TABLE_PAIRS = 200_000
# visible ASCII and the letters of Latin-1: composed, and classed alike everywhere
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
# bytes of text encoded at once (a longer text is a batch of its own)
BATCH_BYTES = 4 << 20


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level words:
    itself where it is one, else the next one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The tokens of a merge list, numbered single symbols first and then in
    merge order, and the tables the backtracking needs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        spelled = {t: self.spell(t, suffix) for t in vocab}
        singles = sorted((t for t in vocab if len(spelled[t]) == 1), key=vocab.__getitem__)
        self.number = {t: i for i, t in enumerate(singles)}
        self.left = list(range(len(singles)))
        self.right = list(range(len(singles)))
        self.merged: dict[tuple[int, int], int] = {}
        strings = [spelled[t] for t in singles]
        ids = [vocab[t] for t in singles]
        for a, b in merges:
            whole = a + b
            made = len(strings)
            self.merged[self.number[a], self.number[b]] = made
            self.number.setdefault(whole, made)
            self.left.append(self.number[a])
            self.right.append(self.number[b])
            strings.append(spelled[whole])
            ids.append(vocab[whole])
        self.ids, self.strings, self.size = ids, strings, [len(s) for s in strings]
        self.table: dict[int, bool] = {}
        # a token that merging its own spelling does not give never occurs
        proper = [True] * len(singles)
        for t in range(len(singles), len(strings)):
            a, b = self.left[t], self.right[t]
            proper.append(proper[a] and proper[b] and self._apart(a, b, t))
        self.token = {s: t for t, s in enumerate(strings) if proper[t]}
        self.automaton = ahocorasick.Automaton()
        for s, t in self.token.items():
            self.automaton.add_word(s, (t, len(s) - 1))
        self.automaton.make_automaton()
        self.shorter = [self._shorter(s) for s in strings]

    @staticmethod
    def spell(token: str, suffix: str) -> str:
        """A token as symbols, one character each."""
        if suffix and token.endswith(suffix) and len(token) > len(suffix):
            token = token[:-len(suffix)]
            return token[:-1] + chr(ord(token[-1]) + _LAST)
        return token

    def _shorter(self, s: str) -> int:
        """The longest token that is a proper prefix; -1 if there is none."""
        return next((self.token[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.token), -1)

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Does no merge made before number ``before`` cross the border of the
        neighbours a and b? Merges at the border are undone, latest first (of
        two uses of one merge the left is made first)."""
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < before:
                return False
            undo_left = a > b if self.right[a] != a and self.left[b] != b else self.right[a] != a
            if undo_left:
                before, a = min(before, a), self.right[a]
            elif self.left[b] != b:
                before, b = min(before, b + 1), self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        pair = a * len(self.strings) + b
        found = self.table.get(pair)
        if found is None:
            if len(self.table) >= TABLE_PAIRS:
                self.table.clear()
            found = self.table[pair] = self._apart(a, b, len(self.strings))
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of a word given as symbols."""
        whole = self.token.get(word)
        if whole is not None:
            return [self.ids[whole]]
        n, size, shorter = len(word), self.size, self.shorter
        longest = [-1] * (n + 1)
        for end, (t, back) in self.automaton.iter(word):  # ends ascend: the longest comes last
            longest[end - back] = t
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0:
                if not dead[at + size[token]] and (before < 0 or self.compatible(before, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at]
            elif before >= 0:
                dead[at] = 1
                token = shorter[out.pop()]
                at -= size[before]
            else:
                raise ValueError("the vocabulary does not spell this word")
        return [self.ids[t] for t in out]


class TextEncoder:
    """Ids of texts as a tokenizer file defines them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or len(split) != 2 or split[0]["type"] != "Split" or split[1]["type"] != "ByteLevel" \
                or split[1]["add_prefix_space"] or split[1]["use_regex"]:
            raise ValueError("needs a BPE file whose words are cut by one pattern and written byte by byte")
        if spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("needs a tokenizer without decoder and post-processor")
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.cut_words = library.pre_tokenizer.pre_tokenize_str
        # used here on plain text only, where all engines' classes agree
        self.pattern = split[0]["pattern"]["Regex"]
        kinds = spec.get("normalizer") or {}
        kinds = {n["type"] for n in kinds.get("normalizers", [kinds] if kinds else [])}
        # what these do to plain text is to lower its case
        self.symbols = str.maketrans(byte_symbols())
        self.fast = "Lowercase" in kinds and kinds <= {"NFC", "NFD", "NFKC", "NFKD", "Replace", "Lowercase"}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
                                             + ")") if self.special else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], pairs, self.suffix)
        self.words: list[dict[str, bytes]] = [{}, {}]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, little-endian unsigned 32-bit."""
        new, old = self.words
        found = list(map(new.get, words))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            ids = old.get(word)
            if ids is None:
                spelled = (word if word.isascii() else word.encode().decode("latin-1")).translate(self.symbols)
                ids = array("I", self.merges.encode(spelled[:-1] + chr(ord(spelled[-1]) + _LAST) if self.suffix else spelled)).tobytes()
            found[i] = ids
            if len(word) <= CACHE_CHARS:
                new[word] = ids
        if len(new) > CACHE_WORDS:
            self.words = [{}, new]
        return found

    def _pieces(self, chunk: str) -> list[str]:
        """Words of a text without ASCII white space; a special token is NUL
        and its id (no word is NUL and digits, which are words of their own)."""
        out: list[str] = []
        for piece in self.special_pattern.split(chunk) if self.special_pattern is not None else [chunk]:
            if piece in self.special:
                out.append(f"\x00{self.special[piece]}")
            elif piece:
                text = self.normalise(piece)
                out += [text[a:b] for _, (a, b) in self.cut_words(text)]
        return out

    def _chunk_words(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words, edges) of every chunk. Plain chunks are lower-cased and cut
        by the file's pattern, all at once; others by the library."""
        plain = pc.match_substring_regex(chunks, _PLAIN if self.fast else "^$")
        for text in self.special:
            plain = pc.and_not(plain, pc.match_substring(chunks, text))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        spaced = pc.replace_substring_regex(pc.utf8_lower(chunks), self.pattern, r"\0 ")
        if len(odd):
            cut = [" ".join(self._pieces(c)) for c in chunks.take(pa.array(odd)).to_pylist()]
            spaced = pc.replace_with_mask(spaced, pc.invert(plain), pa.array(cut, pa.string()))
        split = pc.ascii_split_whitespace(spaced)
        return split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts in order, and where each
        text's begin (one more offset at the end)."""
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        words, edges = self._chunk_words(chunks.dictionary)
        words = words.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        odd = [i for i, w in enumerate(distinct) if not w or w[0] == "\x00" and w[1:].isdigit()]
        special = {i: distinct[i] for i in odd}
        for i in odd:  # no word: any that is known
            distinct[i] = "!"
        parts = self.word_ids(distinct)
        for i, w in special.items():
            parts[i] = array("I", [int(w[1:])]).tobytes() if w else b""
        ids, ends = ragged_take(np.frombuffer(b"".join(parts), "<u4"), _ends(np.fromiter(map(len, parts), np.int64, len(parts)) // 4),
                                words.indices.to_numpy(zero_copy_only=False))
        # ids of the chunks, then of the texts
        ids, ends = ragged_take(ids, ends[edges], chunks.indices.to_numpy(zero_copy_only=False))
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def ragged_take(values: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of the ragged ``values`` (list i between edges i and
    i + 1), one after the other, and their edges."""
    counts = (edges[1:] - edges[:-1])[which]
    ends = _ends(counts)
    return values[np.arange(ends[-1]) + np.repeat(edges[:-1][which] - ends[:-1], counts)], ends


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


@lru_cache(maxsize=2)
def token_strings(path: str) -> pa.Array:
    """The string of every id with a space behind it: bytes and their offsets."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder") is not None:
        raise ValueError("needs a tokenizer without a decoder")
    vocab = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        strings[i] = token.encode() + b" "
    return pa.array(strings, pa.large_binary())


def bounded_slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes in ``column`` (a longer
    value comes alone)."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def ids_column(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Ragged ids as a binary column, little-endian unsigned 32-bit."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, rid, n_tokens, ids) of every document; ``ids`` are
    little-endian unsigned 32-bit. ``tokenizer`` is a file every executor has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in batches:
            for part in bounded_slices(batch, "text"):
                ids, offsets = encoder.encode(part["text"])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["rid"], pa.array(np.diff(offsets), pa.int64()), ids_column(ids, offsets)],
                    ["doc_id", "rid", "n_tokens", "ids"])

    rows = with_row_key(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text ``out`` of each row's ``ids`` (as :func:`encode` gives
    them; null: no ids). Ids outside the vocabulary have no string."""
    schema = StructType([*encoded.schema.fields, StructField(out, StringType())])

    def texts(column: pa.Array, strings: pa.Array) -> pa.Array:
        column = pc.fill_null(column, b"")
        edges = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4)))
        flat = np.frombuffer(b"".join(column.to_pylist()), "<u4")
        known = flat < len(strings)
        if not known.all():
            edges = np.concatenate(([0], np.cumsum(known)))[edges]
            flat = flat[known]
        spelled = strings.take(pa.array(flat))
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset:spelled.offset + len(spelled) + 1]
        joined = pa.Array.from_buffers(pa.large_string(), len(column), [
            None, pa.py_buffer(np.ascontiguousarray(ends[edges])), spelled.buffers()[2] or pa.py_buffer(b"")])
        return pc.utf8_rtrim(joined, characters=" ").cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = token_strings(tokenizer)
        for batch in batches:
            for part in bounded_slices(batch, ids):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, texts(part[ids], strings)], [*part.schema.names, out])

    return encoded.mapInArrow(run, schema)
