"""BPE encoding and decoding with forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token can never end up inside one token, so the text may be
cut between them before any merge is tried: no merge crosses the cut, and the fragments' encodings, put one after the
other, are the encoding of the word. Fragments recur far more often than words, so each is merged once per task.
"""

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import shipped

#: Bytes of words and fragments that a task remembers, each with ``ENTRY_BYTES`` besides its text and ids; when full the
#: memory starts anew, which changes time only.
CACHE_BYTES, ENTRY_BYTES = 24_000_000, 200
#: Documents and characters whose results a task holds at a time; a longer text is held alone.
SLICE, SLICE_CHARS = 128, 2_000_000

# The word pattern of the tokenizer file's pre-tokenizer, its white space taken from Unicode.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_TEXT = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
# The same pattern spelled out for characters up to U+00FF.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
LATIN_BLANKS = "\u0009-\u000d \u0085 "
LATIN_TEXT = re.compile(
    f"{CONTRACTIONS}|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{LATIN_BLANKS}{LATIN_LETTERS}{LATIN_NUMBERS}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next letter from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Tables:
    """What a tokenizer file says, in the form the encoder needs; built on the driver, bounded by the file's size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("a BPE file without subword prefix and decoder is needed")
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        #: (left id << 20 | right id) -> rank << 20 | merged id
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.joined: set[tuple[int, int]] = set()
        for token in vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            if token not in self.special and all(c in byte_of for c in body):
                values = [byte_of[c] for c in body]
                self.joined.update(zip(values, values[1:]))


class Encoder(dict):
    """Word -> its token ids as 32-bit integers, filled on demand."""

    def __init__(self, tables: Tables, boundaries: bool = True):
        super().__init__()
        self.t, self.boundaries, self.fragments, self.held = tables, boundaries, {}, 0
        names = sorted(map(re.escape, tables.special), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(names) + ")") if names else None

    def __missing__(self, word: str) -> bytes:
        body = word.encode("utf-8", "surrogatepass")
        ids: list[int] = []
        parts = self.cut(body)
        for fragment, last in parts:
            ids += self.merged(fragment, last) if len(parts) == 1 else self.remembered(fragment, last)
        out = array("i", ids).tobytes()
        self.remember(self, word, out, len(body) + len(out))
        return out

    def remember(self, place: dict, key, value, size: int) -> None:
        self.held += size + ENTRY_BYTES
        if self.held > CACHE_BYTES:
            self.clear()
            self.fragments.clear()
            self.held = size + ENTRY_BYTES
        if self.held <= CACHE_BYTES:
            dict.__setitem__(place, key, value)

    def cut(self, body: bytes) -> list[tuple[bytes, bool]]:
        """The word's fragments; the second value marks the one that ends the word."""
        start, out, joined = 0, [], self.t.joined
        if self.boundaries and not joined.issuperset(zip(body, body[1:])):
            for i, pair in enumerate(zip(body, body[1:]), 1):
                if pair not in joined:
                    out.append((body[start:i], False))
                    start = i
        out.append((body[start:], True))
        return out

    def remembered(self, fragment: bytes, last: bool) -> array:
        known = self.fragments.get((fragment, last))
        if known is None:
            known = array("i", self.merged(fragment, last))
            self.remember(self.fragments, (fragment, last), known, len(fragment) + 4 * len(known))
        return known

    def merged(self, fragment: bytes, last: bool) -> list[int]:
        if not fragment:
            return []
        t = self.t
        ids = [t.inner[b] for b in fragment]
        if last:
            ids[-1] = t.final[fragment[-1]]
        return merge_long(ids, t.merges) if len(ids) > 200 else merge_short(ids, t.merges)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "i4")
        pieces = self.special.split(text) if self.special else [text]
        out = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(np.array([self.t.special[piece]], "i4").tobytes())
            elif piece:
                out += map(self.__getitem__, words(piece))
        return np.frombuffer(b"".join(out), "i4")


def words(text: str) -> list[str]:
    """Normalised (NFC, lower case letter by letter) words of a text without special tokens."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ANY_TEXT.findall(text)
    return LATIN_TEXT.findall(text)


def merge_short(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the leftmost pair of lowest rank until no pair is in the table."""
    none, get = 1 << 62, merges.get
    found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best == none:
            break
        at, new = found.index(best), best & 0xFFFFF
        ids[at] = new
        del ids[at + 1], found[at]
        if at:
            found[at - 1] = get(ids[at - 1] << 20 | new, none)
        if at < len(found):
            found[at] = get(new << 20 | ids[at + 1], none)
    return ids


def merge_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    """The same result with a heap over linked positions, for fragments of any length."""
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(m >> 20, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = merges[a << 20 | b] & 0xFFFFF, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else -1
            if right >= 0 and (m := merges.get(ids[left] << 20 | ids[right])) is not None:
                heapq.heappush(heap, (m >> 20, left, ids[left], ids[right]))
    return [i for i in ids if i >= 0]


def id_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype("i4")
    flat = np.concatenate(rows) if rows else np.empty(0, "i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype("i4"), pa.int32()))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows (id, text) whose texts a task may hold at a time."""
    start, chars = 0, 0
    for at, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
        if at > start and (at - start == SLICE or chars + n > SLICE_CHARS):
            yield batch.slice(start, at - start)
            start, chars = at, 0
        chars += n
    if batch.num_rows > start:
        yield batch.slice(start)


def joined_tokens(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """The tokens of each list joined by one space."""
    flat = names.take(ids.flatten())
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.scalar(" ", names.type)).cast(pa.string())


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the token ids of every text, equal to the tokenizer's own without special tokens added.

    NULL and empty texts give an empty array; repeated rows and NULL ids a row each; other columns are left out. The file is
    read once on the driver and sent to the tasks; its size is the bound of what is sent. Results leave a task ``SLICE``
    documents at a time, so its memory holds no more than one incoming batch.
    """
    return _coded(docs, tokenizer, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text): ``encode`` and ``decode`` in one pass, so a task runs one Python worker with one set of tables."""
    return _coded(docs, tokenizer, "doc_id long, ids array<int>, text string")


def _coded(docs: DataFrame, tokenizer: str, schema: str) -> DataFrame:
    tables, decoded = shipped(docs.sparkSession, Tables(tokenizer)), "text" in schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(tables())
        names = pa.array(own.t.tokens, pa.large_string()) if decoded else None
        for batch in batches:
            for part in slices(batch):
                ids = id_lists([own.encode(text.as_py()) for text in part.column(1)])
                found = [part.column(0), ids, *([joined_tokens(ids, names)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(found, ["doc_id", "ids", "text"][:len(found)])
        own.clear()
        own.fragments.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text): what the tokenizer decodes the ids to, its tokens joined by one space; NULL ids give ''."""
    tokens = shipped(coded.sparkSession, Tables(tokenizer).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(tokens(), pa.large_string())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), joined_tokens(part.column(1), names)], ["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
