"""Alignment of two tokenisations of the same text: groups of tokens that cover the same bytes, and links between them."""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.llm.common import settle
from ordinalis.session import small_side

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters that are tokenised at once (a longer text alone), token ids in a window that is remembered, and windows in a generation of those
#: remembered.
AT_ONCE = 1 << 18
MEMO_IDS = 48
MEMO_SIZE = 1 << 17
#: Parts the ids of the two sides in a key.
SIDES = b"\xff\xff\xff\xff"
#: Pairs of ids up to which their counts are broadcast; a row of them has three longs. Above it they are joined by a shuffle.
FEW_PAIRS = 1_000_000

# How byte-level BPE cuts a text into parts, and characters whose class is the same in every Unicode version.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_COMMON = re.compile("[\t\n\r\x20-\x7e\u00a1-\u024f\u2010-\u2027\u2030-\u205e]*")
_LONG = re.compile(r"\S{400}|\s{400}")


def byte_alphabet() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for their byte, the other bytes for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every id, their lengths, whether they begin with a space, and the id as text."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.names = tokens, [str(i) for i in range(len(tokens))]
        self.sizes = [len(t) for t in tokens]
        self.lengths = np.array(self.sizes, np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in tokens], bool)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class ByteLevel:
    """Byte-level BPE of a tokenizers file. Special tokens in a text are plain text.

    Texts of common characters without very long words go through merges by rank, which are faster and give the same ids
    if the file is what `ranked` asks for; all others go through the file's own tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["id"] for t in made.get("added_tokens", [])}
        alphabet = byte_alphabet()
        words = {i: w for w, i in self.model.get_vocab(with_added_tokens=True).items()}
        self.vocabulary = Vocabulary([words[i].encode() if i in special else bytes(map(alphabet.__getitem__, words[i])) if i in words else b""
                                      for i in range(max(words) + 1)])
        self.fast = self.ranked(made, {w: i for i, w in words.items() if i not in special})

    def ranked(self, made: dict, ids: dict[str, int]):
        """Merges by rank, if they are the same as the file's merges; else None.

        They are if the parts of a text are cut by the common pattern, the k-th merge makes the k-th id after the bytes, and
        the file encodes every token as itself. For take the first step at which merging the pair of lowest rank differs
        from the listed merges: it joins two parts to a token by a pair that is not listed. What lies under the two parts
        was merged as if it stood alone, so the file, given that token alone, comes to the same two parts and stops there.
        """
        import tiktoken

        listed = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        first = len(ids) - len(listed)
        cut, model = made.get("pre_tokenizer") or {}, self.model.model
        same = (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not made.get("normalizer")
                and all(ids.get(x + y) == first + k for k, (x, y) in enumerate(listed))
                and all([t.id for t in model.tokenize(w)] == [i] for w, i in ids.items()))
        if not same:
            return None
        ranks = {self.vocabulary.tokens[i]: i for i in ids.values()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and _COMMON.fullmatch(t) is not None and not _LONG.search(t) for t in texts]
        rest = iter(self.model.encode_batch([" " + t for t, ok in zip(texts, plain, strict=True) if not ok], add_special_tokens=False))
        return [self.fast.encode_ordinary(" " + t) if ok else next(rest).ids for t, ok in zip(texts, plain, strict=True)]


class Pieces:
    """Sentencepiece model that sets a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = Vocabulary([bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
                                      for i in range(m.get_piece_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteLevel | Pieces:
    """One for each file and Python worker."""
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


Window = tuple[str, bytes]


def align_window(a: list[int], b: list[int], va: Vocabulary, vb: Vocabulary) -> Window:
    """Groups of one window as text, and the pairs of ids that end together (longs a * 2^32 + b), one for each group."""
    names_a, sizes_a, names_b, sizes_b = va.names, va.sizes, vb.names, vb.sizes
    groups, links, ahead, last, right = [], [], 0, 0, ""
    left, rest = "", iter(b)
    for x in a:
        left = f"{left},{names_a[x]}" if left else names_a[x]
        ahead += sizes_a[x]
        while ahead > 0 and (y := next(rest, None)) is not None:
            right = f"{right},{names_b[y]}" if right else names_b[y]
            ahead -= sizes_b[y]
            last = y
        if ahead == 0:
            groups.append(f"{left}|{right}")
            links.append((x << 32) | last)
            left = right = ""
    return ";".join(groups), array("q", links).tobytes()


class Aligner:
    """Aligns texts. Windows between anchors are remembered by their ids, as words come again and again."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokenizer(path_a), tokenizer(path_b)
        self.memo: dict[bytes, Window] = {}
        self.older: dict[bytes, Window] = {}

    def window(self, key: bytes, a: list[int], b: list[int]) -> Window:
        """Alignment of a window that is not among the latest: from the generation before, or made anew."""
        found = self.older.get(key) or align_window(a, b, self.a.vocabulary, self.b.vocabulary)
        if len(key) <= 4 * MEMO_IDS:
            if len(self.memo) >= MEMO_SIZE:
                self.memo, self.older = {}, self.memo
            self.memo[key] = found
        return found

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Numbers of tokens before each shared end that stands before a space-marked token on both sides, and at the end."""
        va, vb = self.a.vocabulary, self.b.vocabulary
        at_a, at_b = np.flatnonzero(va.spaced[a[1:]]), np.flatnonzero(vb.spaced[b[1:]])
        ends_a, ends_b = np.cumsum(va.lengths[a])[at_a], np.cumsum(vb.lengths[b])[at_b]
        if len(ends_a) != len(ends_b) or (ends_a != ends_b).any():
            _, ia, ib = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
            at_a, at_b = at_a[ia], at_b[ib]
        return [*(at_a + 1).tolist(), len(a)], [*(at_b + 1).tolist(), len(b)]

    def align(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, int, str, bytes]:
        """n_a, n_b, n_groups, groups as text, links as longs; nothing where either side does not spell the space and the text."""
        data = (" " + text).encode("utf-8", "surrogatepass")
        if not text or self.a.vocabulary.joined(a) != data or self.b.vocabulary.joined(b) != data:
            return 0, 0, 0, "", b""
        ids_a, ids_b = np.array(a, np.int32), np.array(b, np.int32)
        packed_a, packed_b = ids_a.tobytes(), ids_b.tobytes()
        memo, groups, links, at_a, at_b = self.memo, [], [], 0, 0
        for to_a, to_b in zip(*self.anchors(ids_a, ids_b), strict=True):
            key = packed_a[4 * at_a:4 * to_a] + SIDES + packed_b[4 * at_b:4 * to_b]
            found = memo.get(key)
            if found is None:
                found = self.window(key, a[at_a:to_a], b[at_b:to_b])
                memo = self.memo
            groups.append(found[0])
            links.append(found[1])
            at_a, at_b = to_a, to_b
        packed = b"".join(links)
        return len(a), len(b), len(packed) // 8, ";".join(groups), packed


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Texts in turn, as many as fit in a bounded number of characters, at least one."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


_FIELDS = (("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()))


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(path_a, path_b)
    gc.disable()  # nothing here is cyclic, and the windows remembered would be visited again and again
    try:
        for batch in batches:
            at = 0
            for part in slices([t.as_py() or "" for t in batch.column("text")]):
                found = [aligner.align(t, a, b) for t, a, b in zip(part, aligner.a.encode(part), aligner.b.encode(part), strict=True)]
                columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(_FIELDS)]
                ends = np.cumsum([0, *(f[2] for f in found)], dtype=np.int32)
                links = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(f[4] for f in found), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), *columns, links],
                                                 names=["doc_id", *(n for n, _ in _FIELDS), "links"])
                at += len(part)
    finally:
        gc.enable()


def align_tokens(docs: DataFrame, folder: str = FOLDER, file_a: str = BYTE_BPE, file_b: str = PIECES, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) of every document.

    Each text is tokenised whole on both sides, A over a space and the text, B over the text, to which it adds the space.
    Byte offsets where tokens of both sides end cut the tokens into groups, written `a1,a2|b1;a3|b2,b3`; each such offset
    links the two ids that end there (a * 2^32 + b). Shared offsets before tokens that begin with a space split a text
    into windows, which are aligned one by one and remembered by their ids.

    A null or empty text, and one whose tokens do not spell it, has no tokens: zeros, empty groups and links. Null ids stay,
    repeated rows each give a row, an empty table gives an empty one, other columns are not read. Texts are tokenised a
    bounded number of characters at a time, a longer text alone, so memory grows with the longest text only.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    path_a, path_b = f"{folder}/{file_a}", f"{folder}/{file_b}"
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, groups string, links array<long>"
    return base.mapInArrow(lambda batches: _aligned(batches, path_a, path_b), schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): how many links of the corpus hold a pair of ids, and whether it is the highest of its B id."""
    counts = settle(aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    low = F.lit((1 << 32) - 1)
    highest = counts.groupBy(F.col("pair").bitwiseAND(low).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(highest, F.col("pair").bitwiseAND(low) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """The columns of `aligned` but `links`, with n_links, n_best (links whose pair is its B id's most frequent, ties
    included) and count_sum (over links, the links of the corpus that hold the same pair).

    The table is written once; its links are counted with partial sums and looked up pair by pair, each document's sums
    being formed where it lies. Pairs are bounded by the two vocabularies; few are broadcast, more are joined by a shuffle.
    """
    stored = settle(aligned.withColumn("row", F.monotonically_increasing_id()))
    pairs = small_side(pair_counts(stored), FEW_PAIRS).withColumnRenamed("pair", "of")
    sums = (stored.select("row", F.explode("links").alias("pair")).join(pairs, F.col("pair") == F.col("of"))
            .groupBy(F.col("row").alias("r")).agg(F.count_if("best").alias("best"), F.sum("n").alias("total")))
    counted = stored.withColumn("n_links", F.size("links").cast("long")).drop("links")
    return counted.join(sums, F.col("row") == F.col("r"), "left").select(
        *[c for c in aligned.columns if c != "links"], "n_links",
        F.coalesce("best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("total", F.lit(0)).cast("long").alias("count_sum"))
