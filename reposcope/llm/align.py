"""Cross-tokenizer alignment by interval coalescing.

Every text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with
byte fallback), and both token sequences are laid over the same bytes, a space
and the text. In each block of texts all A and B tokens are lexsorted by their
start; ``maximum.accumulate`` over their ends gives the furthest byte reached,
and a group breaks where a start reaches it. Inside the groups, overlaps are
expanded to links between an A and a B token.

How often an (A id, B id) pair is linked in the whole corpus is counted once
per block and pair, then over all blocks; the totals go back to the blocks as
they came, so that nothing but the greatest count of each B id, as many rows
as B has entries, is ever broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .packed import frugal_pair, give_back, pack, unpack
from .token_counts import PieceCounter, model_path

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 2 << 20
#: Longer texts are encoded in pieces, cut where no token can cross.
PIECE_CHARS = 1 << 16
#: Words whose tokens a worker keeps.
KEPT = 200_000
_BATCH = 1 << 18  # characters given to a library at once
_LATIN = re.compile("[\x00-\u024f]*")
#: Fixed value: the words of byte-level BPE.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCKS = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
          "codes binary, n binary, links binary")
_BLOCK = pa.schema([("block", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
                    ("groups_sha256", pa.list_(pa.string())), *((k, pa.binary()) for k in ("codes", "n", "links"))])
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
DIGEST = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


class Pair:
    """Both tokenizers of a worker and the bytes of their entries."""

    def __init__(self, a: str, b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(model_path(a))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path(b))
        plain = _byte_of_char()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [_decoded(self.a.id_to_token(i) or "", plain) for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        na, nb = size, len(self.b_bytes)
        # Every token with what follows it: a comma, or the end of its group's A or B tokens.
        self.shown = [f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)] + [f"{i}," for i in range(nb)] + [f"{i};" for i in range(nb)]
        self.known: dict[str, tuple[int, ...]] = {}
        # No token crosses a space between two characters that are neither white space nor B's mark:
        # A's pre-tokens start there, and no piece of B joins a word to a following mark.
        self.lone = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
        spec = json.loads(self.a.to_str())
        before = spec["pre_tokenizer"] or {}
        self.cuts = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
                     and PieceCounter(model_path(b)).proved)
        self.fast = _ranked(spec, self.a_bytes) if self.cuts else None

    def pieces(self, text: str) -> list[str]:
        """A long text cut at lone spaces, which are left out: both tokenizers put one before every piece."""
        if len(text) <= 2 * PIECE_CHARS or not self.cuts:
            return [text]
        out, lo = [], 0
        while len(text) - lo > 2 * PIECE_CHARS:
            found = self.lone.search(text, lo + PIECE_CHARS)
            if found is None:
                break
            out.append(text[lo:found.start()])
            lo = found.end()
        return [*out, text[lo:]]

    def _by_a(self, pieces: list[str]) -> Iterator[list[int]]:
        plain = [self.fast is not None and _LATIN.fullmatch(p) is not None for p in pieces]
        rest = iter(self.a.encode_batch([" " + p for p, x in zip(pieces, plain) if not x], add_special_tokens=False))
        for p, x in zip(pieces, plain):
            yield self.fast(" " + p) if x else next(rest).ids

    def _by_b(self, pieces: list[str]) -> Iterator[list[int]]:
        """Pieces with lone spaces only go word by word, as no token of B crosses a space; a worker keeps the words' tokens."""
        known = self.known
        if len(known) > KEPT:
            known.clear()
        words = [p.split(" ") if self.cuts and "  " not in p and "▁" not in p and p[0] != " " else None for p in pieces]
        new = [w for w in dict.fromkeys(chain.from_iterable(w for w in words if w)) if w not in known]
        known.update(zip(new, map(tuple, self.b.encode(new, num_threads=1))))
        if "" in known:  # a space at the end of a piece
            known[""] = tuple(self.b.encode("a "))[1:]
        rest = iter(self.b.encode([p for p, w in zip(pieces, words) if not w], num_threads=1))
        for w in words:
            yield list(chain.from_iterable(map(known.__getitem__, w))) if w else next(rest)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by A (of a space and the text) and by B; empty where the bytes differ from space and text."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            cut = self.pieces(text) if text else []
            parts += cut
            owner += [i] * len(cut)
        out_a: list[list[int]] = [[] for _ in texts]
        out_b: list[list[int]] = [[] for _ in texts]
        lo = 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= _BATCH):
                size += len(parts[hi])
                hi += 1
            some = parts[lo:hi]
            for i, a, b in zip(owner[lo:hi], self._by_a(some), self._by_b(some)):
                out_a[i] += a
                out_b[i] += b
            lo = hi
        for i, text in enumerate(texts):
            whole = (" " + text).encode() if text else b""
            if b"".join(map(self.a_bytes.__getitem__, out_a[i])) != whole or b"".join(map(self.b_bytes.__getitem__, out_b[i])) != whole:
                out_a[i], out_b[i] = [], []
        return out_a, out_b


def _ranked(spec: dict, entries: list[bytes]):
    """A quicker encoder that merges by rank, as A does if its ids are in the order of its merges; else None.

    Only for texts of letters that every version of Unicode classes alike.
    """
    model, merges = spec["model"], spec["model"].get("merges") or []
    made = [model["vocab"].get(x + y) for x, y in (m.split(" ") if isinstance(m, str) else m for m in merges)]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and spec["normalizer"] is None
    if not plain or made != list(range(256, 256 + len(merges))):
        return None
    import tiktoken

    ranks = {entries[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}


def _decoded(entry: str, plain: dict[str, int]) -> bytes:
    return bytes(plain[c] for c in entry) if all(c in plain for c in entry) else entry.encode()


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every A and of every B token, tokens of each kind given in order."""
    start = np.concatenate([a_start, b_start])
    end = np.concatenate([a_end, b_end])
    order = np.lexsort((start,))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[:len(a_start)], group[len(a_start):]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray,
             a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping (A, B) token positions: each A token meets the B tokens of its group that end after its start and start before its end."""
    first = np.searchsorted(b_group, a_group)
    last = np.searchsorted(b_group, a_group, side="right")
    lo = np.maximum(first, np.searchsorted(b_end, a_start, side="right"))
    hi = np.minimum(last, np.searchsorted(b_start, a_end))
    n = np.maximum(hi - lo, 0)
    left = np.repeat(np.arange(len(a_start)), n)
    before = np.cumsum(n) - n
    return left, np.arange(int(n.sum())) - np.repeat(before - lo, n)


class Block:
    """The alignment of the texts of a block, laid end to end."""

    def __init__(self, pair: Pair, doc_id: list, a: list[np.ndarray], b: list[np.ndarray]):
        self.pair, self.doc_id = pair, doc_id
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a, b))
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        self.a_to, self.b_to = np.cumsum(self.n_a), np.cumsum(self.n_b)
        a_end, b_end = np.cumsum(pair.a_len[self.a]), np.cumsum(pair.b_len[self.b])
        a_start, b_start = a_end - pair.a_len[self.a], b_end - pair.b_len[self.b]
        self.a_group, self.b_group = coalesce(a_start, a_end, b_start, b_end)
        self.left, self.right = overlaps(a_start, a_end, b_start, b_end, self.a_group, self.b_group)

    def codes(self) -> np.ndarray:
        """A number for the id pair of every link."""
        return self.b[self.right].astype(np.int64) * len(self.pair.a_len) + self.a[self.left]

    def links(self) -> np.ndarray:
        """Links of every text."""
        return np.searchsorted(self.left, self.a_to) - np.searchsorted(self.left, self.a_to - self.n_a)

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every text, the number of its A and B tokens up to each group's end."""
        last_a, last_b = np.flatnonzero(np.diff(self.a_group, append=-1)) + 1, np.flatnonzero(np.diff(self.b_group, append=-1)) + 1
        for n_a, n_b, i, j in zip(self.n_a, self.n_b, self.a_to, self.b_to):
            yield (last_a[np.searchsorted(last_a, i - n_a, side="right"):np.searchsorted(last_a, i, side="right")] - (i - n_a),
                   last_b[np.searchsorted(last_b, j - n_b, side="right"):np.searchsorted(last_b, j, side="right")] - (j - n_b))

    def lines(self) -> Iterator[str]:
        """For every text its groups written out, ``a1,a2|b1;a3|b2,b3``."""
        na, nb = len(self.pair.a_len), len(self.pair.b_len)
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self.a_group, self.b_group))
        words = np.concatenate([self.a + na * last_a, 2 * na + self.b + nb * last_b])
        # A tokens come before the B tokens of their group, as the sort is stable.
        words = words[np.argsort(np.concatenate([self.a_group, self.b_group]), kind="stable")]
        to = self.a_to + self.b_to
        for i, j in zip(to - self.n_a - self.n_b, to):
            yield "".join(map(self.pair.shown.__getitem__, words[i:j].tolist()))[:-1]


def _blocks(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Texts (doc_id, text) by blocks."""
    ids, all_a, all_b, size = [], [], [], 0
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lo = 0
        while lo < len(keys):
            hi, chars = lo, 0
            while hi < len(keys) and (hi == lo or chars < _BATCH):
                chars += len(texts[hi] or "")
                hi += 1
            for key, text, x, y in zip(keys[lo:hi], texts[lo:hi], *pair.encode([t or "" for t in texts[lo:hi]])):
                more = len(text or "")
                if ids and size + more > BLOCK_CHARS:
                    yield Block(pair, ids, all_a, all_b)
                    ids, all_a, all_b, size = [], [], [], 0
                size += more
                ids.append(key)
                all_a.append(np.array(x, dtype=np.uint32))
                all_b.append(np.array(y, dtype=np.uint32))
            lo = hi
    if ids:
        yield Block(pair, ids, all_a, all_b)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def aligned_blocks(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment of all texts, a row per block of texts, written to shared storage.

    Arrays over the texts: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256. Over the block: its distinct id pairs ascending (codes,
    packed) with their links (n), and each link's place among them (links).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, x in enumerate(_blocks(pair_of(a, b), batches)):
            codes, place, n = np.unique(x.codes(), return_inverse=True, return_counts=True)
            row = {"block": (task << 32) + i, "doc_id": x.doc_id, "n_a": x.n_a, "n_b": x.n_b, "n_groups": [len(g) for g, _ in x.groups()],
                   "n_links": x.links(), "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.lines()],
                   "codes": pack(codes), "n": pack(n.astype(np.uint32)), "links": pack(place.astype(np.uint32))}
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=_BLOCK)
        give_back()
    return saved(_rows(docs, id_col, text_col).mapInArrow(run, BLOCKS), "aligned")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, n = unpack(row["codes"], np.int64), unpack(row["n"], np.uint32).astype(np.int64)
            for lo in range(0, len(codes), 1 << 18):
                part = codes[lo:lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row["block"], np.int64)), pa.array(part), pa.array(n[lo:lo + (1 << 18)])],
                                                 names=["block", "code", "n"])


def pair_counts(blocks: DataFrame, a: str) -> DataFrame:
    """Every id pair of each block with its links in the whole corpus.

    (block, code, total, best): best where no pair of the B id has more links
    in all. A pair has one row per block that holds it.
    """
    size = pair_size(a)
    found = blocks.select("block", "codes", "n").mapInArrow(_unpacked, "block long, code long, n long")
    found = saved(found.select("block", "code", F.sum("n").over(Window.partitionBy("code")).alias("total")), "pairs")
    b_id = F.floor(F.col("code") / size)
    most = found.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))  # at most as many rows as B has entries
    return (found.withColumn("b_id", b_id).join(F.broadcast(most), "b_id")
            .select("block", "code", "total", (F.col("total") == F.col("most")).alias("best")))


def pair_size(a: str) -> int:
    """Entries of A: a pair's code is B id x this + A id."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model_path(a)).get_vocab_size(with_added_tokens=True)


def _digested(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    order = np.argsort(counts.column("code").to_numpy())
    total, best = counts.column("total").to_numpy()[order], counts.column("best").to_numpy()[order].astype(np.int64)
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")}
    for row in blocks.to_pylist():
        place = unpack(row["links"], np.uint32)
        to = np.cumsum(row["n_links"])
        for k, v in (("count_sum", total), ("n_best", best)):
            sums = np.concatenate([[0], np.cumsum(v[place])])
            out[k] += (sums[to] - sums[to - row["n_links"]]).tolist()
        for k in out:
            if k in row:
                out[k] += row[k]
    return pa.table({k: pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in out.items()})


def alignment_digest(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model",
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the two tokenizations of every whole text lie over each other.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the
    greatest count of its B id in the whole corpus), count_sum (the links'
    pair counts), groups_sha256. One row per input row, repeated rows and null
    ids included. Null and empty texts, and texts that either tokenizer does
    not give back byte for byte after a space, have no tokens: zeros and an
    empty digest. An empty table gives no rows; other columns are ignored.
    """
    blocks = aligned_blocks(docs, a, b, id_col, text_col)
    counts = pair_counts(blocks, a)
    held = blocks.drop("codes", "n")
    return held.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(frugal_pair(_digested), DIGEST)


def alignments(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model",
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of every whole text and the groups they form.

    doc_id, a_ids, b_ids, and for each group the number of A and B tokens up
    to its end (a_ends, b_ends). Texts without tokens have empty arrays.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(pair_of(a, b), batches):
            ends = list(x.groups())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": x.doc_id, "a_ids": np.split(x.a, x.a_to[:-1]), "b_ids": np.split(x.b, x.b_to[:-1]),
                 "a_ends": [e for e, _ in ends], "b_ends": [e for _, e in ends]},
                schema=pa.schema([("doc_id", pa.int64()), *((k, pa.list_(pa.int32())) for k in ("a_ids", "b_ids", "a_ends", "b_ends"))]))
    return _rows(docs, id_col, text_col).mapInArrow(run, ALIGNED)
