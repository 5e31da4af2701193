"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes around it also starts in a
document with a smaller id. Suffixes are sorted only where they matter:

1. Anchors. Among the 27 grams of 24 bytes in a 50-byte string (for other
   lengths: about half of it) those of least hash are anchors. They depend on
   the string alone, so two equal strings have the same anchors.
2. Every block of documents asks, by gram hash, which of its anchors occur in
   another document too (an exchange of packed hashes, one per block and
   hash). The rest can take no part in a repeat.
3. Every block sorts the suffixes at its remaining anchors (the string to the
   right of the anchor, then what stands to its left, backwards) and sends
   front-coded runs, dealt by gram.
4. A loser tree merges the runs of a part. It knows of every suffix how many
   bytes it shares with the last one put out, and compares only what follows
   such known prefixes. The merged order brings equal suffixes together and
   shows which documents share strings around an anchor.
5. The intervals found go back to the blocks, which cut the texts.

The documents are dealt to blocks by a hash of the id, in one exchange that
steps 2, 3 and 5 read alike. Blocks have ``block_rows`` documents on average
and parts the anchors of ``part_rows``; both grow in number, not in size. A
gram that very many documents hold is sent once per block and distinct
surrounding text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import frugal, frugal_pair, pack, pack_sorted, text_buffer, unpack, unpack_sorted

LENGTH = 50
BLOCK_ROWS = 2048
BLOCK_BYTES = 48 << 20  # text of a block, on average
SHORTEST, LONGEST = 8, 16384  # strings that can be looked for: a gram holds 8 bytes at least, two bytes count what a suffix shares
PART_ROWS = 4096
_SEGMENT = 1 << 20  # bytes worked on at once
_BASE = 0x100000001B3
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_size(length: int) -> int:
    return max(8, length // 2 // 8 * 8)


def key_size(length: int) -> int:
    """Bytes of an anchored string: right of the anchor's start, left of it, and how far each side goes (two bytes each)."""
    return 2 * length - gram_size(length) + 4


def _ends(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far anchored strings go to the right and to the left."""
    ends = np.ascontiguousarray(keys[:, -4:]).view(">u2").astype(np.int64)
    return ends[:, 0], ends[:, 1]


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over a[i:i + width], for i up to len(a) - width."""
    n = 1
    while n * 2 <= width:
        a = best(a[:-n], a[n:])
        n *= 2
    return best(a[:len(a) - (width - n)], a[width - n:]) if n < width else a


def _segment_anchors(raw: np.ndarray, window_ok: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows that start at 0 .. len(window_ok) - 1: positions and gram hashes. raw has length - 1 bytes more."""
    k = gram_size(length)
    wide = length - k + 1
    n = len(window_ok) + wide - 1  # grams
    h = np.zeros(n, dtype=np.uint64)
    for j in range(0, k, 8):
        x = np.ndarray((n,), dtype="<u8", buffer=raw, offset=j, strides=(1,))
        h ^= x
        h *= _M1
        h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    least = _sliding(h, wide, np.minimum)
    least[~window_ok] = 0
    padded = np.concatenate([np.zeros(wide - 1, dtype=np.uint64), least, np.zeros(wide - 1, dtype=np.uint64)])
    at = np.flatnonzero(_sliding(padded, wide, np.maximum) == h)
    return at, h[at]


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in raw, ascending) and gram hashes of the anchors of all strings of ``length`` bytes inside one document."""
    total = len(raw)
    if total < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    ok = np.ones(total - length + 1, dtype=bool)
    for end in offsets[1:-1]:  # strings that would cross from one document into the next
        ok[max(0, end - length + 1):end] = False
    at, hashes = [], []
    for lo in range(0, len(ok), _SEGMENT):
        part = ok[lo:lo + _SEGMENT]
        p, h = _segment_anchors(raw[lo:lo + len(part) + length - 1], part, length)
        at.append(p + lo)
        hashes.append(h)
    p, h = np.concatenate(at), np.concatenate(hashes)
    p, first = np.unique(p, return_index=True)
    return p, h[first]


class _Block:
    """The documents of a block, in order of (id, text hash); rows that repeat both are one."""

    def __init__(self, table: pa.Table, length: int):
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        hashes = table.column("_h").to_numpy(zero_copy_only=False)
        order = np.lexsort((hashes, ids))
        self.order = order
        same = np.concatenate([[False], (ids[order][1:] == ids[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])]) if len(order) else np.zeros(0, bool)
        self.row_doc = np.cumsum(~same) - 1  # of the ordered rows
        keep = order[~same]
        self.ids = ids[keep]
        self.raw, self.offsets = text_buffer(table.column("text").take(pa.array(keep)))
        self.length = length

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, h = anchors(self.raw, self.offsets, self.length)
        return at, h, np.searchsorted(self.offsets, at, side="right") - 1


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _ask(length: int, parts: int):
    """Step 2, a block's distinct gram hashes, and whether two of its own documents share them."""
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, length)
        _, h, doc = block.anchors()
        ids = block.ids[doc] if len(doc) else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.zeros(0, np.int64)
        shared = np.minimum.reduceat(ds, first) != np.maximum.reduceat(ds, first) if len(first) else np.zeros(0, bool)
        unique, part = hs[first], _parts(hs[first], parts)
        out = {"_p": [], "hashes": [], "shared": []}
        for p in np.unique(part):
            own = part == p
            out["_p"].append(int(p))
            out["hashes"].append(pack_sorted(unique[own]))
            out["shared"].append(np.packbits(shared[own]).tobytes())
        number = table.column("_block")[0].as_py()
        return pa.table({"_p": pa.array(out["_p"], pa.int64()), "_block": pa.array([number] * len(out["_p"]), pa.int64()),
                         "hashes": pa.array(out["hashes"], pa.binary()), "shared": pa.array(out["shared"], pa.binary())})
    return run


def _answer(table: pa.Table) -> pa.Table:
    """Step 2, a part's answer: a bit for every hash that a block asked for, set if a second document holds it."""
    blocks = table.column("_block").to_pylist()
    asked = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    shared = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)).astype(bool) for x, a in zip(table.column("shared").to_pylist(), asked)]
    everything = np.concatenate(asked)
    everything.sort()
    twice = everything[1:][everything[1:] == everything[:-1]]
    twice = np.unique(np.concatenate([twice, *[a[s] for a, s in zip(asked, shared)]]))
    bits = []
    for a in asked:
        place = np.searchsorted(twice, a)
        bits.append(np.packbits(twice[np.minimum(place, len(twice) - 1)] == a).tobytes() if len(twice) else np.packbits(np.zeros(len(a), bool)).tobytes())
    p = table.column("_p")[0].as_py()
    return pa.table({"_block": pa.array(blocks, pa.int64()), "_p": pa.array([p] * len(blocks), pa.int64()), "bits": pa.array(bits, pa.binary())})


def _front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bytes that each of the sorted keys shares with the one before, and the bytes that follow these."""
    n, wide = keys.shape
    differ = keys[1:] != keys[:-1]
    common = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), wide)]).astype(np.uint16)
    rest = keys[np.arange(wide)[None, :] >= common[:, None]]
    return common, rest.tobytes()


def _front_decode(common: np.ndarray, rest: np.ndarray, wide: int) -> np.ndarray:
    n = len(common)
    fresh = np.arange(wide)[None, :] >= common[:, None]
    keys = np.zeros((n, wide), dtype=np.uint8)
    keys[fresh] = rest
    # A byte that is shared comes from the last row above that had its own byte there.
    source = np.maximum.accumulate(np.where(fresh, np.arange(n)[:, None], 0), axis=0)
    return np.take_along_axis(keys, source, axis=0)


def _runs(length: int, parts: int):
    """Step 3, a block's front-coded sorted runs."""
    k = gram_size(length)
    left = length - k
    wide = key_size(length)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"_p": [], "common": [], "rest": [], "id": [], "counts": [], "docs": [], "at": []}
        number = table.column("_block")[0].as_py() if table.num_rows else None
        block = _Block(table, length) if table.num_rows and answers.num_rows else None
        if block is not None:
            at, h, doc = block.anchors()
            order = np.argsort(h, kind="stable")
            hs = h[order]
            group = np.cumsum(np.concatenate([[True], hs[1:] != hs[:-1]])) - 1 if len(hs) else np.zeros(0, np.int64)
            unique = hs[np.concatenate([[True], hs[1:] != hs[:-1]])] if len(hs) else hs
            part = _parts(unique, parts)
            repeated = np.zeros(len(unique), dtype=bool)
            for p, bits in zip(answers.column("_p").to_pylist(), answers.column("bits").to_pylist()):
                own = np.flatnonzero(part == p)
                repeated[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
            at, doc, part = at[order][repeated[group]], doc[order][repeated[group]], part[group][repeated[group]]
            padded = np.concatenate([np.zeros(left, np.uint8), block.raw, np.zeros(length, np.uint8)])
            for p in np.unique(part):
                own = part == p
                a, d = at[own], doc[own]
                # Anchored strings stop at the edges of their document; the last four bytes say how far they go.
                right_end = np.minimum(length, block.offsets[d + 1] - a)
                left_end = np.minimum(left, a - block.offsets[d])
                key = np.empty((len(a), wide), dtype=np.uint8)
                i = np.arange(length)[None, :]
                key[:, :length] = np.where(i < right_end[:, None], padded[left + a[:, None] + i], 0)
                i = np.arange(left)[None, :]
                key[:, length:length + left] = np.where(i < left_end[:, None], padded[left + a[:, None] - 1 - i], 0)
                key[:, -4:] = np.stack([right_end, left_end], axis=1).astype(">u2").view(np.uint8)
                rank = np.argsort(_sortable(key), kind="stable")
                key, a, d = key[rank], a[rank], d[rank]
                new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
                first = np.flatnonzero(new)
                common, rest = _front_code(key[first])
                counts = np.diff(np.concatenate([first, [len(a)]]))
                out["_p"].append(int(p))
                out["common"].append(pack(common))
                out["rest"].append(pack(np.frombuffer(rest, np.uint8)))
                out["id"].append(pack(block.ids[d]))
                out["counts"].append(pack(counts.astype(np.uint32)))
                out["docs"].append(pack(d.astype(np.uint32)))
                out["at"].append(pack((a - block.offsets[d]).astype(np.uint32)))
        n = len(out["_p"])
        return pa.table({"_p": pa.array(out["_p"], pa.int64()), "_block": pa.array([number] * n, pa.int64()),
                         **{c: pa.array(out[c], pa.binary()) for c in ("common", "rest", "id", "counts", "docs", "at")}})
    return run


def _sortable(keys: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings that sort as the rows do (a final byte keeps trailing zeros from being dropped)."""
    marked = np.concatenate([keys, np.ones((len(keys), 1), np.uint8)], axis=1)
    return np.ascontiguousarray(marked).view(f"S{marked.shape[1]}").ravel()


def merge_runs(runs: list[tuple[bytes, np.ndarray]], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Loser tree over sorted runs (keys end to end, shared prefix lengths within the run).

    Returns, in merged order, the run that each key comes from and the bytes
    that it shares with the key before. A contender and the loser that waits
    at a node both know what they share with the last key put out. The one
    that shares more is smaller; only if they share equally much are bytes
    compared, from there on.
    """
    count = len(runs)
    if count == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint16)
    if count == 1:
        return np.zeros(len(runs[0][1]), np.int32), runs[0][1].copy()
    leaves = 1 << (count - 1).bit_length()
    sizes = [len(c) for _, c in runs] + [0] * (leaves - count)
    keys = [k for k, _ in runs]
    commons = [c.tolist() for _, c in runs]
    head: list = [keys[r][:wide] if r < count and sizes[r] else None for r in range(leaves)]
    share = [0] * leaves
    place = [0] * leaves
    loser = [0] * leaves
    number = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's share becomes what it shares with the winner."""
        ka, kb = head[a], head[b]
        if ka is None:
            return b, a
        if kb is None:
            return a, b
        sa, sb = share[a], share[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        x, y = number(ka[sa:], "big"), number(kb[sa:], "big")
        if x == y:
            first, second, both = (a, b, wide) if a < b else (b, a, wide)
        else:
            both = wide - ((x ^ y).bit_length() + 7) // 8
            first, second = (a, b) if x < y else (b, a)
        share[second] = both
        return first, second

    winners = list(range(leaves))
    width, node = leaves, leaves // 2
    while width > 1:
        following = []
        for i in range(0, width, 2):
            w, l = play(winners[i], winners[i + 1])
            loser[node + i // 2] = l
            following.append(w)
        winners, width, node = following, width // 2, node // 2
    w = winners[0]
    total = sum(sizes)
    from_run, shared = [0] * total, [0] * total
    for i in range(total):
        from_run[i], shared[i] = w, share[w]
        p = place[w] + 1
        place[w] = p
        if p < sizes[w]:
            head[w] = keys[w][p * wide:(p + 1) * wide]
            share[w] = commons[w][p]
        else:
            head[w] = None
        node = (w + leaves) >> 1
        while node:
            other = loser[node]
            ko, kw = head[other], head[w]
            if ko is not None:
                if kw is None:
                    loser[node], w = w, other
                else:
                    sw, so = share[w], share[other]
                    if sw < so:
                        loser[node], w = w, other
                    elif sw == so:
                        x, y = number(kw[sw:], "big"), number(ko[sw:], "big")
                        if x == y:
                            if w < other:
                                share[other] = wide
                            else:
                                share[w] = wide
                                loser[node], w = w, other
                        else:
                            both = wide - ((x ^ y).bit_length() + 7) // 8
                            if x < y:
                                share[other] = both
                            else:
                                share[w] = both
                                loser[node], w = w, other
            node >>= 1
    return np.array(from_run, dtype=np.int32), np.array(shared, dtype=np.uint16)


def _reach(keys: np.ndarray, group: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct anchored strings: the largest and least offset of the anchor in a string that a smaller id holds (-1, none).

    ``group`` numbers the grams, ``owner`` is the least id with that string.
    """
    left = length - gram_size(length)
    n = len(keys)
    most, least = np.full(n, -1, np.int64), np.full(n, 1 << 30, np.int64)
    base = np.uint64(_BASE)
    shrink = np.uint64(pow(_BASE, -1, 1 << 64))  # takes the last byte out of a hash again
    if n == 0:
        return most, least
    right_end, left_end = _ends(keys)
    letter = lambda j: (keys[:, j].astype(np.uint64) + np.uint64(1)) * _M2
    rights = np.zeros(n, dtype=np.uint64)  # of the first length - o bytes
    for t in range(length):
        rights = rights * base + letter(t)
    salt = group.astype(np.uint64) * _M1
    power = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in range(length):
            power.append(power[-1] * base)
        lefts = np.zeros(n, dtype=np.uint64)
        for o in range(left + 1):
            if o:
                lefts = lefts + letter(length + o - 1) * power[o - 1]
                rights = (rights - letter(length - o)) * shrink
            ok = np.flatnonzero((left_end >= o) & (right_end >= length - o))
            if not len(ok):
                continue
            h = (lefts[ok] * power[length - o] + rights[ok]) ^ salt[ok]
            h *= _M1
            h ^= h >> np.uint64(31)
            order = np.argsort(h)
            hs, own = h[order], owner[ok][order]
            first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
            smallest = np.repeat(np.minimum.reduceat(own, first), np.diff(np.concatenate([first, [len(hs)]])))
            hit = ok[order[smallest < own]]
            most[hit] = np.maximum(most[hit], o)
            least[hit] = np.minimum(least[hit], o)
    return most, least


def _merge(length: int):
    """Step 4, a part: merge its runs and find the intervals of every block."""
    k = gram_size(length)
    left = length - k
    wide = key_size(length)

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("_block", "common", "rest", "id", "counts", "docs", "at")}
        common = [unpack(x, np.uint16) for x in cols["common"]]
        keys = [_front_decode(c, unpack(x, np.uint8), wide) for c, x in zip(common, cols["rest"])]
        from_run, shared = merge_runs([(m.tobytes(), c) for m, c in zip(keys, common)], wide)
        back = np.argsort(from_run, kind="stable")  # merged place of each key, run by run
        everything = np.concatenate(keys)
        merged = np.empty_like(everything)
        merged[back] = everything
        del keys, everything
        ids = np.empty(len(back), dtype=np.int64)
        ids[back] = np.concatenate([np.minimum.reduceat(unpack(i, np.int64), np.concatenate([[0], np.cumsum(unpack(c, np.uint32).astype(np.int64))[:-1]]))
                                    for i, c in zip(cols["id"], cols["counts"])])
        new = shared < wide
        new[0] = True
        first = np.flatnonzero(new)
        string = np.cumsum(new) - 1  # equal strings share a number
        owner = np.minimum.reduceat(ids, first)
        gram = np.cumsum(np.concatenate([[True], shared[first][1:] < k])) - 1
        size = np.bincount(gram)
        mixed = size[gram] > 1
        most = np.full(len(first), -1, np.int64)
        least = np.full(len(first), 1 << 30, np.int64)
        most[mixed], least[mixed] = _reach(merged[first][mixed], gram[mixed], owner[mixed], length)
        right_end, left_end = _ends(merged[first])
        rows: dict[str, list] = {"_block": [], "docs": [], "begin": [], "end": []}
        start = 0
        for b, c, d, a, i in zip(cols["_block"], cols["counts"], cols["docs"], cols["at"], cols["id"]):
            counts = unpack(c, np.uint32).astype(np.int64)
            of = np.repeat(string[back[start:start + len(counts)]], counts)
            start += len(counts)
            docs, at = unpack(d, np.uint32), unpack(a, np.uint32).astype(np.int64)
            ids_of = unpack(i, np.int64)
            # All that stands around the anchor is in a smaller document: every string through the anchor goes.
            known = ids_of > owner[of]
            o_most = np.where(known, np.minimum(left, left_end[of]), most[of])
            o_least = np.where(known, np.maximum(0, length - right_end[of]), least[of])
            hit = (o_most >= 0) & (o_least <= o_most)
            if hit.any():
                rows["_block"].append(b)
                rows["docs"].append(pack(docs[hit]))
                rows["begin"].append(pack((at - o_most)[hit].astype(np.uint32)))
                rows["end"].append(pack((at + length - o_least)[hit].astype(np.uint32)))
        return pa.table({"_block": pa.array(rows["_block"], pa.int64()), **{c: pa.array(rows[c], pa.binary()) for c in ("docs", "begin", "end")}})
    return run


def _cut(length: int, as_text: bool):
    """Step 5, a block: the texts without the intervals, as bytes, or as text without the characters that a cut splits."""
    form = (lambda b: b.decode("utf-8", "ignore")) if as_text else bytes

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        block = _Block(table, length)
        raw, offsets = block.raw, block.offsets
        edge = np.zeros(len(raw) + 1, dtype=np.int32)
        for d, b, e in zip(*[found.column(c).to_pylist() for c in ("docs", "begin", "end")]):
            base = offsets[unpack(d, np.uint32)]
            np.add.at(edge, base + unpack(b, np.uint32), 1)
            np.add.at(edge, base + unpack(e, np.uint32), -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        docs = len(offsets) - 1
        starts, sizes, kept = [], [], []
        for i in range(docs):
            lo, hi = offsets[i], offsets[i + 1]
            own = gone[lo:hi]
            if own.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                starts.append(turn[0::2].tolist())
                sizes.append(turn[1::2].tolist())
                kept.append(form(raw[lo:hi][~own].tobytes()))
            else:
                starts.append([])
                sizes.append([])
                kept.append(form(raw[lo:hi].tobytes()))
        rows = block.row_doc  # for the ordered rows
        ids = table.column("doc_id").take(pa.array(block.order))
        hashes = table.column("_h").take(pa.array(block.order))
        take = lambda xs, kind: pa.array([xs[i] for i in rows], kind)
        lengths = np.diff(offsets)
        return pa.table({"doc_id": ids.cast(pa.int64()), "text_hash": hashes.cast(pa.int64()), "n_bytes": pa.array(lengths[rows], pa.int64()),
                         "span_begin": take(starts, pa.list_(pa.int32())), "span_end": take(sizes, pa.list_(pa.int32())), "kept": take(kept, pa.string() if as_text else pa.binary())})
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS,
                   as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the bytes that a smaller document has already.

    Returns doc_id, text_hash (xxhash64 of the text), n_bytes, span_begin and
    span_end (byte offsets of the removed runs, ends exclusive) and kept (the
    remaining bytes; with ``as_text`` a string, without the characters of
    which only a part remains), one row per input row. Strings are judged on the input;
    matches never cross documents and never join rows of the same id, so rows
    that repeat an id do not take from each other. A null text counts as
    empty. A row with a null id takes no part: it keeps its bytes and none
    are removed for its sake. Texts shorter than ``length`` keep all. Other
    columns are ignored; an empty table gives no rows. ``length`` goes from 8
    to 16,384 bytes; others raise a ValueError. Long texts make more blocks
    and parts: ``BLOCK_BYTES`` of text count as much as ``block_rows`` rows.
    """
    if not SHORTEST <= length <= LONGEST:
        raise ValueError(f"length must be from {SHORTEST} to {LONGEST}, not {length}")
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()
    blocks = max(1, n // block_rows, size // BLOCK_BYTES)
    parts = max(1, n // part_rows, size // (2 * BLOCK_BYTES))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("_h", F.xxhash64("text"))
    lone = base.filter(F.col("doc_id").isNull())
    # One exchange, read by three steps: all of them need these four columns as they are.
    dealt = base.filter(F.col("doc_id").isNotNull()).withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long"))
    asked = dealt.groupBy("_block").applyInArrow(frugal(_ask(length, parts)), "_p long, _block long, hashes binary, shared binary")
    answers = asked.groupBy("_p").applyInArrow(frugal(_answer), "_block long, _p long, bits binary")
    runs = dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        frugal_pair(_runs(length, parts)), "_p long, _block long, common binary, rest binary, id binary, counts binary, docs binary, at binary")
    found = runs.groupBy("_p").applyInArrow(frugal(_merge(length)), "_block long, docs binary, begin binary, end binary")
    kind = "string" if as_text else "binary"
    cut = dealt.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(
        frugal_pair(_cut(length, as_text)), f"doc_id long, text_hash long, n_bytes long, span_begin array<int>, span_end array<int>, kept {kind}")
    none = F.array().cast("array<int>")
    return cut.unionByName(lone.select("doc_id", F.col("_h").alias("text_hash"), F.octet_length("text").cast("long").alias("n_bytes"),
                                       none.alias("span_begin"), none.alias("span_end"), F.col("text").cast(kind).alias("kept")))


def digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of ``remove_repeats``."""
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("span_begin").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
runs AS (SELECT doc_id, i, CASE WHEN i > max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
                                WHEN row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 THEN 1 ELSE 0 END AS new FROM hit),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM runs),
spans AS (SELECT doc_id, g, min(i) AS b, max(i) + 50 AS e FROM numbered GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS prev FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed, max(e) AS last,
               string_agg(substr(x, 2 * prev + 1, 2 * (b - prev)), '' ORDER BY b) AS head
        FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
