"""A hierarchical Pitman-Yor bigram model over all training documents, and the scores of all documents by it.

Every context (the word before) is a Chinese restaurant whose dishes are the
words that follow it. A customer who opens a table there is a customer of the
one parent that all context restaurants share, the unigram restaurant, whose
own base is uniform over the known words and one unknown word. Seating is
sampled by BURN + SAMPLES Gibbs sweeps over all dishes. In a sweep the number
of tables of each dish is drawn from its conditional distribution given the
tables that the sweep before left in all restaurants, the parent among them,
and then that of each word in the parent. The dishes of a restaurant are
independent given a gamma variate of its number of tables; a word's dishes in
different restaurants meet in the parent and are drawn at once, each with the
others' customers there as the sweep before left them. Counts of tables are
averaged over the samples and give the predictive probabilities

    p1(w)     = (t.w - d1 m_w + (b1 + d1 m.) / (V + 1)) / (b1 + t..)
    p(w | u)  = (c_uw - d2 t_uw + (b2 + d2 t_u.) p1(w)) / (b2 + c_u.)

The work is dealt by word. A block of documents sends each part what follows
of its words: contexts, and the documents that hold the pair, packed. A part
merges its blocks and so knows c_uw, and for its words all restaurants. What
the restaurants of a context need from other parts (customers and tables of
the context) goes through one exchange of sums and back:

    pass 1  counts          -> customers and dishes of every context
    pass 2  Gibbs sweep     -> tables of every context, once for each sweep
    pass 3  probabilities   -> sums for every document

Passes 1 and 3 read the same exchange; the
sweeps read the dishes of several customers, which pass 1 packs for them. Very frequent words (found in a
bounded sample, which decides nothing but the dealing) are dealt by word and
context, so that no part is larger for them. The parts exchange a message for
each pair of parts.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .packed import frugal, frugal_pair, pack, pack_sorted, text_buffer, unpack, unpack_sorted
from .words import mix, words

BLOCK_ROWS = 2048
BLOCK_BYTES = 12 << 20
PART_ROWS = 4096
SAMPLE = 2000  # documents that the frequent words are looked up in
FREQUENT = 0.002
BURN, SAMPLES = 2, 3
STRENGTH = 1.0  # b1 and b2
EXACT = 512  # customers of a dish up to which all numbers of tables are weighed
GRID = 65  # numbers of tables that are weighed for more customers
NODES = 48  # of the integral for these
CELLS = 1 << 18
END, START = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)
_C = np.uint64(16)  # contexts go by the upper 48 bits of their hash
_BITS = np.uint64(26)  # distinct words of a block, twice, and a document of it: 64 bits
_DOC = np.uint64(12)
_PARENT = np.uint64(0x510E527FADE682D1)


def _pair(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mix(w ^ mix(u + np.uint64(0x9E3779B97F4A7C15)))


def _token_stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in order, each text's words and its end, and the offsets of the texts' tokens."""
    h, at = words(raw, offsets)
    docs = len(offsets) - 1
    own = at + np.arange(docs + 1)
    stream = np.full(own[-1], END, dtype=np.uint64)
    keep = np.ones(own[-1], dtype=bool)
    keep[own[1:] - 1] = False
    stream[keep] = h
    return stream, own


def _runs_of(a: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. + counts[0], starts[1] .. + counts[1], end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _block_rows(number: int, table: pa.Table, parts: int, frequent: np.ndarray) -> pa.RecordBatch:
    raw, offsets = text_buffer(table.column("text"))
    stream, at = _token_stream(raw, offsets)
    docs = len(at) - 1
    known, rank = np.unique(stream, return_inverse=True)
    rank = rank.astype(np.uint64)
    before = np.empty_like(rank)
    before[1:] = rank[:-1]
    before[at[:-1]] = len(known)
    key = (rank << (_BITS + _DOC)) | (before << _DOC) | np.repeat(np.arange(docs, dtype=np.uint64), np.diff(at))
    del rank, before, stream, raw
    key.sort()
    first = _runs_of(key >> _DOC)
    count = np.diff(np.append(first, len(key)))
    w = known[(key[first] >> (_BITS + _DOC)).astype(np.int64)]
    u = (np.append(known, START) >> _C)[((key[first] >> _DOC) & np.uint64((1 << 26) - 1)).astype(np.int64)]
    doc = (key & np.uint64((1 << 12) - 1)).astype(np.uint16)
    del key
    part = (w >> np.uint64(40)) % np.uint64(parts)
    often = np.isin(w, frequent)
    part[often] = _pair(w[often], u[often]) % np.uint64(parts)
    part = part.astype(np.uint16 if parts < 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    home = number % parts
    held = np.packbits(table.column("held").to_numpy(zero_copy_only=False).astype(bool)).tobytes()
    out: dict[str, list] = {c: [] for c in ("_p", "words", "per_word", "contexts", "per_context", "docs", "held", "ids")}
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        own = order[cuts[p]:cuts[p + 1]]
        if not len(own) and p != home:
            continue
        ws, us = w[own], u[own]
        # Frequent words' contexts come in order of rank, which is the order of their hashes.
        begin = _runs_of(ws)
        step = us.copy()
        step[1:] -= us[:-1]
        step[begin] = us[begin]
        out["_p"].append(p)
        out["words"].append(pack_sorted(ws[begin]))
        out["per_word"].append(pack(np.diff(np.concatenate([begin, [len(ws)]])).astype(np.uint32)))
        out["contexts"].append(pack(step))
        out["per_context"].append(pack(count[own].astype(np.uint32)))
        out["docs"].append(pack(doc[_ranges(first[own], count[own])]))
        out["held"].append(held)
        ids = table.column("doc_id")
        out["ids"].append(pack(np.concatenate([ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy().astype(np.int64)])) if p == home else None)
    n = len(out["_p"])
    return pa.RecordBatch.from_pydict({"_p": pa.array(out["_p"], pa.int64()), "_block": pa.array([number] * n, pa.int64()),
                                       **{c: pa.array(out[c], pa.binary()) for c in ("words", "per_word", "contexts", "per_context", "docs", "held", "ids")}})


def _blocks(parts: int, frequent: np.ndarray, block_rows: int):
    def run(batches):
        from pyspark import TaskContext

        number, waiting, rows, size = TaskContext.get().partitionId() << 24, [], 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[lo:lo + block_rows - rows], dtype=np.int64), BLOCK_BYTES - size, side="right")
                if not room and waiting:
                    yield _block_rows(number, pa.Table.from_batches(waiting), parts, frequent)
                    number, waiting, rows, size = number + 1, [], 0, 0
                    continue
                part = batch.slice(lo, max(1, int(room)))  # a text larger than a block is one by itself
                waiting.append(part)
                rows += part.num_rows
                size += int(sizes[lo:lo + part.num_rows].sum())
                lo += part.num_rows
                if rows >= block_rows:
                    yield _block_rows(number, pa.Table.from_batches(waiting), parts, frequent)
                    number, waiting, rows, size = number + 1, [], 0, 0
        if waiting:
            yield _block_rows(number, pa.Table.from_batches(waiting), parts, frequent)
    return run


class _Exchange:
    """What a part sends to the parts that add up its contexts and frequent words, and what they answer."""

    def messages(self, p: int, per_context: list[np.ndarray], per_word: list[np.ndarray], meta: np.ndarray, state: bytes | None = None, known: bool = False) -> pa.Table:
        """A row for every part: sums of the contexts and frequent words that it adds up (``known``: from pass 1), and this part's totals."""
        out: dict[str, list] = {c: [] for c in ("_to", "contexts", "sums", "shared", "shared_sums", "meta", "state")}
        for to in range(self.parts):
            a, b = self.cuts[to], self.cuts[to + 1]
            own = self.shared[to]
            out["_to"].append(to)
            out["contexts"].append(None if known else pack_sorted(self.contexts[a:b]))
            out["sums"].append(pack(np.concatenate([v[a:b] for v in per_context]).astype(np.uint64)))
            out["shared"].append(None if known else self.words[own].tobytes())
            out["shared_sums"].append(np.concatenate([v[own] for v in per_word]).astype(np.uint64).tobytes())
            out["meta"].append(meta.astype(np.float64).tobytes())
            out["state"].append(state if to == p else None)
        n = self.parts
        return pa.table({"_to": pa.array(out["_to"], pa.int64()), "_p": pa.array([p] * n, pa.int64()),
                         **{c: pa.array(out[c], pa.binary()) for c in ("contexts", "sums", "shared", "shared_sums", "meta", "state")}})

    def answers(self, table: pa.Table, columns: int, word_columns: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, bytes | None]:
        """The sums over all parts, in this part's order, the totals, and what it sent itself."""
        context = [np.zeros(self.cuts[-1]) for _ in range(columns)]
        word = [np.zeros(len(self.words)) for _ in range(word_columns)]
        meta, state = None, None
        for to, sums, shared, total, kept in zip(*[table.column(c).to_pylist() for c in ("_to", "sums", "shared_sums", "meta", "state")]):
            a, b = self.cuts[to], self.cuts[to + 1]
            own = self.shared[to]
            for v, got in zip(context, unpack(sums, np.uint64).reshape(columns, -1)):
                v[a:b] = got
            for v, got in zip(word, np.frombuffer(shared, np.uint64).reshape(word_columns, -1)):
                v[own] = got
            total = np.frombuffer(total, np.float64)
            meta = total.copy() if meta is None else np.concatenate([total[:-1], [meta[-1] + total[-1]]])
            state = kept if kept is not None else state
        return context, word, meta, state


class _Part(_Exchange):
    """A part's pairs of word and context, merged over the blocks."""

    def __init__(self, table: pa.Table, parts: int, frequent: np.ndarray):
        get = lambda c: table.column(c).to_pylist()
        self.parts = parts
        self.blocks = []  # (block, pairs before, pairs, occurrences, docs, held, ids)
        ws, us, trained, before = [], [], [], 0
        order = np.argsort(table.column("_block").to_numpy(), kind="stable")
        rows = list(zip(*[get(c) for c in ("_block", "words", "per_word", "contexts", "per_context", "docs", "held", "ids")]))
        for i in order:
            block, w, per_word, contexts, per_context, docs, held, ids = rows[i]
            per_word = unpack(per_word, np.uint32).astype(np.int64)
            w = np.repeat(unpack_sorted(w), per_word)
            step = unpack(contexts, np.uint64)
            total = np.cumsum(step, dtype=np.uint64)
            begin = np.cumsum(per_word) - per_word
            u = total - np.repeat(total[begin] - step[begin], per_word) if len(step) else step
            per_context = unpack(per_context, np.uint32).astype(np.int64)
            docs = unpack(docs, np.uint16)
            out = np.unpackbits(np.frombuffer(held, np.uint8)).astype(bool)
            learn = ~out[docs]
            sums = np.concatenate([[0], np.cumsum(learn)])
            ends = np.cumsum(per_context)
            trained.append(sums[ends] - sums[ends - per_context])
            self.blocks.append((block, before, len(w), per_context, docs, out, ids))
            before += len(w)
            ws.append(w)
            us.append(u)
        w = np.concatenate(ws) if ws else np.zeros(0, np.uint64)
        u = np.concatenate(us) if us else np.zeros(0, np.uint64)
        _, first, self.pair_of = np.unique(_pair(w, u), return_index=True, return_inverse=True)
        self.c = np.bincount(self.pair_of, weights=np.concatenate(trained) if trained else None, minlength=len(first)).astype(np.int64)
        self.words, self.word_of = np.unique(w[first], return_inverse=True)
        u = u[first]
        del w, ws, us
        # Contexts by the part that adds them up, then by hash.
        self.contexts, self.context_of = np.unique(u, return_inverse=True)
        to = (self.contexts >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(to.astype(np.uint32), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.contexts, self.context_of = self.contexts[order], place[self.context_of]
        self.cuts = np.searchsorted(to[order], np.arange(parts + 1))
        self.often = np.isin(self.words, frequent)
        shared = self.words[self.often]
        self.shared = [np.flatnonzero(self.often)[(shared >> np.uint64(40)) % np.uint64(parts) == p] for p in range(parts)]
        # Dishes of several customers, by context and word.
        many = np.flatnonzero(self.c > 1)
        self.many = many[np.lexsort((self.word_of[many], self.context_of[many]))]

    def dishes(self) -> bytes:
        """What the sweeps need to know, packed: only dishes of several customers are ever seated anew."""
        single = self.c == 1
        held, place = np.unique(self.context_of[self.many], return_inverse=True)
        return pickle.dumps((self.cuts, [pack(x.astype(np.uint64)) for x in (
            self.words, self.often, self.contexts[held], held, place, self.word_of[self.many], self.c[self.many],
            self.by_word(self.c), self.by_word(single), self.by_context(self.c), self.by_context(single))]))

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_of, weights=values, minlength=len(self.words))

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context_of, weights=values, minlength=len(self.contexts))


class _Dishes(_Exchange):
    """A part's dishes of several customers, and the sums over those of one, as ``_Part.dishes`` packed them."""

    def __init__(self, table: pa.Table, parts: int):
        self.cuts, packed = pickle.loads(next(x for x in table.column("state").to_pylist() if x is not None))
        (self.words, often, self.held, held, place, word_of, c, self.c_w, single_w, self.c_u, single_u) = [unpack(x, np.uint64) for x in packed]
        self.parts, self.often = parts, often.astype(bool)
        self.at, self.place, self.word_of, self.c = (x.astype(np.int64) for x in (held, place, word_of, c))
        self.single_w, self.single_u = single_w.astype(float), single_u.astype(float)
        shared = self.words[self.often]
        self.shared = [np.flatnonzero(self.often)[(shared >> np.uint64(40)) % np.uint64(parts) == p] for p in range(parts)]

    def by_word(self, tables: np.ndarray, times: int = 1) -> np.ndarray:
        """``tables`` of these dishes, and one of the others ``times``."""
        return np.bincount(self.word_of, weights=tables, minlength=len(self.words)) + times * self.single_w

    def by_context(self, tables: np.ndarray, times: int = 1) -> np.ndarray:
        out = times * self.single_u
        out[self.at] += np.bincount(self.place, weights=tables, minlength=len(self.at))
        return out


def _add_up(table: pa.Table, first: pa.Table | None = None, sweep: int = 0) -> pa.Table:
    """A part's answer to all parts: every context's and frequent word's sum over the parts.

    ``first``: the messages of pass 1, which name the contexts and words of
    later ones. The sums of a sweep also tell the tables that the frequent
    words get in the unigram restaurant.
    """
    table = table.sort_by("_p")
    named = table if first is None else first.sort_by("_p")
    asked = [unpack_sorted(x) for x in named.column("contexts").to_pylist()]
    sums = [unpack(x, np.uint64) for x in table.column("sums").to_pylist()]
    words_ = [np.frombuffer(x, np.uint64) for x in named.column("shared").to_pylist()]
    word_sums = [np.frombuffer(x, np.uint64) for x in table.column("shared_sums").to_pylist()]

    def total(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The keys, their sums by column, and the places of each part's keys among them."""
        columns = next((len(v) // len(k) for k, v in zip(keys, values) if len(k)), 0)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        added = [np.bincount(place, weights=np.concatenate([v.reshape(columns, -1)[j] for k, v in zip(keys, values) if len(k)]).astype(float)).astype(np.uint64)
                 for j in range(columns)]
        return known, added, np.split(place, cuts)

    def told(added: list[np.ndarray], own: list[np.ndarray]) -> list[np.ndarray]:
        return [np.concatenate([x[o] for x in added]) if added else np.zeros(0, np.uint64) for o in own]

    _, contexts, own_contexts = total(asked, sums)
    shared, customers, own_shared = total(words_, word_sums)
    # The last total is of frequent words, by the part that adds them up: known words (those that were learnt), later their tables in the parent.
    meta = np.sum([np.frombuffer(x, np.float64) for x in table.column("meta").to_pylist()], axis=0)
    more = customers[0] > 0 if len(shared) else np.zeros(0)
    if first is not None and len(shared):
        more = _parent_tables(customers[0], meta[6] / meta[-1], meta[4] / meta[-1], shared, sweep)
        customers = [*customers, more.astype(np.uint64)]
    meta = np.concatenate([meta, [float(more.sum())]])
    to = table.column("_to")[0].as_py()
    n = table.num_rows
    return pa.table({"_p": table.column("_p"), "_to": pa.array([to] * n, pa.int64()), "sums": pa.array([pack(x) for x in told(contexts, own_contexts)], pa.binary()),
                     "shared_sums": pa.array([x.tobytes() for x in told(customers, own_shared)], pa.binary()), "meta": pa.array([meta.tobytes()] * n, pa.binary()),
                     "state": table.column("state").combine_chunks()})


def _add_up_again(sweep: int):
    def run(first: pa.Table, table: pa.Table) -> pa.Table:
        return _add_up(table, first, sweep)
    return run


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the key and the step alone, so that a repeated task draws the same."""
    return (mix(key + np.uint64((step * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def draw_gamma(shape: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
    """Gamma variates of shapes over 1 (Marsaglia and Tsang), by key and sweep."""
    out, left, step = np.zeros(len(shape)), np.arange(len(shape)), 4096 * sweep + 1024
    while len(left):
        a = shape[left] - 1 / 3
        u = [1 - _uniform(key[left], step + j) for j in range(3)]
        x = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
        v = np.maximum(0.0, 1 + x / np.sqrt(9 * a)) ** 3
        ok = (v > 0) & (np.log(u[2]) < 0.5 * x * x + a - a * v + a * np.log(np.maximum(v, 1e-300)))
        out[left[ok]] = (a * v)[ok]
        left, step = left[~ok], step + 3
    return out


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1) of real n > -1."""
    y = n + 9.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3)
    return series - sum(np.log(n + j) for j in range(1, 9))


@lru_cache(maxsize=8)
def _seatings(discount: float) -> np.ndarray:
    """log S(c, t), the weight of all seatings of c customers at t tables, for c and t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        out[c + 1, 1:c + 1] = out[c, 1:c + 1] + np.log(c - discount * t)
        out[c + 1, 1:c + 2] = np.logaddexp(out[c + 1, 1:c + 2], out[c, :c + 1])
    return out


def _stretch(want: np.ndarray, discount: float) -> np.ndarray:
    """log x, for which 1 - x is the saddle point of (1 - (1 - z)^d)^t / z^c at c / t = ``want``."""
    lo, hi = np.full(want.shape, -650.0), np.full(want.shape, -1e-12)
    want = np.log(want)
    for _ in range(52):
        at = (lo + hi) / 2
        over = np.log(discount * np.expm1(at) / np.expm1(discount * at)) + (discount - 1) * at > want
        lo, hi = np.where(over, at, lo), np.where(over, hi, at)
    return (lo + hi) / 2


def log_seatings(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) = log of c! / (t! d^t) [z^c] (1 - (1 - z)^d)^t, by a contour integral.

    The contour is the parabola 1 - z = x (1 + i s)^2 through the saddle point,
    around the cut from 1; no number of tables is too small or large for it.
    """
    x = np.maximum(np.exp(_stretch(np.maximum(c / t, 1 + 1e-9), discount)), 1 / c)
    z, f = 1 - x, 1 - x ** discount
    slope = discount * x ** (discount - 1) / f
    bend = t * (discount * (1 - discount) * x ** (discount - 2) / f - slope ** 2) + (c + 1) / z ** 2
    wide = np.minimum(1.0, 0.5 / (x * np.sqrt(np.maximum(bend, 1e-300))))
    log_x, top, total = np.log(x), t * np.log(f) - (c + 1) * np.log(z), 0.0
    for v in np.arange(NODES) * (7.0 / NODES):
        way = 1 + 1j * wide * np.sinh(v)
        turn = np.log(way)
        rest = t * np.log(1 - np.exp(discount * (log_x + 2 * turn))) - (c + 1) * np.log(1 - x * way ** 2) - top
        total = total + (np.exp(rest) * way).real * np.cosh(v) * (0.5 if v == 0 else 1.0)
    got = np.log(np.maximum(total * 2 * x * wide * (7.0 / NODES) / np.pi, 1e-300)) + top
    return np.where(c > t, got + _log_factorial(c) - _log_factorial(t) - t * np.log(discount), 0.0)


def seat(customers: np.ndarray, rate: np.ndarray, above: np.ndarray, below: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Draw the tables t of each dish of c > 0 customers with chances in proportion to

        S(c, t) rate^t  (above (above + 1) ...) / (below (below + 1) ...), t - 1 factors.

    Up to EXACT customers all t are weighed. For more, up to GRID
    numbers of tables around the most likely are weighed, each for its share of
    the 16 standard deviations around.
    """
    tables = np.ones(len(customers))
    u = _uniform(key, 4096 * sweep)
    weights = _seatings(discount)
    log_rate = np.log(rate)
    order = np.argsort(customers, kind="stable")
    cuts = np.searchsorted(customers[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        for lo in range(cuts[c - 2], cuts[c - 1], max(1, CELLS // c)):
            i = order[lo:min(lo + max(1, CELLS // c), cuts[c - 1])]
            j = np.arange(c - 1)
            w = np.zeros((len(i), c))
            np.cumsum(log_rate[i, None] + np.log((above[i, None] + j) / (below[i, None] + j)), axis=1, out=w[:, 1:])
            w += weights[c, 1:c + 1]
            w -= w.max(axis=1, keepdims=True)
            np.cumsum(np.exp(w, out=w), axis=1, out=w)
            tables[i] = 1 + (w <= u[i, None] * w[:, -1:]).sum(axis=1).clip(max=c - 1)
    for at in range(cuts[-1], len(order), CELLS // GRID):
        i = order[at:at + CELLS // GRID]
        tables[i] = _seat_many(customers[i].astype(float), log_rate[i], above[i], below[i], discount, u[i], _uniform(key[i], 4096 * sweep + 1))
    return tables


def _seat_many(c, log_rate, above, below, discount, u, within):
    def tables(at):
        return c * -np.expm1(discount * at) / (discount * -np.expm1(at)) * np.exp((1 - discount) * at)

    def slope(at):
        t = tables(at)
        return np.log(-np.expm1(discount * at) / discount) - np.log(t + 0.5) + log_rate + np.log((above + t) / (below + t))

    lo, hi = _stretch(c / 0.7, discount), np.full(len(c), -1e-9)
    for _ in range(52):
        at = (lo + hi) / 2
        rises = slope(at) > 0
        lo, hi = np.where(rises, at, lo), np.where(rises, hi, at)
    at, step = (lo + hi) / 2, 1e-3
    best = np.clip(tables(at), 1, c)
    falls = (slope(at * (1 + step)) - slope(at * (1 - step))) / np.maximum(tables(at * (1 - step)) - tables(at * (1 + step)), 1e-9)
    wide = 8 / np.sqrt(np.maximum(falls, 1 / c ** 2)) + 8
    first, last = np.maximum(1, np.floor(best - wide)), np.minimum(c, np.ceil(best + wide))
    share = np.maximum(1, np.ceil((last - first + 1) / GRID))
    t = first[:, None] + share[:, None] * np.arange(GRID)
    mid = np.minimum(t + (share[:, None] - 1) / 2, c[:, None])
    rise = lambda a: _log_factorial(a[:, None] + mid - 2) - _log_factorial(a - 1)[:, None]
    w = log_seatings(np.broadcast_to(c[:, None], mid.shape), mid, discount) + (mid - 1) * log_rate[:, None] + rise(above) - rise(below)
    w = np.where(t > last[:, None], -np.inf, w)
    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    place = (w <= u[:, None] * w[:, -1:]).sum(axis=1).clip(max=GRID - 1)
    return np.minimum(t[np.arange(len(c)), place] + np.floor(within * share), c)


def sample_tables(customers: np.ndarray, restaurant_tables: np.ndarray, base: np.ndarray, discount: float, strength: float, key: np.ndarray) -> np.ndarray:
    """Sum over SAMPLES draws of the tables of each dish in restaurants that stay as they are. A dish of no customers has none."""
    total = np.zeros(len(customers))
    some = np.flatnonzero(customers > 0)
    c, key, ones = customers[some], key[some], np.ones(len(some))
    for sweep in range(SAMPLES):
        rate = discount * draw_gamma(strength / discount + restaurant_tables[some], key, sweep) * base[some]
        total[some] += seat(c, rate, ones, ones, discount, key, sweep)
    return total


def _discount(once: float, twice: float) -> float:
    """From the numbers of dishes with one and with two customers."""
    return float(min(0.95, max(0.1, once / (once + 2 * twice)))) if once + twice > 0 else 0.5


def _pass1(parts: int, frequent: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        part = _Part(table, parts, frequent)
        seen = part.c > 0
        c_w, t_w = part.by_word(part.c), part.by_word(seen)
        own = ~part.often
        # Tokens, known words, pairs, pairs seen once and twice, words of one and of two contexts.
        meta = np.array([part.c.sum(), (c_w[own] > 0).sum(), seen.sum(), (part.c == 1).sum(), (part.c == 2).sum(), (t_w[own] == 1).sum(), (t_w[own] == 2).sum()])
        return part.messages(table.column("_p")[0].as_py(), [part.by_context(part.c), part.by_context(seen)], [c_w, t_w], meta, part.dishes())
    return run


def _parent(t_w: np.ndarray, m_w: np.ndarray, m: float, t: float, known: float, discount: float) -> np.ndarray:
    """p1 of words with t_w customers at m_w tables of the unigram restaurant."""
    return (np.maximum(0.0, t_w - discount * m_w) + (STRENGTH + discount * m) / (known + 1)) / (STRENGTH + t)


def _parent_rate(m: float, known: float, discount: float, sweep: int) -> float:
    return float(discount * draw_gamma(np.array([STRENGTH / discount + m]), np.array([_PARENT]), sweep)[0] / (known + 1))


def _parent_tables(t_w: np.ndarray, rate: float, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of the unigram restaurant, drawn for words of t_w customers."""
    m_w, some = np.zeros(len(t_w)), np.flatnonzero(t_w > 0)
    ones = np.ones(len(some))
    m_w[some] = seat(t_w[some].astype(np.int64), ones * rate, ones, ones, discount, key[some] ^ _PARENT, sweep)
    return m_w


class _Seating:
    """The seating as a sweep finds it: one table a dish, or what the sweep before left and its sums."""

    def __init__(self, part: _Dishes | _Part, answers: pa.Table, sweep: int):
        if not sweep:
            (_, self.t_u), (_, self.t_w), meta, _ = part.answers(answers, 2, 2)
            self.tokens, own_known, self.t, once, twice, w_once, w_twice, shared_known = meta
            self.known = self.m = own_known + shared_known
            self.d2, self.d1 = _discount(once, twice), _discount(w_once, w_twice)
            self.tables, self.total = np.ones(len(part.c)), np.zeros(len(part.c))
            self.t_w = np.where(part.often, self.t_w, part.by_word(self.tables))
            self.m_w, self.m_total, self.m_sum = np.minimum(1.0, self.t_w), np.zeros(len(part.words)), 0.0
        else:
            contexts, (self.shared_t, self.shared_total, self.shared_c, shared_m), meta, state = part.answers(answers, 1 if sweep < BURN + SAMPLES else 2, 4)
            self.t_u, self.c_u = contexts[0], contexts[-1]
            self.t, own_m = meta[:2]
            self.tokens, self.known, self.d1, self.d2, _, self.m_sum = meta[2:8] / meta[8]
            self.m = own_m + meta[9]
            self.tables, self.total, m_w, m_total = [unpack(x, np.uint64).astype(float) for x in pickle.loads(state)]
            self.m_w = np.where(part.often, shared_m, m_w)
            kept = sweep > BURN  # the sweep before was one of the samples
            self.m_total, self.m_sum = m_total + kept * self.m_w, self.m_sum + kept * self.m


def _sweep(parts: int, sweep: int):
    """Draw the tables of every dish given the others as the sweep before left them, then those of the unigram restaurant."""
    def run(first: pa.Table, answers: pa.Table) -> pa.Table:
        part = _Dishes(first, parts)
        s = _Seating(part, answers, sweep)
        own, w = ~part.often, part.word_of
        t_w = np.where(part.often, s.shared_t, part.by_word(s.tables)) if sweep else s.t_w
        # Given this variate of its restaurant, a dish's tables do not depend on those of the other dishes.
        rate = s.d2 * draw_gamma(STRENGTH / s.d2 + s.t_u[part.at], part.held, sweep)
        # The parent's customers without the dish, but for its first table, which it has anyway.
        others = t_w[w] - s.tables + 1
        above = others - s.d1 * np.minimum(others, s.m_w[w]) + (STRENGTH + s.d1 * s.m) / (s.known + 1)
        below = STRENGTH + s.t - s.tables + 1
        s.tables = seat(part.c, rate[part.place], above, below, s.d2, _pair(part.words[w], part.held[part.place]), sweep)
        if sweep >= BURN:
            s.total += s.tables
        mine, total = part.by_word(s.tables), part.by_word(s.total, SAMPLES)
        parent = _parent_rate(s.m, s.known, s.d1, sweep)
        m_w = np.zeros(len(part.words))
        m_w[own] = _parent_tables(mine[own], parent, s.d1, part.words[own], sweep)
        last = sweep == BURN + SAMPLES - 1  # hands on the sums of the samples
        # Tables of all contexts, tables of the parent, and what every part knows alike.
        t = s.total.sum() + SAMPLES * part.single_u.sum() if last else s.tables.sum() + part.single_u.sum()
        meta = np.array([t, m_w.sum(), s.tokens, s.known, s.d1, s.d2, parent, s.m_sum, 1.0])
        state = pickle.dumps([pack(x.astype(np.uint64)) for x in (s.tables, s.total, m_w, s.m_total)])
        contexts = [part.by_context(s.total, SAMPLES), part.c_u] if last else [part.by_context(s.tables)]
        return part.messages(first.column("_p")[0].as_py(), contexts, [mine, total, part.c_w], meta, state, known=True)
    return run


def _alone(draw):
    """The first sweep, which finds the dishes and the answers in one table."""
    def run(table: pa.Table) -> pa.Table:
        return draw(table, table)
    return run


def _pass3(parts: int, frequent: np.ndarray):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        part = _Part(table, parts, frequent)
        s = _Seating(part, answers, BURN + SAMPLES)
        tokens, known, d1, d2, c_u = s.tokens, s.known, s.d1, s.d2, s.c_u
        tables = np.where(part.c > 0, float(SAMPLES), 0.0)
        tables[part.many] = s.total
        c_w = np.where(part.often, s.shared_c, part.by_word(part.c))
        t_w = np.where(part.often, s.shared_total, part.by_word(tables))
        tables, t_u, t_w, m_w, m, t = [x / SAMPLES for x in (tables, s.t_u, t_w, s.m_total, s.m_sum, s.t)]
        p1 = _parent(t_w, m_w, m, t, known, d1)[part.word_of]
        u = part.context_of
        log_p = np.log10((np.maximum(0.0, part.c - d2 * tables) + (STRENGTH + d2 * t_u[u]) * p1) / (STRENGTH + c_u[u]))
        log_base = np.log10((c_w + 0.1) / (tokens + 0.1 * (known + 1)))
        out: dict[str, list] = {c: [] for c in ("_block", "docs", "score", "base", "tokens", "known", "held", "ids")}
        for block, before, pairs, per_context, docs, held, ids in part.blocks:
            of = np.repeat(part.pair_of[before:before + pairs], per_context)
            w = part.word_of[of]
            order = np.unique(docs)
            place = np.searchsorted(order, docs)
            added = lambda v: np.bincount(place, weights=v, minlength=len(order))
            out["_block"].append(block)
            out["docs"].append(pack(order))
            out["score"].append(added(log_p[of]).tobytes())
            out["base"].append(added(log_base[w]).tobytes())
            out["tokens"].append(pack(added(None).astype(np.uint32)))
            out["known"].append(pack(added(c_w[w] > 0).astype(np.uint32)))
            out["held"].append(np.packbits(held).tobytes() if ids is not None else None)
            out["ids"].append(ids)
        n = len(out["_block"])
        return pa.table({"_block": pa.array(out["_block"], pa.int64()), "_part": pa.array([table.column("_p")[0].as_py()] * n, pa.int64()), "train_tokens": pa.array([int(tokens)] * n, pa.int64()),
                         **{c: pa.array(out[c], pa.binary()) for c in ("docs", "score", "base", "tokens", "known", "held", "ids")}})
    return run


def _documents(table: pa.Table) -> pa.Table:
    """A block's documents, their sums over the parts."""
    get = lambda c: table.column(c).to_pylist()
    ids = next(unpack(x, np.int64) for x in get("ids") if x is not None)
    held = next(x for x in get("held") if x is not None)
    n = len(ids) // 2
    score, base, tokens, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for _, d, s, b, t, k in sorted(zip(get("_part"), *[get(c) for c in ("docs", "score", "base", "tokens", "known")])):
        d = unpack(d, np.uint16)
        score[d] += np.frombuffer(s, np.float64)
        base[d] += np.frombuffer(b, np.float64)
        tokens[d] += unpack(t, np.uint32)
        known[d] += unpack(k, np.uint32)
    return pa.table({"doc_id": pa.array(ids[:n], pa.int64(), mask=ids[n:].astype(bool)),
                     "held_out": pa.array(np.unpackbits(np.frombuffer(held, np.uint8), count=n).astype(bool)),
                     "n_tokens": pa.array(tokens), "n_known": pa.array(known), "train_tokens": pa.array([get("train_tokens")[0]] * n, pa.int64()),
                     "base_score": pa.array(base), "score": pa.array(score)})


def _word_counts(batches):
    for batch in batches:
        raw, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
        known, count = np.unique(_token_stream(raw, offsets)[0], return_counts=True)
        yield pa.RecordBatch.from_pydict({"word": pa.array(known.view(np.int64)), "n": pa.array(count.astype(np.int64))})


def frequent_words(base: DataFrame, sample: int = SAMPLE, share: float = FREQUENT) -> np.ndarray:
    """Hashes of the words that make up ``share`` of a bounded sample's tokens each: 1 / share at most, in order."""
    ids = base.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = base.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    counts = some.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    got = counts.filter(F.col("n") >= share * total).collect() if total else []
    return np.sort(np.array([r["word"] for r in got], dtype=np.int64).view(np.uint64))


def language_scores(docs: DataFrame, learn_modulo: int = 10, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The log10 probability of every whole text by the model learnt from the training documents.

    Training documents are those whose crc32 of the id modulo
    ``learn_modulo`` is not 0 (a null id counts as the empty text). Tokens
    are the words, A-Z lower-cased, and one end. Returns doc_id, held_out,
    n_tokens, n_known (tokens that training documents have), train_tokens,
    base_score (unigrams with 0.1 added to each count) and score, one row per
    input row. A null or empty text is its end alone. Rows that repeat an id
    are texts of their own. Other columns are ignored; an empty table gives
    no rows. Words and contexts are hashes of 64 and 48 bits.
    """
    block_rows = min(block_rows, 1 << 12)  # documents of a block are numbered in 12 bits
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, base.count() // part_rows)
    frequent = frequent_words(base)
    held = base.withColumn("held", crc_mod(F.col("doc_id"), learn_modulo) == 0)
    asked = held.mapInArrow(_blocks(parts, frequent, block_rows),
                            "_p long, _block long, words binary, per_word binary, contexts binary, per_context binary, docs binary, held binary, ids binary")
    message = "_to long, _p long, contexts binary, sums binary, shared binary, shared_sums binary, meta binary, state binary"
    answer = "_p long, _to long, sums binary, shared_sums binary, meta binary, state binary"
    own = asked.groupBy("_p")
    sent = own.applyInArrow(frugal(_pass1(parts, frequent)), message)
    answers = first = sent.groupBy("_to").applyInArrow(lambda table: _add_up(table), answer)
    for sweep in range(BURN + SAMPLES):
        draw = _sweep(parts, sweep)
        drawn = (first.groupBy("_p").cogroup(answers.groupBy("_p")).applyInArrow(frugal_pair(draw), message) if sweep
                 else first.groupBy("_p").applyInArrow(frugal(_alone(draw)), message))
        answers = sent.groupBy("_to").cogroup(drawn.groupBy("_to")).applyInArrow(_add_up_again(sweep), answer)
    third = own.cogroup(answers.groupBy("_p")).applyInArrow(
        frugal_pair(_pass3(parts, frequent)), "_block long, _part long, train_tokens long, docs binary, score binary, base binary, tokens binary, known binary, held binary, ids binary")
    return third.groupBy("_block").applyInArrow(
        _documents, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
