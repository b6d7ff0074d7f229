"""Suffix-array dedup by prefix-free parsing: bytes covered by a ``SPAN``-byte string that also starts earlier go.

1. Pre-selection.  Of each 100-byte string the 50-byte string with the smallest rolling hash is its anchor; equal strings
   have equal anchors.  Chunks of documents ask which of their anchors recur, and of which shard they are (by the smallest
   hash of a text that holds them, so that copies of one text share a shard).  The rest of the text is not sorted.
2. In each chunk the stretches with recurring anchors are parsed: rolling-hash triggers cut them into phrases that overlap
   by a trigger.  The suffixes of the dictionary (distinct phrases) are ranked by prefix doubling, the parse (phrase ranks)
   likewise; a position's rank is that of its phrase suffix, then of the parse behind it, which is the corpus order
   of all positions.  Neighbours with 100 bytes in common are repeats; all but the first go.
3. What a chunk keeps as first goes to its shard, where step 2 runs over the stretches of all chunks.  So copies within a
   chunk are settled before the shuffle, and a shard sees a much copied text once per chunk.

Strings are compared by content in step 2; a hash only decides in step 1, where a false match costs time alone.  Null text
is empty.  Rows with one id are taken by chunk, then by text; a null id comes before all others.  Texts shorter
than a span lose nothing.  Ids are integers.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import stored

SPAN = 100
TRIGGER = 12  # bytes of a trigger
PERIOD = 32  # one in so many places is a trigger; a power of 2
CHUNK_BYTES = 2_000_000
BLOCK_BITS = 15  # places whose hashes are made at a time are numbered by so many bits, so that they stay in a core's cache
KEPT = "id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
STRETCH = "shard int, chunk int, id bigint, at bigint, body binary"


@functools.lru_cache(4)
def _powers(n: int, size: int):
    """Powers of the hash's base from n - 1 on, and those of its inverse from 0 on."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    up, down = np.full(size, base, np.uint64), np.full(size + n, pow(base, -1, 2**64), np.uint64)
    up[0], down[0] = pow(base, n - 1, 2**64), 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _block_hashes(data, a: int, b: int, n: int, size: int):
    """Hash of the n bytes from each of the places a to b on, at most ``size``: a difference of running sums."""
    import numpy as np

    up, down = _powers(n, size)
    part = data[a : b + n - 1].astype(np.uint64)
    part += np.uint64(0x1F3D)
    part *= down[: len(part)]
    np.cumsum(part, out=part)
    whole = part[n - 1 :].copy()
    whole[1:] -= part[: b - a - 1]
    whole *= up[: b - a]
    return C.mixed(whole)


def gram_hashes(data, n: int):
    """Hash of the n bytes from each byte on."""
    import numpy as np

    size = 1 << BLOCK_BITS
    out = np.empty(max(0, len(data) - n + 1), np.uint64)
    for a in range(0, len(out), size):
        b = min(len(out), a + size)
        out[a:b] = _block_hashes(data, a, b, n, size)
    return out


def _sorted(keys, bits: int):
    """Order of integer keys below 2 ** bits, equal ones by place; keys and places are sorted as one number if they fit."""
    import numpy as np

    wide = max(1, int(len(keys)).bit_length())
    if bits + wide > 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = keys.astype(np.int64) << wide
    both |= np.arange(len(keys))
    both.sort()
    order = both & ((1 << wide) - 1)
    both >>= wide
    return order, both


def _starts(*columns):
    """Where values change in any of the columns; each gets its first place too."""
    import numpy as np

    new = np.ones(len(columns[0]), bool)
    if len(new):
        np.not_equal(columns[0][1:], columns[0][:-1], out=new[1:])
        for x in columns[1:]:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _ranked(keys, bits: int):
    """Dense ranks from 1 of integer keys below 2 ** bits."""
    import numpy as np

    order, value = _sorted(keys, bits)
    start = _starts(value)
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.repeat(np.arange(1, len(start) + 1), np.diff(start, append=len(keys)))
    return ranks


def _paired(high, low):
    """Ranks of pairs of numbers, neither above the count of pairs."""
    bits = (len(high) + 1).bit_length()
    return _ranked((high << bits) | low, 2 * bits)


def _shifted(ranks, ends, by: int):
    """Rank ``by`` places on, 0 beyond the end of the same string."""
    import numpy as np

    at = np.arange(len(ranks)) + by
    return np.where(at < ends, ranks[np.minimum(at, len(ranks) - 1)], 0)


def _suffix_ranks(data, ends, span: int):
    """Rank of each suffix of the strings in ``data`` by its first ``span`` bytes; a shorter suffix comes first.

    Prefix doubling.  A rank is one more than the number of smaller suffixes, so it stays when others are told apart:
    later rounds only take suffixes that share their rank and go on beyond the bytes compared so far."""
    import numpy as np

    n = len(data)
    left = ends - np.arange(n, dtype=ends.dtype)
    padded = np.zeros(n + 4, np.int64)
    np.add(data, 1, out=padded[:n], dtype=np.int64)
    key = padded[:n].copy()
    for k in range(1, 5):
        key *= 257
        key += padded[k : k + n] * (left > k)
    order, value = _sorted(key, 41)
    start, known, bits = _starts(value), 5, (n + 1).bit_length()
    sizes = np.diff(start, append=n)
    ranks = np.zeros(n + 1, np.int64)  # 0 beyond the last
    ranks[order] = np.repeat(start + 1, sizes)
    live = order[np.repeat(sizes > 1, sizes)]  # by rank; all of one rank or none
    while known < span:
        live = live[left[live] >= known]  # suffixes of one rank that end before are equal
        if not len(live):
            break
        step = min(known, span - known)
        high, low = ranks[live], ranks[live + step]
        low[left[live] == step] = 0
        shared = _starts(high)
        group = np.repeat(np.arange(len(shared)), np.diff(shared, append=len(live)))
        order, value = _sorted((group << bits) | low, len(shared).bit_length() + bits)
        start = _starts(value)
        sizes = np.diff(start, append=len(live))
        live = live[order]
        ranks[live] = np.repeat(high[start] + start - shared[group[start]], sizes)
        live = live[np.repeat(sizes > 1, sizes)]
        known += step
    return ranks[:n]


def repeats(data, ends, span: int = SPAN):
    """For the bytes of several texts, one after the other (``ends``: of the text at each byte): True where the ``span``
    bytes from there are inside the text and also start earlier in the same array."""
    import numpy as np

    n = len(data)
    inside = np.arange(n, dtype=ends.dtype) + span <= ends
    if not inside.any():
        return np.zeros(n, bool)
    # parse
    trigger, size = np.zeros(n, bool), 1 << BLOCK_BITS
    for a in range(0, n - TRIGGER + 1, size):
        b = min(n - TRIGGER + 1, a + size)
        trigger[a:b] = (_block_hashes(data, a, b, TRIGGER, size) & np.uint64(PERIOD - 1)) == 0
    trigger &= np.arange(n, dtype=ends.dtype) + TRIGGER <= ends
    trigger[0] = True
    trigger[1:] |= ends[1:] != ends[:-1]
    begin = np.flatnonzero(trigger)
    after = np.append(begin[1:], n)
    last = after == ends[begin]  # of its text
    stop = np.where(last, after, after + TRIGGER)
    # dictionary: distinct phrases
    spelled = data.tobytes()
    number: dict[bytes, int] = {}
    phrase = np.array([number.setdefault(spelled[i:j], len(number)) for i, j in zip(begin.tolist(), stop.tolist())])
    sizes = np.array([len(x) for x in number], np.int64)
    book = np.frombuffer(b"".join(number), np.uint8)
    first = np.cumsum(sizes) - sizes
    suffix = _suffix_ranks(book, np.repeat((first + sizes).astype(_kind(len(book))), sizes), span)
    # parse suffixes, ranked over as many phrases as can lie in a span
    tail = np.searchsorted(begin, ends[begin])  # the first phrase of the next text
    ranks, known = _ranked(suffix[first[phrase]], len(book).bit_length()), 1  # by their first bytes, which is as far as anyone looks
    while known < span + TRIGGER and ranks.max() < len(ranks):
        ranks = _paired(ranks, _shifted(ranks, tail, known))
        known *= 2
    order, _ = _sorted(ranks, len(ranks).bit_length())
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # bytes that neighbours in parse order have in common, up to a span and a trigger
    common = np.zeros(len(order), np.int64)
    a, b = begin[order[:-1]], begin[order[1:]]
    most = np.minimum(np.minimum(ends[a] - a, ends[b] - b), span + TRIGGER)
    for lo in range(0, len(a), 100_000):
        x, y, m = a[lo : lo + 100_000], b[lo : lo + 100_000], most[lo : lo + 100_000]
        live, size = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k in range(span + TRIGGER):
            live = live[(m[live] > k)]
            live = live[data[x[live] + k] == data[y[live] + k]]
            if not len(live):
                break
            size[live] += 1
        common[lo + 1 : lo + 1 + len(x)] = size
    low = [common]  # least of 2 ** j neighbours, for any stretch of the order
    while 2 ** len(low) <= len(common):
        h = 2 ** (len(low) - 1)
        low.append(np.minimum(low[-1][:-h], low[-1][h:]))
    # corpus order of the positions at which a span starts
    at = np.flatnonzero(inside)
    count = np.add.reduceat(inside, begin, dtype=np.int64)  # of them in each phrase
    left = np.repeat(stop, count) - at  # bytes of the phrase suffix
    rank = suffix[np.repeat(first[phrase] - begin, count) + at]
    behind = np.repeat(np.append(place[1:], 0), count)
    behind[left >= span] = 0
    wide = len(place).bit_length()
    order, value = _sorted((rank << wide) | behind, len(book).bit_length() + wide)
    at, left = at[order], left[order]
    rank, behind = value >> wide, value & ((1 << wide) - 1)
    same = rank[1:] == rank[:-1]
    apart = np.flatnonzero(same & (behind[1:] > behind[:-1]))  # also no whole span in the phrase suffix
    i, j, need = behind[apart], behind[apart + 1], span - left[apart + 1] + TRIGGER
    least = common[np.minimum(i + 1, len(common) - 1)]
    far = np.flatnonzero(j - i > 1)
    level = np.frexp((j - i)[far].astype(np.float64))[1] - 1
    for v in range(1, level.max(initial=0) + 1):
        w = far[level == v]
        least[w] = np.minimum(low[v][i[w] + 1], low[v][j[w] - 2**v + 1])
    same[apart[least < need]] = False
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    earliest = np.minimum.reduceat(at, start)
    out = np.zeros(n, bool)
    out[at] = True
    out[earliest] = False
    return out


def _runs(at, *also):
    """Starts and ends (in ``at``) of stretches of consecutive numbers with the same values in ``also``."""
    import numpy as np

    new = np.diff(at, prepend=-2) != 1
    for x in also:
        new[1:] |= x[1:] != x[:-1]
    edges = np.flatnonzero(np.append(new, True)) if len(at) else np.zeros(1, np.int64)
    return edges[:-1], edges[1:]


def _kind(size: int):
    """Type of places among so many bytes, and of their sums with a span."""
    import numpy as np

    return np.int32 if size < 2**30 else np.int64


def _texts(table):
    """Ids and bytes of all texts, at each byte the end of its text, and the sizes."""
    import numpy as np

    ids, body = C.in_order(table)
    sizes = np.array([len(t) for t in body], np.int64)
    data = np.frombuffer(b"".join(body), np.uint8)
    return ids, data, np.repeat(np.cumsum(sizes).astype(_kind(len(data))), sizes), sizes


def _anchored(data, ends, span: int):
    """Starts of spans; the first start of each run of spans with one anchor, the anchor's place and its hash.

    The anchor is the least hash of a window, found by doubling: each pass takes the least of two windows of half the size.
    The lowest bits of a hash give way to its place in a block of windows, so the least also tells where it is.  Of equal
    strings in one window the first is the anchor: so its distance from the start depends on the span's bytes alone, and
    two starts of one span never share an anchor's place, even if they overlap."""
    import numpy as np

    half = span // 2
    wide = span - half + 1
    bits = max(BLOCK_BITS, wide.bit_length() + 1)
    low, size = np.uint64((1 << bits) - 1), 1 << bits
    inside = np.arange(len(data), dtype=ends.dtype) + span <= ends
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts, starts, starts, np.empty(0, np.uint64)
    within, step, found = np.arange(size, dtype=np.uint64), size - wide + 1, []
    for a in range(0, int(starts[-1]) + 1, step):
        here = inside[a : min(a + step, int(starts[-1]) + 1)]
        if not here.any():
            continue
        least = _block_hashes(data, a, a + len(here) + wide - 1, half, size)
        least &= ~low
        least |= within[: len(least)]
        have = 1
        while 2 * have <= wide:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < wide:
            least = np.minimum(least[: have - wide], least[wide - have :])
        new = here.copy()  # a start whose anchor is not that of the place before, or after a place where none starts
        new[1:] &= (least[1:] != least[:-1]) | ~here[:-1]
        new = np.flatnonzero(new)
        found.append((new + a, a + (least[new] & low).astype(np.int64), least[new] & ~low))
    at, place, keys = (np.concatenate(x) for x in zip(*found))
    new = _starts(place)  # runs go on from block to block
    return starts, np.searchsorted(starts, at[new]), place[new], keys[new]


def _joined(stretches):
    """Texts one after the other: bytes, and at each byte the end of its text."""
    import numpy as np

    sizes, data = np.array([len(s) for s in stretches], np.int64), np.frombuffer(b"".join(stretches), np.uint8)
    return data, np.repeat(np.cumsum(sizes).astype(_kind(len(data))), sizes), np.cumsum(sizes) - sizes


def remove_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", *, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: ``id, kept`` (bytes), ``n_bytes, n_removed, n_spans``."""
    corpus = C.Chunks(docs, id, text, chunk_bytes=CHUNK_BYTES)
    bits, shards = corpus.bits(0.04), 1 + corpus.size // (2 * CHUNK_BYTES)

    def state(table, _):
        import numpy as np

        _, data, ends, sizes = _texts(table)
        _, _, place, keys = _anchored(data, ends, span)
        cuts = np.cumsum(sizes)
        spelled = memoryview(data)
        digests = [hashlib.blake2b(spelled[b - n : b], digest_size=8).digest() for b, n in zip(cuts.tolist(), sizes.tolist())]
        by_doc = (np.frombuffer(b"".join(digests), np.uint64) >> np.uint64(33)).astype(np.uint32)  # 31 bits
        order = np.argsort(keys)
        keys, by_doc = keys[order], by_doc[np.searchsorted(cuts, place[order], side="right")]
        new = _starts(keys)
        several = np.diff(new, append=len(keys)) > 1
        least = np.minimum.reduceat(by_doc, new) if len(new) else by_doc
        extra = least | (several.astype(np.uint32) << np.uint32(31))
        return C.as_table(C.asked(table.column("chunk")[0].as_py(), keys[new], bits, extra, short=True), C.MESSAGE)

    def shard_of(keys, extra, order, starts):
        import numpy as np

        sizes, low = np.diff(starts, append=len(order)), np.minimum.reduceat(extra[order] & np.uint32(2**31 - 1), starts)
        several = (sizes > 1) | (np.maximum.reduceat(extra[order], starts) >= 2**31)
        return np.repeat(np.where(several, 1 + C.mixed(low.astype(np.uint64)) % np.uint64(shards), 0).astype(np.uint32), sizes)

    def sort_chunk(table, answers):
        import numpy as np

        ids, data, ends, sizes = _texts(table)
        starts, head, _, keys = _anchored(data, ends, span)
        if not len(keys):
            return C.as_table([], STRETCH)
        order = np.argsort(keys)
        new = _starts(keys[order])
        shard = np.empty(len(keys), np.uint32)
        shard[order] = np.repeat(C.said(answers, kind="<u4"), np.diff(new, append=len(keys)))
        count = np.diff(head, append=len(starts))
        starts, shard = starts[np.repeat(shard > 0, count)], np.repeat(shard[shard > 0], count[shard > 0])
        if not len(starts):
            return C.as_table([], STRETCH)
        chunk, spelled = table.column("chunk")[0].as_py(), data.tobytes()
        i, j = _runs(starts)
        body, stops, begin = _joined([spelled[a : b + span] for a, b in zip(starts[i].tolist(), starts[j - 1].tolist())])
        again = repeats(body, stops, span)[np.repeat(begin - starts[i], j - i) + starts]
        gone = starts[again]
        i, j = _runs(gone)
        rows = [(None, chunk, None, None, np.stack([gone[i], j - i], axis=1).tobytes())]
        starts, shard = starts[~again], shard[~again]
        i, j = _runs(starts, shard)
        owner = np.searchsorted(np.cumsum(sizes), starts[i], side="right")
        for a, b, s, o in zip(starts[i].tolist(), starts[j - 1].tolist(), shard[i].tolist(), owner.tolist()):
            rows.append((s, chunk, ids[o], a, spelled[a : b + span]))
        return C.as_table(rows, STRETCH)

    def sort_shard(table):
        import numpy as np

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "chunk", "at", "body"))))
        body, stops, begin = _joined([r[3] for r in rows])
        again = np.flatnonzero(repeats(body, stops, span))
        i, j = _runs(again)
        row = np.searchsorted(begin, again[i], side="right") - 1
        out: dict[int, list] = {}
        for r, a, n in zip(row.tolist(), again[i].tolist(), (j - i).tolist()):
            out.setdefault(rows[r][1], []).append((rows[r][2] + a - int(begin[r]), n))
        return C.as_table([(c, 0, np.array(v, np.int64).tobytes()) for c, v in out.items()], C.ANSWER)

    def keep(table, answers):
        import numpy as np

        ids, body = C.in_order(table)
        sizes = np.array([len(t) for t in body], np.int64)
        cuts = np.cumsum(sizes)
        runs = np.frombuffer(b"".join(answers.column("keys").to_pylist()), np.int64).reshape(-1, 2)
        runs = runs[np.argsort(runs[:, 0])]
        begin, stop = runs[:, 0], np.maximum.accumulate(runs[:, 0] + runs[:, 1] - 1 + span)  # of what is removed
        owner = np.searchsorted(cuts, begin, side="right")
        new = np.flatnonzero(np.concatenate([[True], (begin[1:] > stop[:-1]) | (owner[1:] != owner[:-1])])[: len(begin)])
        begin, stop, owner = begin[new], np.append(stop[new[1:] - 1], stop[-1:]), owner[new]
        first = np.searchsorted(owner, np.arange(len(ids) + 1)).tolist()
        base = (cuts - sizes)[owner]
        begin, stop = (begin - base).tolist(), (stop - base).tolist()
        rows = []
        for k, (i, t) in enumerate(zip(ids, body)):
            a, b = first[k], first[k + 1]
            kept = b"".join([t[x:y] for x, y in zip([0] + stop[a:b], begin[a:b] + [len(t)])]) if a < b else t
            rows.append((None if i == C.NO_ID else i, kept, len(t), len(t) - len(kept), b - a))
        return C.as_table(rows, KEPT)

    shard = C.answered(corpus.map(state, C.MESSAGE), shard_of, short=True, extra="<u4", kind="<u4")
    stretches = stored(corpus.map_with(shard, sort_chunk, STRETCH), "stretches")
    across = stretches.where("shard is not null").groupBy("shard").applyInArrow(sort_shard, C.ANSWER)
    within = stretches.where("shard is null").selectExpr("chunk", "-1 AS bucket", "body AS keys")
    return corpus.map_with(across.union(within), keep, KEPT).withColumnRenamed("id", id)
