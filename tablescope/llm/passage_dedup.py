"""Substring dedup by repeated-phrase automata: words covered by a passage that also starts earlier go.

A window is ``WINDOW`` consecutive words.  A word goes if a window over it has a word sequence that also starts earlier
(smaller id, or same document and earlier place), judged on the input.

1. Confirm recurring phrases.  Of each window, the half-length phrase with the smallest hash is its anchor; equal windows
   have equal anchors, so only windows whose anchor recurs in the corpus can recur.
2. Compile automata.  The confirmed phrases that a chunk of documents holds are compiled with pyahocorasick, in shards of
   ``SHARD`` phrases, over words coded as characters; all the chunk's documents are streamed through each shard, which
   locates every occurrence.  A phrase that no other place holds is in no automaton.
3. Windows over an occurrence are hashed to 64 bits, stated once per chunk with the smallest id that holds them, and
   answered with "earlier elsewhere"; a chunk settles repeats among its own documents by their order.

Null and empty texts have no words.  Rows with one id are taken by chunk, then by text; a null id comes before all others.  Ids are integers.  Kept words are joined by one space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import stored

WINDOW = 20
SHARD = 50_000


def _anchors(words: C.Coded, window: int):
    """Starts of windows; of each run of windows with one anchor, the anchor's key and place.

    The anchor is the first least hash of a window, found by doubling: each pass takes the lesser of two neighbours."""
    import numpy as np

    half = window // 2
    starts, least = words.starts(window), words.grams(half)
    if not len(starts):
        return starts, least[:0], starts
    wide, have, at = window - half + 1, 1, np.arange(len(least))
    while have < wide:
        step = min(have, wide - have)
        right = least[step:] < least[:-step]
        least, at, have = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step]), have + step
    place = at[starts]
    head = np.flatnonzero(np.diff(place, prepend=-1))
    return starts, least[starts[head]], place[head]


def _occurrences(words: C.Coded, places, length: int):
    """Starts of all occurrences of the phrases at ``places``, by sharded automata."""
    import ahocorasick
    import numpy as np

    found = np.zeros(len(words.codes) + 1, np.int64)
    for at in range(0, len(places), SHARD):
        phrases = words.codes[places[at : at + SHARD, None] + np.arange(length)]
        letters = np.unique(phrases)
        # a word is three characters, each from a set of its own: nodes of the automaton keep their children in a list
        base = max(2, int(np.ceil(len(letters) ** (1 / 3))))
        spelling = np.ones((len(words.hashes), 3), "<u4")
        rank = np.arange(len(letters))
        spelling[letters] = np.stack([2 + rank // base**2, 2 + base + rank // base % base, 2 + 2 * base + rank % base], axis=1)
        as_text = lambda codes: spelling[codes].tobytes().decode("utf-32-le")
        spelled = as_text(phrases.ravel())
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for i in range(0, len(spelled), 3 * length):
            automaton.add_word(spelled[i : i + 3 * length])
        automaton.make_automaton()
        ends = np.fromiter((end for end, _ in automaton.iter(as_text(words.codes))), np.int64) // 3
        found[ends - length + 1] = 1
    starts = np.flatnonzero(found)
    return starts[words.ends[words.doc[starts]] - starts >= length]


def remove_repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", *, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``id``, the kept ``text``, ``n_words`` (before) and ``n_removed``."""
    half = window // 2
    corpus = C.Chunks(docs, id, text)
    bits = corpus.bits(0.03)

    def state_anchors(table, _):
        import numpy as np

        words = C.Coded(C.in_order(table)[1])
        _, keys, _ = _anchors(words, window)
        keys, counts = np.unique(keys, return_counts=True)
        return C.as_table(C.asked(table.column("chunk")[0].as_py(), keys, bits, np.minimum(counts, 255).astype(np.uint8), short=True), C.MESSAGE)

    def state_windows(table, answers):
        import numpy as np

        ids, body = C.in_order(table)
        words, chunk = C.Coded(body), table.column("chunk")[0].as_py() if len(table) else 0
        starts, keys, place = _anchors(words, window)
        known, first = np.unique(keys, return_index=True)
        confirmed = C.said(answers)
        if not len(known) or not confirmed.any():
            return C.as_table([], C.MESSAGE)
        at = _occurrences(words, place[first[confirmed > 0]], half)
        covered = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words.codes)))])
        held = starts[covered[starts + window - half + 1] > covered[starts]]
        keys, first = np.unique(words.grams(window)[held], return_index=True)
        mask = np.zeros(len(words.codes), np.uint8)
        mask[held] = 1
        low = np.array(ids, np.int64)[words.doc[held[first]]]
        return C.as_table([(chunk, -1, np.packbits(mask).tobytes(), None), *C.asked(chunk, keys, bits, low)], C.MESSAGE)

    def keep(table, answers):
        import numpy as np

        ids, body = C.in_order(table)
        words = C.Coded(body)
        gone = np.zeros(len(words.codes) + 1, np.int64)
        for bucket, bitmap in zip(answers.column("bucket").to_pylist(), answers.column("keys").to_pylist()):
            if bucket == -1:
                held = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(words.codes)))
                keys, first, which = np.unique(words.grams(window)[held], return_index=True, return_inverse=True)
                repeat = C.said(answers)[which] > 0
                repeat |= np.arange(len(held)) != first[which]
                np.add.at(gone, held[repeat], 1)
                np.add.at(gone, np.minimum(held[repeat] + window, len(words.codes)), -1)
        gone = np.cumsum(gone)[:-1] > 0
        rows, begin = [], 0
        for i, split, end in zip(ids, words.split, words.ends.tolist()):
            lost = gone[begin:end]
            kept = [w for w, x in zip(split, lost.tolist()) if not x] if lost.any() else split
            rows.append((None if i == C.NO_ID else i, b" ".join(kept), len(split), len(split) - len(kept)))
            begin = end
        return C.as_table(rows, "id bigint, text binary, n_words bigint, n_removed bigint")

    phrases = C.answered(corpus.map(state_anchors, C.MESSAGE), C.recurring, short=True, extra="u1")
    windows = stored(corpus.map_with(phrases, state_windows, C.MESSAGE), "windows")
    verdicts = C.answered(windows, C.earlier_elsewhere, extra="<i8").union(windows.where("bucket = -1").select("chunk", "bucket", "keys"))
    done = corpus.map_with(verdicts, keep, "id bigint, text binary, n_words bigint, n_removed bigint")
    return done.select(F.col("id").alias(id), F.col("text").cast("string").alias(text), "n_words", "n_removed")
