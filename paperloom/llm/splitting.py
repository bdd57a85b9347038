"""Problem 1: cutting oversized texts at natural boundaries.

Pieces overlap by a fixed number of code points, so what is chosen are the
cuts; each may advance by at most the limit less the overlap. Dynamic
programming over the boundary positions finds the cuts with the least sum of
cut penalties and size imbalance.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import WHITE

LIMIT = 1200
OVERLAP = 100

#: What a cut costs, by the kind of boundary. One step down costs more than
#: any imbalance of two pieces can save.
PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "word": 6.0, "forced": 40.0}
#: Each piece costs this, so that no cut is made for nothing.
PIECE = 3.0

_GAP = re.compile(rf"([.!?。！？]?[\"')\]”’»]*)([{WHITE}\x1c-\x1f]+)|[。！？](?=[^{WHITE}])")


def boundaries(text: str) -> tuple[list[tuple[int, str]], int]:
    """(position, kind) of each place where a cut may stand, and the longest run without white space."""
    out: list[tuple[int, str]] = []
    longest, last = 0, 0
    for m in _GAP.finditer(text):
        at, white = m.end(), m.group(2)
        if white is None:
            out.append((at, "sentence"))
            continue
        longest, last = max(longest, m.start(2) - last), at
        breaks = white.count("\n")
        kind = "paragraph" if breaks > 1 else "line" if breaks else "sentence" if m.group(1)[:1] in tuple(".!?。！？") else "word"
        out.append((at, kind))
    return out, max(longest, len(text) - last)


#: Where no boundary is in reach, cuts inside a word are looked at so many code points apart.
FORCED_STEP = 25


def _places(found: list[tuple[int, str]], size: int, reach: int) -> list[tuple[int, str]]:
    """Every boundary within the text, and places inside words where two of them lie further apart than a piece reaches."""
    out = sorted({(p, k) for p, k in found if 0 < p < size})
    edges = [0, *(p for p, _ in out), size]
    forced = [(p, "forced") for low, high in zip(edges, edges[1:]) if high - low > reach for p in (*range(low + FORCED_STEP, high, FORCED_STEP), low + reach, high - reach)]
    return sorted({*out, *forced})


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, str]], int]:
    """Cuts of a text over the limit as (position, kind), and its longest run without white space: the cheapest ones of all boundaries."""
    found, longest = boundaries(text)
    size, reach = len(text), limit - overlap
    places = [(0, ""), *_places(found, size, reach), (size, "end")]
    goal = size / max(1, -(-(size - overlap) // reach))
    at = np.array([p for p, _ in places], dtype=np.float64)
    price = np.array([PENALTY.get(k, 0.0) + PIECE for _, k in places])
    first = np.searchsorted(at, at - reach)
    first[at <= limit] = 0  # the first piece has no overlap before it
    first[(at > limit) & (first == 0)] = 1
    best = np.full(len(places), np.inf)
    best[0] = 0.0
    source = [0] * len(places)
    x = at / limit
    wanted, lows, prices = (x - goal / limit).tolist(), first.tolist(), price.tolist()
    for j in range(1, len(places)):
        low = lows[j]
        cost = x[low:j] - wanted[j]
        cost *= cost
        cost += best[low:j]
        i = int(cost.argmin())
        best[j] = cost[i] + prices[j]
        source[j] = low + i
    out, j = [], source[-1]
    while j > 0:
        out.append(places[j])
        j = source[j]
    return out[::-1], longest


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], int]:
    """(start, end, kind of the cut at the end) of each piece; one piece if the text is not over the limit."""
    if len(text) <= limit:
        return [(0, len(text), "end")], max(map(len, text.split()), default=0)
    chosen, longest = cuts(text, limit, overlap)
    out, start = [], 0
    for at, kind in [*chosen, (len(text), "end")]:
        out.append((start, at, kind))
        start = at - overlap
    return out, longest


PIECE_TYPE = pa.struct([("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("cut_kind", pa.string()), ("piece_text", pa.string())])


def split_texts(df: DataFrame, src: str, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, item_key, cut, piece_no, start, end, cut_kind, piece_text): the pieces of every text over the limit.

    White space at both ends is removed first; a text not over the limit after
    that, an empty and a null one give no row. Each piece has at most limit
    code points and, but for the first, starts with the last overlap code
    points of the one before. cut is "forced" if a run without white space is
    itself over the limit, else "boundary". Rows repeated with the same text
    count once; other columns are dropped. key is a column or an expression.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    long = (
        df.select(F.expr(key).cast("string").alias("item_key"), F.col(text).alias("text"))
        .filter(F.length("text") > limit)
        .dropDuplicates(["item_key", "text"])
    )

    def run(batches):
        for batch in batches:
            keys, cut, found = [], [], []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t.strip()
                if len(t) <= limit:
                    continue
                own, longest = pieces(t, limit, overlap)
                keys.append(item)
                cut.append("forced" if longest > limit else "boundary")
                found.append([{"piece_no": n, "start": a, "end": b, "cut_kind": k, "piece_text": t[a:b]} for n, (a, b, k) in enumerate(own)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(cut, pa.string()), pa.array(found, pa.list_(PIECE_TYPE))], ["item_key", "cut", "pieces"])

    kind = "array<struct<piece_no int, start int, end int, cut_kind string, piece_text string>>"
    return long.mapInArrow(run, f"item_key string, cut string, pieces {kind}").select(F.lit(src).alias("src"), "item_key", "cut", F.inline("pieces"))
