"""Problem 4: text statistics that tell prose from lists, tables and junk.

A text is cut into chunks of bounded size. Each chunk gives counts that add
up, and a state at its two ends: the unfinished first and last line and
whether a word runs over the border. Partials merge associatively: a line or
word that runs over a border is put together there and counted once. Huge
texts therefore cost no more memory than small ones, and their partials are
merged in two levels, FAN_IN to one and then all of a text, which are few: a
text of a string column has under 2 ** 31 bytes, so at most 2 ** 15 partials
and 128 of the first level. Ratios and rules are derived from the merged counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WHITE

CHUNK_CHARS = 1 << 16
FAN_IN = 256

#: What a text or a line must hold of a kind to be of it.
MAJORITY = 0.5
JUNK_TOKENS = 0.5
#: Words written with a space after each letter.
LONE_LETTERS = 0.6
ROW_NUMBERS = 0.55
#: Under this share of common words in all of a text, its lines without an end are entries.
ENTRY_COMMON = 0.1

_NUMBER = re.compile(r"[(\[]?[+\-−±]?\d[\d.,:/×^eE+\-–]*%?[)\],.;:]*\Z")
_ROW = re.compile(r"[^,;|\t]*(?:[,;|\t][^,;|\t]*){2,}\Z")
_CELL = re.compile(r"[,;|\t]")
_CELL_NUMBER = re.compile(r"[+\-−]?\d[\d.]*%?\Z")
_ASCII_WORD = re.compile(r"[\"'(\[{<*_`~]*[A-Za-z]")
_VOWEL = re.compile(r"[aeiouyAEIOUY]")
_CID = re.compile(r"\(?cid:\d+\)?")
_LETTERS = re.compile(r"[A-Za-z]+")
_MARKED = re.compile(r"\s*(?:[•‣◦·▪*\-–—]\s|\(?(?:[ivxlc]{1,6}|[a-z]|\d{1,4})\)\s|\[\d{1,4}\]\s|\d{1,4}[.:]\s)")
_INDEX = re.compile(r"[^\d,;:]{2,80}(?:,\s\d{1,4}(?:[–-]\d{1,4})?)+\Z")
_TERM = re.compile(r"\S.{0,80}? [–—:] \S")


def token_kind(token: str) -> str:
    """w word, l single letter, n number, t a whole row of cells, j unreadable, o other."""
    if len(token) == 1 and token.isascii() and token.isalpha():
        return "l"
    if _NUMBER.match(token):
        return "n"
    if "�" in token or _CID.match(token):
        return "j"
    if _ROW.match(token):
        cells = [c for c in _CELL.split(token) if c]
        if len(cells) >= 3 and sum(bool(_CELL_NUMBER.match(c)) for c in cells) * 2 >= len(cells):
            return "t"
    ascii_letters = _LETTERS.findall(token)
    letters = sum(c.isalpha() for c in token)
    if not letters:
        body = token.strip(".,;:!?()[]{}\"'|&=+-–—•*/<>~^_#`$%\\")
        return "o" if not body or (len(token) == 1 and not body.isdigit() and body not in "¤§¶¿¡±×÷ø@") else "j"
    if not ascii_letters:
        strange = sum(1 for c in token if "\x80" <= c <= "ɏ" or c in "™€œ¢")
        return "j" if strange * 2 > len(token) else "w"
    ascii_count = sum(map(len, ascii_letters))
    odd = sum(1 for c in token if ("\x80" <= c <= "ɏ" and not c.isalpha() and c not in "\xad¬¢") or c in "™€")
    if odd > ascii_count:
        return "j"
    if ascii_count >= 3 and max(map(len, ascii_letters)) >= 3 and not _VOWEL.search(token) and token.upper() != token:
        return "j"
    if 0 < ascii_count <= 2 and not _VOWEL.search(token) and token.islower() and token.isalpha() and len(token) == 2:
        return "j"
    return "w"


class _Kinds(dict):
    """Kind of each token, remembered; a common word is c."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, token: str) -> str:
        bare = token.strip(".,;:!?()[]{}\"'*_`").lower()
        kind = "c" if bare in self.common else token_kind(token)
        if len(token) < 40:
            if len(self) > 300_000:
                self.clear()
            self[token] = kind
        return kind


#: Counts that add up. The kinds of tokens, then lines and the non-space code
#: points that lie in lines of each kind.
SUMS = ("words", "chars", "alpha", "symbols", "word_chars", "common", "numbers", "junk", "rows", "others", "lines", "ended", "in_prose", "in_marked", "in_entry", "in_table", "in_junk")
_IN = {"prose": 12, "marked": 13, "entry": 14, "table": 15, "junk": 16}
#: A line, or the part of one that a chunk holds: its kinds of tokens as
#: counts (c, w, l, n, j, t, o), code points, first and last characters.
LINE = ("c", "w", "l", "n", "j", "t", "o", "chars", "head", "tail")
_ENDS = 90


def line_kind(c: int, w: int, lone: int, n: int, j: int, t: int, o: int, head: str, tail: str, whole: bool) -> str:
    """Kind of a line by its tokens; whole says that head is all of it."""
    tokens = c + w + lone + n + j + t
    if not tokens:
        return "junk" if o > 3 else "prose"
    if j >= JUNK_TOKENS * tokens or tokens >= 8 and lone >= LONE_LETTERS * tokens:
        return "junk"
    if whole and _INDEX.match(head.strip()) and c <= 1:
        return "marked"
    if t or n >= ROW_NUMBERS * tokens:
        return "table"
    if _MARKED.match(head):
        return "marked"
    ended = tail[-1:] in tuple(".!?。！？…:")
    if whole and not ended and _TERM.match(head) and c <= 1:
        return "marked"
    if not ended and c == 0 and tokens <= 10:
        return "entry"
    return "prose"


class Partial:
    """Counts of a stretch of text and the state at its ends."""

    __slots__ = ("sums", "first", "last", "broken", "space_before", "space_after", "empty")

    def __init__(self):
        self.sums = [0] * len(SUMS)
        self.first = self.last = None
        self.broken = False  # holds a line break
        self.space_before = self.space_after = True
        self.empty = True

    def close(self, line) -> None:
        c, w, lone, n, j, t, o, chars, head, tail = line
        if not chars:
            return
        self.sums[10] += 1
        tail = tail.rstrip()
        self.sums[11] += tail[-1:] in tuple(".!?。！？…")
        self.sums[_IN[line_kind(c, w, lone, n, j, t, o, head, tail, len(head) < _ENDS)]] += chars

    def add(self, other: "Partial") -> "Partial":
        """Self followed by other."""
        if other.empty:
            return self
        if self.empty:
            return other
        out = Partial()
        out.empty = False
        out.sums = [a + b for a, b in zip(self.sums, other.sums)]
        if not self.space_after and not other.space_before:
            out.sums[0] -= 1  # one word was counted on both sides
        out.space_before, out.space_after = self.space_before, other.space_after
        out.broken = self.broken or other.broken
        middle = join_lines(self.last, other.first)
        if self.broken and other.broken:
            out.close(middle)
            out.first, out.last = self.first, other.last
        elif self.broken:
            out.first, out.last = self.first, middle
        elif other.broken:
            out.first, out.last = middle, other.last
        else:
            out.first = out.last = middle
        return out

    def finish(self) -> list[int]:
        """Counts with the lines at both ends closed."""
        if self.empty:
            return self.sums
        done = Partial()
        done.sums = list(self.sums)
        done.close(self.first)
        if self.broken:
            done.close(self.last)
        return done.sums


def join_lines(a, b):
    head = a[8] if len(a[8]) >= _ENDS else (a[8] + b[8])[:_ENDS]
    return (*(x + y for x, y in zip(a[:8], b[:8])), head, (a[9] + b[9])[-4:])


def count_chunk(text: str, kinds: _Kinds) -> Partial:
    """Partial of a chunk."""
    out = Partial()
    if not text:
        return out
    out.empty = False
    out.space_before, out.space_after = text[0].isspace(), text[-1].isspace()
    lines = text.split("\n")
    out.broken = len(lines) > 1
    sums, found = out.sums, []
    for i, line in enumerate(lines):
        tokens = line.split()
        code = "".join(map(kinds.__getitem__, tokens))
        c, lone, n, j, t, o = code.count("c"), code.count("l"), code.count("n"), code.count("j"), code.count("t"), code.count("o")
        chars = sum(map(len, tokens))
        sums[0] += len(tokens)
        sums[5] += c
        sums[6] += n
        sums[7] += j
        sums[8] += t
        sums[9] += o
        sums[4] += chars
        made = (c, len(code) - c - lone - n - j - t - o, lone, n, j, t, o, chars, line[:_ENDS], line.rstrip()[-4:] if i + 1 < len(lines) else line[-4:])
        if 0 < i < len(lines) - 1:
            out.close(made)
        else:
            found.append(made)
    sums[1] += len(text)
    out.first, out.last = found[0], found[-1]
    ascii_only = text.isascii()
    raw = np.frombuffer(text.encode("latin-1") if ascii_only else text.encode("utf-32-le", "surrogatepass"), dtype=np.uint8 if ascii_only else np.uint32)
    alpha = int((((raw | 32) >= 97) & ((raw | 32) <= 122)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    if not ascii_only:
        alpha += sum(ch.isalpha() for ch in text if ch > "\x7f")
    sums[2] += alpha
    sums[3] += sums[4] - alpha - digits
    return out


def _state(p: Partial) -> dict:
    line = lambda x: None if x is None else dict(zip(LINE, x))
    return {"sums": p.sums, "first": line(p.first), "last": line(p.last), "broken": p.broken, "space_before": p.space_before, "space_after": p.space_after, "empty": p.empty}


def _revive(d: dict) -> Partial:
    p = Partial()
    line = lambda x: None if x is None else tuple(x[k] for k in LINE)
    p.sums, p.first, p.last = list(d["sums"]), line(d["first"]), line(d["last"])
    p.broken, p.space_before, p.space_after, p.empty = d["broken"], d["space_before"], d["space_after"], d["empty"]
    return p


_LINE_ARROW = pa.struct([(k, pa.string() if k in ("head", "tail") else pa.int64()) for k in LINE])
_ARROW = pa.struct([("sums", pa.list_(pa.int64())), ("first", _LINE_ARROW), ("last", _LINE_ARROW), ("broken", pa.bool_()), ("space_before", pa.bool_()), ("space_after", pa.bool_()), ("empty", pa.bool_())])
_LINE_SQL = "struct<" + ",".join(f"{k}:{'string' if k in ('head', 'tail') else 'bigint'}" for k in LINE) + ">"
_SQL = f"struct<sums:array<bigint>,first:{_LINE_SQL},last:{_LINE_SQL},broken:boolean,space_before:boolean,space_after:boolean,empty:boolean>"


def text_statistics(df: DataFrame, key: str, text: str, common_words: list[str], carry: list[str] = (), chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row for each row of df: key, the carried columns, and statistics.

    words (runs of non-white-space), chars, mean_word_length, symbol_ratio,
    ended_lines (share of lines ending in . ! ?), common_share, and the share
    of the text's characters in lines of each kind. kind is list, table, junk
    or prose; null for a null text and prose for an empty one, whose counts
    are 0 and ratios null. common_words is a reference list of fixed size.
    """
    common = frozenset(w.lower() for w in common_words)
    carried = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("key"), *carried, F.col(text).alias("text"))
    keep = ["row", "key", *(f"carry_{i}" for i in range(len(carry)))]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    small = F.length("text") <= chunk_chars

    def whole(batches):
        memo = _Kinds(common)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sums = [None if t is None else count_chunk(t, memo).finish() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.list_(pa.int64()))], [*keep, "sums"])

    head = ", ".join(f"{k} {kinds[k]}" for k in keep)
    counted = rows.filter(small | F.col("text").isNull()).mapInArrow(whole, f"{head}, sums array<bigint>")

    # texts over a chunk: cut, count, merge in order, level by level
    pieces = rows.filter(~small).select(
        *keep,
        # one walk through the text; substrings would each start from its beginning
        F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))).alias("no", "piece"),
    )

    def partials(batches):
        memo = _Kinds(common)
        for batch in batches:
            made = [_state(count_chunk(t, memo)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, _ARROW)], [*keep, "no", "partial"])

    def merge(batches):
        for batch in batches:
            made = []
            for states in batch.column(batch.num_columns - 1).to_pylist():
                total = Partial()
                for s in states:
                    total = total.add(_revive(s["partial"]))
                made.append(_state(total))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, _ARROW)], [*keep, "no", "partial"])

    def finish(batches):
        for batch in batches:
            made = []
            for states in batch.column(batch.num_columns - 1).to_pylist():
                total = Partial()
                for s in states:
                    total = total.add(_revive(s["partial"]))
                made.append(total.finish())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(made, pa.list_(pa.int64()))], [*keep, "sums"])

    ordered = F.array_sort(F.collect_list(F.struct("no", "partial"))).alias("partials")
    level = pieces.mapInArrow(partials, f"{head}, no int, partial {_SQL}")
    level = level.groupBy(*keep, F.floor(F.col("no") / FAN_IN).cast("int").alias("no")).agg(ordered).mapInArrow(merge, f"{head}, no int, partial {_SQL}")
    top = level.groupBy(*keep).agg(ordered).select(*keep, F.lit(0).alias("no"), "partials").mapInArrow(finish, f"{head}, sums array<bigint>")
    return _derive(counted.unionByName(top), key, carry)


def _derive(sums: DataFrame, key: str, carry) -> DataFrame:
    at = {name: F.col("sums")[i] for i, name in enumerate(SUMS)}
    ratio = lambda a, b: F.when(b > 0, a / b)
    spoken = at["words"] - at["numbers"] - at["junk"] - at["rows"] - at["others"]
    common = F.coalesce(ratio(at["common"], spoken), F.lit(0.0))
    inside = at["word_chars"]
    entries = F.when(common < ENTRY_COMMON, at["in_entry"]).otherwise(F.lit(0))
    kind = (
        F.when(F.col("sums").isNull(), F.lit(None).cast("string"))
        .when(inside == 0, "prose")
        .when(at["in_junk"] >= MAJORITY * inside, "junk")
        .when(at["in_table"] >= MAJORITY * inside, "table")
        .when(at["in_marked"] + entries >= MAJORITY * inside, "list")
        .otherwise("prose")
    )
    return sums.select(
        F.col("key").alias(key),
        *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)),
        at["words"].alias("words"),
        at["chars"].alias("chars"),
        ratio(at["word_chars"], at["words"]).alias("mean_word_length"),
        ratio(at["symbols"], at["word_chars"]).alias("symbol_ratio"),
        ratio(at["ended"], at["lines"]).alias("ended_lines"),
        F.when(at["words"] > 0, common).alias("common_share"),
        ratio(at["in_prose"], inside).alias("prose_share"),
        ratio(at["in_marked"] + at["in_entry"], inside).alias("list_share"),
        ratio(at["in_table"], inside).alias("table_share"),
        ratio(at["in_junk"], inside).alias("junk_share"),
        kind.alias("kind"),
    )


#: The cleaning step's cuts.
EMPTY_UNDER, LOW_UNDER, OVER_CLEANED = 300, 500, 0.3


def quality_findings(papers: DataFrame, common_words: DataFrame) -> DataFrame:
    """(paper_id, finding): what is wrong with a paper's clean_text or with what is stored of it.

    Rows with null clean_text give none; a null count or flag differs from
    any value; rows repeated count once.
    """
    words = [r[0] for r in common_words.select("word").filter("word is not null").collect()]  # a fixed list of 245
    stats = text_statistics(papers.filter(F.col("clean_text").isNotNull()), "paper_id", "clean_text", words, ["word_count_raw", "word_count_clean", "quality_flag"])
    n = F.col("words")
    flag = F.when(n < EMPTY_UNDER, "empty").when(n < LOW_UNDER, "low_quality").when(n / F.col("word_count_raw") < OVER_CLEANED, "over_cleaned").otherwise("ok")
    findings = F.array_compact(
        F.array(
            F.when(F.col("kind") != "prose", F.col("kind")),
            F.when(~F.col("word_count_clean").eqNullSafe(n), F.lit("wrong_count")),
            F.when(~F.col("quality_flag").eqNullSafe(flag), F.lit("wrong_flag")),
        )
    )
    return stats.select("paper_id", F.explode(findings).alias("finding")).distinct()
