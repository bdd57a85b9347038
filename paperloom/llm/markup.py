"""Problem 5: clean text out of HTML, Markdown, wiki and LaTeX residue.

A text is cut into blocks, the constructs of each language are recognised in
them and turned into one plain notation that keeps headings, list items,
code, tables and formulas. Two passes of block rules then part content from
leftover navigation: only link density makes a block bad; the second pass
lets each undecided block inherit the label of the nearest decided
neighbours, so that what is short or has few common words goes only among
link-dense blocks, and a text without links keeps every block. Each construct
leaves a mark of its language where it is converted; a block carries the
marks that came to lie in it, and the languages of a text are those of its
blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("html", "markdown", "wiki", "latex")

# Element names of HTML.
_ELEMENTS = (
    "a abbr address area article aside b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark "
    "meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea "
    "tfoot th thead title tr tt u ul var video"
).split()

_TAG = rf"</?(?:{'|'.join(_ELEMENTS)})(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>=]+))?)*\s*/?>"
_REFERENCE = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"
HTML = re.compile(rf"(?i:{_TAG})|{_REFERENCE}|<!--(?:(?!<!--).)*?-->", re.S)
MARKDOWN = re.compile(
    r"^[ \t]*(?:```|~~~)[\w+-]*[ \t]*$"  # fences
    r"|^#{1,6}[ \t]+\S"  # headings
    r"|!?\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))+(?:[ \t]+\"[^\"\n]*\")?\)"  # links and images
    r"|!?\[[^\[\]\n]*[A-Za-z][^\[\]\n]*\]\[[A-Za-z][^\[\]\n]*\]"
    r"|(?<![*\w\\])\*{2,3}(?=[^\s*])[^*\n]*(?:\n[^*\n]+)?(?<=[^\s*])\*{2,3}(?![*\w])"
    r"|(?<![_\w\\])__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?![_\w])"
    r"|(?<![~\w])~~(?=[^\s~])[^~\n]+~~(?![~\w])"
    r"|(?<![`\\\w])`(?=[^`\s])[^`'\n]*(?<=[^`\s])`(?![`\w])"
    r"|(?<![*\w\\])\*(?=[A-Za-z])[^*\n]*(?<=[A-Za-z])\*(?![*\w])"
    r"|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$",  # rule under a table's head
    re.M,
)
WIKI = re.compile(
    r"\[\[[^\[\]\n]+(?:\n[^\[\]\n]+)?\]\]"
    r"|\{\{(?=[A-Za-z#])[^{}]+\}\}"
    r"|(?<![\w'`])'{2,5}(?=[^\s'])[^'\n]+(?<=[^\s'])'{2,5}(?![\w'])"
    r"|^(={2,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*$"
    r"|^[ \t]*\{\|[^\n]*$|^[ \t]*\|-[ \t]*(?:\w[^\n|]*)?$|^[ \t]*\|\}[ \t]*$",
    re.M,
)
#: A formula of any length ends at a blank line at the latest, as TeX has it.
_INNER = r"(?:[^$\n]|\n(?![ \t]*\n))"
_FORMULA = rf"\$\${_INNER}+\$\$|(?<![\\$\w])\$(?=[^\s$]){_INNER}*?(?<=[^\s\\])\$(?![\d$])"
LATEX = re.compile(
    rf"{_FORMULA}|\\(?:begin|end)\{{[A-Za-z*]+\}}|\\\[|\\\]|\\\(|\\\)"
    r"|\\[\"'`^~=.](?:\{\\?[A-Za-z]\}|[A-Za-z])|\\[A-Za-z]+\*?"
)
FIND = {"html": HTML, "markdown": MARKDOWN, "wiki": WIKI, "latex": LATEX}
#: A character without which a language cannot stand in a text.
_NEEDS = {"html": re.compile("[<&]"), "markdown": re.compile("[`#*_~]|\\]\\(|\\]\\[|--"), "wiki": re.compile("\\[\\[|\\{\\{|''|==|\\{\\||\\|-|\\|\\}"), "latex": re.compile("[\\\\$]")}


def languages(text: str) -> list[str]:
    """Markup languages of which a construct stands in the text."""
    return [name for name in LANGUAGES if _NEEDS[name].search(text) and FIND[name].search(text)]


# ---- conversion ------------------------------------------------------------

MARK = {"html": "\ue010", "markdown": "\ue011", "wiki": "\ue012", "latex": "\ue013"}
_MARKS = re.compile("[\ue010-\ue013]")
_OF_MARK = {c: name for name, c in MARK.items()}
_HIDE = "\ue000{}\ue001"
_HIDDEN = re.compile("\ue000(\\d+)\ue001")


class _Kept:
    """Code and formulas, set aside while the rest is converted, and the mark of the language that is converted."""

    def __init__(self):
        self.held: list[str] = []
        self.language = ""

    def mark(self, m: re.Match) -> str:
        """The language's mark, if what was matched is a construct that counts for it."""
        return MARK[self.language] if FIND[self.language].search(m[0]) else ""

    def hold(self, text: str) -> str:
        self.held.append(text)
        return _HIDE.format(len(self.held) - 1)

    def restore(self, text: str) -> str:
        while True:
            done = _HIDDEN.sub(lambda m: self.held[int(m[1])] if int(m[1]) < len(self.held) else "", text)
            if done == text:
                return done
            text = done


def _code(body: str, mark: str) -> str:
    return f"\n```{mark}\n" + body.strip("\n") + "\n```\n"


# an element left open reaches to the next of its kind at most, so no pattern runs through the text from every tag
_PRE = re.compile(r"<pre\b[^>]*>(?:\s*<code[^>]*>)?((?:(?!<pre\b).)*?)(?:</code>\s*)?</pre>", re.S | re.I)
_ROW = re.compile(r"<tr\b[^>]*>((?:(?!<tr\b).)*?)</tr>", re.S | re.I)
_CELL = re.compile(r"<t[dh]\b[^>]*>((?:(?!<t[dh]\b).)*?)</t[dh]>", re.S | re.I)
_DROP = re.compile(r"<(script|style)\b[^>]*>(?:(?!<\1\b).)*?</\1>|<!--(?:(?!<!--).)*?-->", re.S | re.I)
_HEAD = re.compile(r"<h([1-6])\b[^>]*>((?:(?!<h[1-6]\b).)*?)</h\1>", re.S | re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>((?:(?!<a\b).)*?)</a>", re.S | re.I)
_ITEM = re.compile(r"<li[^>]*>\s*", re.I)
_BREAK = re.compile(r"<(?:br|hr)\s*/?>|</?(?:p|div|ul|ol|table|tbody|thead|section|article|blockquote|dl|dd|dt)\b[^>]*>", re.I)
_SUBSUP = re.compile(r"<(sub|sup)>(.*?)</\1>", re.S | re.I)
_ANY_TAG = re.compile(_TAG, re.I)
LINK, END = "\ue002", "\ue003"  # mark anchors until link density is taken


def from_html(text: str, kept: _Kept) -> str:
    mark = kept.mark
    text = _PRE.sub(lambda m: kept.hold(_code(html.unescape(_ANY_TAG.sub("", m[1])), mark(m))), text)
    text = _DROP.sub(mark, text)
    text = _HEAD.sub(lambda m: "\n\n" + "#" * int(m[1]) + " " + " ".join(m[2].split()) + mark(m) + "\n\n", text)
    text = _ROW.sub(lambda m: "\n" + mark(m) + " | ".join(" ".join(c.split()) for c in _CELL.findall(m[1])) + "\n", text)
    text = _ITEM.sub(lambda m: "\n- " + mark(m), text)
    text = _ANCHOR.sub(lambda m: LINK + m[1] + END + mark(m), text)
    text = _SUBSUP.sub(lambda m: ("_" if m[1].lower() == "sub" else "^") + m[2] + mark(m), text)
    text = _BREAK.sub(lambda m: "\n" + mark(m), text)
    text = _ANY_TAG.sub(mark, text)
    return re.sub(_REFERENCE, lambda m: html.unescape(m[0]).replace("\xa0", " ") + mark(m), text)


_FENCE = re.compile(r"^[ \t]*(```|~~~)[\w+-]*[ \t]*\n(.*?)^[ \t]*\1[ \t]*$", re.M | re.S)
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])")
_LINKS = re.compile(r"\[([^\[\]\n]+)\](?:\((?:[^()\s]|\([^()\s]*\))+(?:[ \t]+\"[^\"\n]*\")?\)|\[[A-Za-z][^\[\]\n]*\])")
_EMPHASIS = re.compile(r"(?<![*_~\w\\])(\*{1,3}|__|~~)(?=[^\s*_~])([^*~\n]+?)(?<=[^\s*_~])\1(?![*_~\w])")
_TICK = re.compile(r"(?<![`\\\w])`(?=[^`\s])([^`'\n]*)(?<=[^`\s])`(?![`\w])")
_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?", re.M)
_STAR = re.compile(r"^([ \t]*)[*+][ \t]+(?=\S)", re.M)


def from_markdown(text: str, kept: _Kept) -> str:
    mark = kept.mark
    text = _FENCE.sub(lambda m: kept.hold(_code(m[2], mark(m))), text)
    text = _TICK.sub(lambda m: kept.hold(m[1] + mark(m)), text)
    text = _IMAGE.sub(lambda m: m[1] + mark(m), text)
    text = _LINKS.sub(lambda m: LINK + m[1] + END + mark(m), text)
    text = _STAR.sub(r"\1- ", text)
    for _ in range(2):
        text = _EMPHASIS.sub(lambda m: m[2] + mark(m), text)
    text = re.sub(r"^[ \t]*\|(.*)\|[ \t]*$", lambda m: " | ".join(c.strip() for c in m[1].split("|")), text, flags=re.M)
    return _RULE.sub(mark, text)


_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n((?:(?!^[ \t]*\{\|).)*?)^[ \t]*\|\}[ \t]*$", re.M | re.S)
_FILE = re.compile(r"\[\[(?:File|Image|Category)\s*:[^\[\]]*\]\]", re.I)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}", re.S)
_QUOTES = re.compile(r"(?<![\w'`])('{2,5})(?=[^\s'])([^'\n]+)(?<=[^\s'])\1(?![\w'])")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$", re.M)


def from_wiki(text: str, kept: _Kept) -> str:
    mark = kept.mark

    def rows(m):
        out = []
        for row in re.split(r"^[ \t]*\|-[^\n]*$", m[1], flags=re.M):
            cells = [c.strip() for c in re.split(r"\|\||!!|^[ \t]*[|!]", row, flags=re.M) if c.strip()]
            if cells:
                out.append(" | ".join(cells))
        return "\n" + mark(m) + "\n".join(out) + "\n"

    def template(m):
        return filled(m) + mark(m)

    def filled(m):
        parts = [p.strip() for p in m[1].split("|")]
        named = [p for p in parts[1:] if "=" in p]
        if named:
            return "\n" + "\n".join(" | ".join(x.strip() for x in p.split("=", 1)) for p in named) + "\n"
        return f" ({', '.join(parts[1:])})" if parts[0].lower().startswith("cit") else parts[-1]

    text = _WIKI_TABLE.sub(rows, text)
    for _ in range(3):
        text = _TEMPLATE.sub(template, text)
    text = _FILE.sub(lambda m: (m[0].strip("[]").rsplit("|", 1)[1] if m[0].count("|") else "") + mark(m), text)
    text = _WIKI_LINK.sub(lambda m: LINK + m[1] + END + mark(m), text)
    text = _WIKI_HEAD.sub(lambda m: "\n" + "#" * len(m[1]) + " " + m[2] + mark(m) + "\n", text)
    text = _QUOTES.sub(lambda m: m[2] + mark(m), text)
    return _STAR.sub(r"\1- ", text)


_DISPLAY = re.compile(
    r"\\\[((?:(?!\\\[).)*?)\\\]|\\begin\{(equation|align|displaymath|eqnarray|gather)\*?\}((?:(?!\\begin\{\2).)*?)\\end\{\2\*?\}|\$\$(.*?)\$\$", re.S
)
_INLINE = re.compile(rf"{_FORMULA}|\\\(((?:(?!\\\().)*?)\\\)", re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]]*\])?((?:(?!\\begin\{\1\}).)*?)\\end\{\1\}", re.S)
_SECTION = re.compile(r"\\((?:sub){0,2})(?:section|chapter|paragraph)\*?\{([^{}]*)\}(?:\s*\\label\{[^{}]*\})?")
_CITE = re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|autoref)\*?(?:\[[^\]]*\])*\{([^{}]*)\}")
_LABEL = re.compile(r"\\(?:label|index|vspace|hspace|bibliography\w*|input|include)\*?\{[^{}]*\}")
_ACCENT = re.compile(r"\\([\"'`^~=.])(?:\{\\?([A-Za-z])\}|([A-Za-z]))")
_COMBINING = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
_WITH_ARGUMENT = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}")


def from_latex(text: str, kept: _Kept) -> str:
    import unicodedata

    mark = kept.mark
    text = _VERBATIM.sub(lambda m: kept.hold(_code(m[2], mark(m))), text)
    text = _DISPLAY.sub(lambda m: kept.hold("\n$$ " + " ".join((m[1] or m[3] or m[4] or "").split()) + f" $${mark(m)}\n"), text)
    text = _INLINE.sub(lambda m: kept.hold("$" + (m[1] if m[0].startswith("\\(") else m[0].strip("$")).strip() + "$" + mark(m)), text)
    text = _SECTION.sub(lambda m: "\n" + "#" * (1 + m[1].count("sub")) + " " + m[2] + mark(m) + "\n", text)
    text = _CITE.sub(lambda m: f" [{m[1]}]" + mark(m), text)
    text = _LABEL.sub(mark, text)
    text = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m[2] or m[3]) + _COMBINING[m[1]]) + mark(m), text)
    text = re.sub(r"^[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m[1] + ": " if m[1] else "") + mark(m), text, flags=re.M)
    text = re.sub(r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]]*\])?", lambda m: "\n" + mark(m), text)
    for _ in range(3):
        text = _WITH_ARGUMENT.sub(lambda m: m[1] + mark(m), text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", text)
    text = re.sub(r"\\([%&#_{}$])", r"\1", text)
    return re.sub(r"\\[A-Za-z]+\*?[ \t]?", mark, text)


_FROM = {"html": from_html, "markdown": from_markdown, "wiki": from_wiki, "latex": from_latex}

# ---- blocks ----------------------------------------------------------------

#: Block rules. Lengths in characters.
SHORT, LONG = 70, 200
STOPWORDS_LOW = 0.30
LINK_DENSITY = 0.4
_STRUCTURE = re.compile(r"(#{1,6} )|(- |\d{1,3}[.)] )|(```)|(\$\$ )|([^|\n]+ \| )")
#: Lines of lists: bullets, (i), [1], a), iv. and index entries.
_LISTED = re.compile(
    r"[ \t]*(?:[•‣◦▪■●○∙·⁃–—*+-]|\(?(?:[ivxlcdm]{1,7}|[a-z]|\d{1,3})\)|\[\d{1,4}\]|[ivxlcdm]{1,7}\.|\d{1,3}[.)])[ \t]+\S"
    r"|[^\W\d][^,\n]{0,80}(?:, ?\d{1,5}(?:[-–]\d{1,5})?)+[ \t]*$",
    re.I,
)
_NUMBER = re.compile(r"[-+−±(<>~]*\d[\d.,:/eE+−-]*[%)*]*")
_WIDE = re.compile(r"\t| {2,}")
#: Longest cell of a table that is aligned by spaces.
CELL = 40


def _is_row(line: str) -> bool:
    """Cells parted by tabs, runs of spaces or commas, or single spaces where most cells are numbers."""
    line = line.strip()
    wide = [c.strip() for c in _WIDE.split(line) if c.strip()]
    if len(wide) > 1 and ("\t" in line or max(map(len, wide)) <= CELL and (len(wide) > 2 or _NUMBER.fullmatch(wide[1]))):
        return True
    for cells in (line.split(","), line.split()):
        numbers = sum(bool(_NUMBER.fullmatch(c.strip())) for c in cells)
        if len(cells) > 2 and numbers * 2 > len(cells):
            return True
    return line.count(",") > 1 and not re.search(r"\s", line)


def _kind(lines: list[str]) -> str:
    """list, table or text: what a run of lines without other marks is."""
    listed = [bool(_LISTED.match(x)) for x in lines]
    if sum(listed) * 2 > len(lines) or listed[0] and sum(listed) > 1:
        return "list"
    return "table" if len(lines) > 1 and sum(map(_is_row, lines)) * 2 > len(lines) else "text"


def _link_density(block: str) -> float:
    linked = sum(len(x) for x in re.findall(f"{LINK}([^{END}]*){END}", block))
    return linked / max(1, len(block.replace(LINK, "").replace(END, "").strip()))


def blocks_of(text: str) -> list[tuple[str, str, set[str]]]:
    """(kind, text, languages) of each block: heading, list, code, formula, table or text.

    Marks that stand on a line of their own go to the next block, after the
    last block to that one; a text of nothing but markup is one empty block.
    """
    out: list[tuple[str, list[str], set[str]]] = []
    in_code = open_block = False
    waiting: set[str] = set()
    for line in text.split("\n"):
        if marks := _MARKS.findall(line):
            line = _MARKS.sub("", line)
            waiting.update(_OF_MARK[c] for c in marks)
        if in_code:
            out[-1][1].append(line)
            in_code = not line.startswith("```")
            continue
        if not line.strip():
            open_block = False
            continue
        m = _STRUCTURE.match(line)
        kind = "text" if not m else ("heading", "list", "code", "formula", "table")[m.lastindex - 1]
        in_code = kind == "code"
        if open_block and kind == out[-1][0] and kind in ("text", "table"):
            out[-1][1].append(line)
        else:
            out.append((kind, [line], set()))
        out[-1][2].update(waiting)
        waiting = set()
        open_block = kind in ("text", "table")
    if waiting:
        if not out:
            out.append(("text", [""], set()))
        out[-1][2].update(waiting)
    blocks = [(k, lines, "\n".join(lines), found) for k, lines, found in out]
    return [(_kind(lines) if k == "text" and _link_density(block) <= LINK_DENSITY else k, block, found) for k, lines, block, found in blocks]


def first_pass(kind: str, block: str, common: frozenset[str]) -> str:
    """good, bad, near (nearly good) or short (undecided)."""
    plain = block.replace(LINK, "").replace(END, "").strip()
    if kind in ("code", "formula", "table"):
        return "good"
    if kind == "text" and _link_density(block) > LINK_DENSITY:
        return "bad"
    if len(plain) < SHORT:
        return "short"
    words = plain.lower().split()
    density = sum(w.strip(".,;:()") in common for w in words) / len(words)
    return "good" if len(plain) > LONG or density >= STOPWORDS_LOW or plain[-1] in ".!?" else "near"


def second_pass(labels: list[str]) -> list[str]:
    """Undecided blocks take the label of the nearest decided neighbours; where two differ, the nearer one's, content on a tie."""
    n = len(labels)
    left, right = [(n + 1, "good")] * n, [(n + 1, "good")] * n
    last = None
    for i in range(n):
        if labels[i] in ("good", "bad"):
            last = i
        if last is not None:
            left[i] = (i - last, labels[last])
    last = None
    for i in range(n - 1, -1, -1):
        if labels[i] in ("good", "bad"):
            last = i
        if last is not None:
            right[i] = (last - i, labels[last])
    out = []
    for i, own in enumerate(labels):
        if own in ("good", "bad"):
            out.append(own)
        elif own == "near":
            out.append("bad" if left[i][1] == right[i][1] == "bad" and max(left[i][0], right[i][0]) <= n else "good")
        else:
            (a, x), (b, y) = left[i], right[i]
            out.append(x if x == y or a < b else y if b < a else "good")
    return out


_OWN = re.compile("[\ue000-\ue003\ue010-\ue013]")


def convert(text: str, common: frozenset[str]) -> tuple[list[str], str, list[dict]]:
    """Languages of the blocks, clean text and labelled blocks of one text."""
    kept = _Kept()
    possible = languages(text)
    out = _OWN.sub("", text)
    for name in ("markdown", "latex", "wiki", "html"):
        if name in possible:
            kept.language = name
            # what is left over of a construct that has no counterpart is marked too, before its last character:
            # a heading's first character may open a construct of another language
            out = FIND[name].sub(lambda m, c=MARK[name]: m[0][:-1] + c + m[0][-1:], _FROM[name](out, kept))
    parts = blocks_of(kept.restore(out))
    labels = second_pass([first_pass(k, b, common) for k, b, _ in parts])
    bare = [(k, b.replace(LINK, "").replace(END, ""), x, [n for n in LANGUAGES if n in found]) for (k, b, found), x in zip(parts, labels)]
    clean = "\n\n".join(b.strip("\n") if k == "code" else b.rstrip().lstrip("\n") if k == "table" else b.strip() for k, b, x, _ in bare if x == "good" or k != "text")
    whole = [n for n in LANGUAGES if any(n in found for *_, found in bare)]
    return whole, clean, [{"kind": k, "label": x, "text": b, "markup": found} for k, b, x, found in bare]


def strip_markup(df: DataFrame, src: str, key: str, text: str, common_words: Iterable[str]) -> DataFrame:
    """(src, item_key, markup, clean_text, blocks) of each row of df.

    markup is the list of languages of all blocks; clean_text holds the blocks
    labelled as content and every heading, list item, code block, table and
    formula; blocks holds all, with kind, label and languages, so nothing is
    lost. A null
    text has null clean_text and no markup, an empty one an empty clean_text.
    Rows repeated stay; other columns are dropped.
    """
    common = frozenset(w.lower() for w in common_words if w)
    names = {"kind": pa.string(), "label": pa.string(), "text": pa.string(), "markup": pa.list_(pa.string())}

    def block_column(blocks: tuple[list[dict], ...]) -> pa.ListArray:
        edges = np.zeros(len(blocks) + 1, dtype=np.int32)
        np.cumsum([len(b) for b in blocks], out=edges[1:])
        columns = [pa.array([x[n] for b in blocks for x in b], t) for n, t in names.items()]
        return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(columns, list(names)))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                made = [([], None, []) if t is None else convert(t, common) for t in texts[at : at + 512]]
                markup, clean, blocks = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(made)), pa.array(markup, pa.list_(pa.string())), pa.array(clean, pa.string()), block_column(blocks)],
                    ["item_key", "markup", "clean_text", "blocks"],
                )

    chosen = df.select(F.expr(key).cast("string").alias("item_key"), F.col(text).alias("text"))
    schema = "item_key string, markup array<string>, clean_text string, blocks array<struct<kind string, label string, text string, markup array<string>>>"
    return chosen.mapInArrow(run, schema).select(F.lit(src).alias("src"), "*")
