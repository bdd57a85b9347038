"""Problem 2: continuous paragraphs out of the text of scanned pages.

Three parts. Page furniture is found by position: where form feeds part the
pages, by the place of a line on its page, else by the distance from line to
line; lines that come again are running headers, numbers that go up by one a
page apart are page numbers. An averaged perceptron edits characters: at each
one it keeps, replaces or deletes it, inserts one before it, or joins a broken
line. It is trained on the corpus's own words, damaged through confusions that
scanners make and by characters lost, doubled and changed at random, so no
labelled pages are needed. To the confusions that are known come those that
the corpus shows itself: rare forms of many frequent words that differ by the
same characters. What the editor proposes for a word is taken only if the
corpus's vocabulary has it far more often than the damaged form.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

# What scanners read in the place of what was printed.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("s", "5"), ("b", "6"), ("t", "†"), ("c", "¢"), ("a", "ä"), ("i", "|"),
    ("d", "cl"), ("m", "rn"), ("u", "ii"), ("h", "li"), ("n", "ri"), ("e", "c"),
]
#: Ligatures are right readings; they are written out but count as no damage.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
SOFT_HYPHENS = "‐\xad¬"

#: A word counts as known from so many files on, or from one in so many of all files, whichever is more, and
#: replaces a form it is so many times more frequent than. The share bounds the vocabulary at any size: there are
#: at most KNOWN_SHARE times as many known words as a file has different ones, and by their usual distribution
#: far fewer.
LEAST_FILES, KNOWN_SHARE, TIMES = 3, 10_000, 5
#: Files of a word that an edit may lead to which no confusion explains, and the length of words that may have one.
OTHER_FILES, OTHER_LENGTH = 20, 5
#: Share of words damaged so that the perceptron's margin may leave alone.
MISSED = 0.05
#: A confusion is learned from so many frequent words on, and if this share of those that could show it do.
CONFUSED_WORDS, CONFUSED_SHARE = 10, 0.02
#: The editor is trained on at most so many words, the most frequent, and so many rounds.
TRAIN_WORDS, ROUNDS = 2500, 4
BEAM = 6
#: Misread words outside the furniture that make a text misread.
LEAST_MISREAD = 2
#: Lines from one page's furniture to the next, at least.
PAGE_LINES = 4
#: Lines with words at the top and bottom of a page that furniture is looked for in, and the share of a repeated line's places that must be there.
EDGE_LINES, AT_EDGE = 2, 0.8

_TOKEN = re.compile(r"[\w†¢|]+(?:-[\w†¢|]+)*")
_BROKEN = re.compile(rf"([\w†¢|]+)([-{SOFT_HYPHENS}])[ \t]*\Z")
HYPHENS = tuple("-" + SOFT_HYPHENS)
#: Characters at a line's end in which a broken word is looked for.
TAIL = 60
_HEAD_WORD = re.compile(r"\s*([\w†¢|]+)")
_LOWER = re.compile(r"[a-z]+\Z")



def alike(confusions: list[tuple[str, str]]) -> dict[int, str]:
    """For each character what is left when confused ones are made alike: one reading of single ones, pairs written out."""
    single = {read: true for true, read in confusions if len(read) == 1}
    double = {true: read for true, read in confusions if len(read) > 1}

    def expand(ch: str, on_the_way: str = "") -> str:
        if ch in on_the_way:
            return ch
        if ch in single:
            return expand(single[ch], on_the_way + ch)
        return "".join(expand(c, on_the_way + ch) for c in double[ch]) if ch in double else ch

    return str.maketrans({ch: expand(ch) for ch in single.keys() | double.keys()})


_ALIKE = alike(CONFUSIONS)

# ---- averaged perceptron ----------------------------------------------------


class Perceptron:
    """Multi-class averaged perceptron over named features."""

    def __init__(self):
        self.weights: dict[str, dict[str, float]] = {}
        self.least = 0.0
        self._sums: dict[tuple[str, str], float] = defaultdict(float)
        self._since: dict[tuple[str, str], int] = defaultdict(int)
        self._now = 0

    def scores(self, features: list[str]) -> dict[str, float]:
        out: dict[str, float] = {"K": 0.0}
        for f in features:
            for c, w in self.weights.get(f, {}).items():
                out[c] = out.get(c, 0.0) + w
        return out

    def best(self, features: list[str]) -> str:
        s = self.scores(features)
        return max(s, key=lambda c: (s[c], c))

    def learn(self, features: list[str], right: str) -> None:
        self._now += 1
        guess = self.best(features)
        if guess == right:
            return
        for f in features:
            own = self.weights.setdefault(f, {})
            for c, step in ((right, 1.0), (guess, -1.0)):
                key = (f, c)
                w = own.get(c, 0.0)
                self._sums[key] += (self._now - self._since[key]) * w
                self._since[key] = self._now
                own[c] = w + step

    def finish(self) -> "Perceptron":
        for f, own in self.weights.items():
            for c, w in own.items():
                total = self._sums[f, c] + (self._now - self._since[f, c]) * w
                own[c] = total / max(1, self._now)
        self._sums.clear()
        self._since.clear()
        return self


def _char_features(word: str, i: int) -> list[str]:
    p = f"^^^{word}$$$$"
    j = i + 3
    a, b, c, d, e, f, g = p[j - 3 : j + 4]
    return [f"0{d}", f"1{c}{d}", f"2{d}{e}", f"3{c}{d}{e}", f"4{b}{c}{d}", f"5{d}{e}{f}", f"6{b}{c}{d}{e}", f"7{c}{d}{e}{f}", f"8{a}{b}{c}{d}", f"9{d}{e}{f}{g}", f"A{b}{c}{d}{e}{f}"]


def _join_features(a: str, b: str, hyphen: str, count) -> list[str]:
    joined, compound = count(a + b), count(f"{a}-{b}")
    known = "j" if joined > compound else "c" if compound else "n"
    return [f"H{hyphen}", f"V{known}", f"W{known}{hyphen}", f"P{bool(count(a) and count(b))}{known}", f"S{a[-2:]}-", f"T-{b[:2]}", f"L{min(len(b), 4)}{known}"]


def damage_word(word: str, rng: random.Random, rate: float, confusions: list[tuple[str, str]] = CONFUSIONS, other: str | None = None) -> list[tuple[str, str]]:
    """(character as read, operation that undoes it) of a damaged word.

    Beside confusions at the given rate one character may be lost, doubled or
    changed at random (other is "lose", "double" or "change"). The list ends
    with an empty character, before which a lost last one is inserted.
    """
    out: list[tuple[str, str]] = []
    at = rng.randrange(len(word)) if other else -1
    lost = ""
    for i, ch in enumerate(word):
        if i == at and other == "lose":
            lost = ch
            continue
        if i == at:
            out += [(ch, "K"), (ch, "D")] if other == "double" else [(rng.choice("abcdefghijklmnopqrstuvwxyz".replace(ch, "")), "R" + ch)]
            continue
        if lost:
            out.append((ch, "I" + lost))
            lost = ""
            continue
        options = [read for true, read in confusions if true == ch]
        if options and rng.random() < rate:
            read = rng.choice(options)
            out.append((read[0], "R" + ch))
            out += [(x, "D") for x in read[1:]]
        else:
            out.append((ch, "K"))
    return [*out, ("", "I" + lost if lost else "K")]


def _frequent(vocabulary: dict[str, int], confusions: list[tuple[str, str]]) -> list[str]:
    """The most frequent plain words, TRAIN_WORDS at most, without those that a confusion explains."""
    found = []
    for w, _ in sorted(vocabulary.items(), key=lambda x: (-x[1], x[0])):
        if len(w) > 2 and _LOWER.match(w) and not _explained(w, vocabulary, confusions):
            found.append(w)
            if len(found) == TRAIN_WORDS:
                break
    return found


def learn_confusions(vocabulary: dict[str, int]) -> list[tuple[str, str]]:
    """(printed, read) of one letter read as one or two characters, that the corpus shows beyond the known ones.

    A pair counts once for each frequent word that has a rare form with it;
    real words that happen to differ so are few for any one pair.
    """
    words = [w for w in _frequent(vocabulary, CONFUSIONS) if vocabulary[w] >= OTHER_FILES and len(w) > 3]
    known = set(words)
    holes: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    could: Counter[str] = Counter()
    for w in words:
        could.update(set(w))
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append((w, w[i]))
    shown: dict[tuple[str, str], set[str]] = defaultdict(set)
    for form, n in vocabulary.items():
        if len(form) < 4 or form in known or _explained(form, vocabulary, CONFUSIONS):
            continue
        for size in (1, 2):
            for i in range(len(form) - size + 1):
                read = form[i : i + size]
                for w, true in holes.get((form[:i], form[i + size :]), ()):
                    # a pair that begins or ends with the letter itself is an inserted character, not a reading of it
                    if true not in (read[0], read[-1]) and vocabulary[w] >= TIMES * n:
                        shown[true, read].add(w)
    return sorted(pair for pair, by in shown.items() if len(by) >= max(CONFUSED_WORDS, CONFUSED_SHARE * could[pair[0]]) and pair not in CONFUSIONS)


def train_editor(vocabulary: dict[str, int], confusions: list[tuple[str, str]] = CONFUSIONS) -> Perceptron:
    """The character editor, from the most frequent plain words and compounds of the vocabulary."""
    rng = random.Random(17)
    words = _frequent(vocabulary, confusions)
    compounds = sorted((w for w in vocabulary if w.count("-") == 1 and vocabulary[w] >= LEAST_FILES), key=lambda w: (-vocabulary[w], w))[:TRAIN_WORDS]
    model = Perceptron()
    for _ in range(ROUNDS):
        rng.shuffle(words)
        for w in words:
            other = rng.choice(("lose", "double", "change")) if len(w) >= OTHER_LENGTH and rng.random() < 0.3 else None
            made = damage_word(w, rng, rng.choice((0.0, 0.15, 0.3)), confusions, other)
            read = "".join(ch for ch, _ in made)
            for i, (_, op) in enumerate(made):
                model.learn(_char_features(read, i), op)
            if len(w) > 5:
                at = rng.randrange(2, len(w) - 2)
                model.learn(_join_features(w[:at], w[at:], rng.choice("--‐\xad¬"), lambda x: vocabulary.get(x, 0)), "J")
        for w in compounds:
            a, b = w.split("-")
            model.learn(_join_features(a, b, "-", lambda x: vocabulary.get(x, 0)), "K")
    model.finish()
    # how much better than keeping an edit must score: what all but a few of newly damaged words reach
    margins = []
    for w in words:
        if len(w) >= OTHER_LENGTH:
            made = damage_word(w, rng, 0.0, confusions, rng.choice(("lose", "double", "change")))
            read = "".join(ch for ch, _ in made)
            for i, (_, op) in enumerate(made):
                if op != "K":
                    scores = model.scores(_char_features(read, i))
                    margins.append(scores.get(op, 0.0) - scores["K"])
    model.least = sorted(margins)[int(MISSED * len(margins))] if margins else 0.0
    return model


def _explained(word: str, vocabulary: dict[str, int], confusions: list[tuple[str, str]]) -> bool:
    """Whether one confusion undone gives a far more frequent word."""
    n = vocabulary.get(word, 0)
    for true, read in confusions:
        at = word.find(read)
        while at >= 0:
            if vocabulary.get(word[:at] + true + word[at + len(read) :], 0) >= max(LEAST_FILES, TIMES * n):
                return True
            at = word.find(read, at + 1)
    return False


class _Memo(dict):
    """What a function makes of a token, remembered."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        made = self.make(token)
        if len(self) > 300_000:
            self.clear()
        self[token] = made
        return made


class Editor:
    """The trained perceptron with the vocabulary that its proposals are held against.

    both gives for a token what undoing confusions makes of it, and what one
    edit that no confusion explains makes of it where that does nothing. Only
    lower-case words that the corpus's vocabulary lacks are edited so, into
    ones of OTHER_FILES files or more: names are rare by nature.
    """

    def __init__(self, model: Perceptron, vocabulary: dict[str, int], confusions: list[tuple[str, str]] = CONFUSIONS):
        self.model, self.vocabulary, self.confusions = model, vocabulary, confusions
        self._start()

    def _start(self) -> None:
        self.most = max(self.vocabulary.values(), default=0)
        self.alike = alike(self.confusions)
        self.forms = {w.translate(self.alike) for w, n in self.vocabulary.items() if n >= LEAST_FILES}
        # frequent words by what is left of them without one character: two words are one edit apart only if these meet
        self.near: dict[str, list[str]] = defaultdict(list)
        for w, n in self.vocabulary.items():
            if n >= OTHER_FILES and len(w) >= OTHER_LENGTH and _LOWER.match(w):
                for x in {w, *_left_out(w)}:
                    self.near[x].append(w)
        self.longest = max(map(len, self.near), default=0) + 1

        def make(token: str) -> tuple[str, str]:
            made = self._confused(token)
            return made, made if made != token or not _LOWER.match(token) else self._other(token)

        self.both = _Memo(make).__getitem__

    def __getstate__(self):
        return {"model": self.model, "vocabulary": self.vocabulary, "confusions": self.confusions}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def correct(self, token: str) -> str:
        return self.both(token)[0]

    def mend(self, token: str) -> str:
        return self.both(token)[1]

    def count(self, word: str) -> int:
        return self.vocabulary.get(word.lower(), 0)

    def _confused(self, token: str) -> str:
        """What was printed, by confusions undone, or the token itself."""
        if len(token) < 3 or not any(c.isalpha() for c in token):
            return token
        low = token.lower()
        need = max(LEAST_FILES, TIMES * self.vocabulary.get(low, 0))
        if need > self.most or low.translate(self.alike) not in self.forms:
            return token  # no word of the vocabulary could have been read so
        # beam over the operations of each character, best sums of scores first
        beam: list[tuple[float, str]] = [(0.0, "")]
        for i, ch in enumerate(low):
            grown: dict[str, float] = {}
            for op, s in self.model.scores(_char_features(low, i)).items():
                if op == "K":
                    add = ch
                elif op == "D" and self._may_drop(low, i):
                    add = ""
                elif op[0] == "R" and self._may_read(op[1:], low, i):
                    add = op[1:]
                else:
                    continue
                for total, made in beam:
                    key = made + add
                    if grown.get(key, -1e18) < total + s:
                        grown[key] = total + s
            beam = sorted(((s, m) for m, s in grown.items()), reverse=True)[: BEAM * 4]
        for _, made in beam:
            if len(made) > 2 and made != low and self.vocabulary.get(made, 0) >= need:
                return made.upper() if token.isupper() else made.capitalize() if token[:1].isupper() else made
        return token

    def _other(self, low: str) -> str:
        """The frequent word one edit away that the perceptron finds likeliest, if as likely as damaged words are; else the token itself."""
        if not OTHER_LENGTH <= len(low) <= self.longest or low in self.vocabulary:
            return low
        best = (self.model.least, 0, low)
        for word in {w for x in {low, *_left_out(low)} for w in self.near.get(x, ())}:
            at, op = _single_edit(low, word)
            if op:
                scores = self.model.scores(_char_features(low, at))
                best = max(best, (scores.get(op, 0.0) - scores["K"], self.vocabulary[word], word))
        return best[2]

    def _may_read(self, true: str, low: str, i: int) -> bool:
        return any(t == true and low.startswith(r, i) for t, r in self.confusions)

    def _may_drop(self, low: str, i: int) -> bool:
        return i > 0 and any(len(r) == 2 and low.startswith(r, i - 1) for _, r in self.confusions)

    def joins(self, a: str, hyphen: str, b: str) -> bool:
        """Whether a word broken at a line end is one word without its hyphen."""
        if not a or not b or not b[:1].islower() and not a.isupper():
            return False
        return any(self.model.best(_join_features(x.lower(), y.lower(), hyphen, self.count)) == "J" for x, y in {(a, b), (self.correct(a), self.correct(b))})


def _single_edit(read: str, true: str) -> tuple[int, str]:
    """Where and by which one operation read becomes true; an empty operation if by none."""
    at = next((i for i, (a, b) in enumerate(zip(read, true)) if a != b), min(len(read), len(true)))
    if len(true) == len(read) + 1 and read[at:] == true[at + 1 :]:
        return at, "I" + true[at]
    if len(true) == len(read) - 1 and read[at + 1 :] == true[at:]:
        return at, "D"
    if len(true) == len(read) and at < len(read) and read[at + 1 :] == true[at + 1 :]:
        return at, "R" + true[at]
    return at, ""


def _left_out(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


# ---- page furniture ---------------------------------------------------------

_RULE = r"[-–—~·•*\s]*"
_ALONE = re.compile(rf"({_RULE})((?:page|pg|p)\.?\s*)?(\d{{1,4}})(\s*(?:of|/)\s*\d{{1,4}})?({_RULE})", re.I)
_BRACKETED = re.compile(r"[\[(<{]\s*(\d{1,4})\s*[\])>}]")
_LEADING, _TRAILING = re.compile(r"(\d{1,4})\s{2,}(\S.*)"), re.compile(r"(.*\S)\s{2,}(\d{1,4})")
_NO_HEADER = tuple("<\\{|`#*=-•[(&$\"'~_")


def skeleton(line: str, table: dict[int, str] = _ALIKE) -> str:
    """A line with everything scanners confuse made alike."""
    return " ".join(line.lower().split()).translate(table)


def _chain(found: list[tuple[int, int]], apart: int = PAGE_LINES) -> list[int]:
    """The longest run of lines whose numbers go up by one, so many lines apart at least."""
    best: list[int] = []
    ends: dict[int, tuple[int, list[int]]] = {}
    for line, value in found:
        prior = ends.get(value - 1)
        run = [*prior[1], line] if prior and line - prior[0] >= apart else [line]
        if value not in ends or len(run) >= len(ends[value][1]):
            ends[value] = (line, run)
        if len(run) > len(best):
            best = run
    return best


def _looks_running(text: str, times: int) -> bool:
    """Whether a repeated line can be a running title, name or notice."""
    words = text.split()
    if len(words) < 2 or len(text) > 90 or text.startswith(_NO_HEADER):
        return False
    if text.endswith((".", ",", ";", ":", "}", ">", "|", "`")) and not text.lower().endswith(("...", "al.", "a1.")):
        return False
    if not (text[0].isupper() or text[0].isdigit() or text[0] in "†¢|ä"):
        return False
    letters = sum(c.isalpha() or c in "†¢|" for c in text)
    if letters < 0.6 * len(text.replace(" ", "")):
        return False
    if len(text) < 22:
        return all(w[:1].isupper() or w[:1].isdigit() or w[:1] in "†¢|ä" or w in ("et", "al.", "of", "and", "the", "for", "in") for w in words)
    return True


def page_lines(text: str) -> tuple[list[str], list[int] | None]:
    """Lines of a text, and the number of each one's page where form feeds part them; None without any.

    A line at a page's edge, one of the first or last EDGE_LINES with words,
    has its page's number, from 1; others have 0.
    """
    pages = [page.split("\n") for page in text.split("\x0c")]
    lines = [x for page in pages for x in page]
    if len(pages) < 2:
        return lines, None
    edges: list[int] = []
    for number, page in enumerate(pages, 1):
        worded = [i for i, x in enumerate(page) if x.strip()]
        at_edge = set(worded[:EDGE_LINES] + worded[-EDGE_LINES:])
        edges += [number if i in at_edge else 0 for i in range(len(page))]
    return lines, edges


def furniture(lines: list[str], edges: list[int] | None = None, table: dict[int, str] = _ALIKE) -> tuple[set[int], set[int]]:
    """Line numbers of running headers, and of lines with page numbers.

    With edges, a line that comes again at the edges of two pages or more, and
    hardly anywhere else, is a header whatever it says; without, or elsewhere,
    it must look like one and come a page apart.
    """
    alone: dict[str, list[tuple[int, int]]] = defaultdict(list)
    groups: dict[str, list[tuple[int, str]]] = defaultdict(list)
    numbers: dict[int, int] = {}
    for i, raw in enumerate(lines):
        s = raw.strip()
        if not s:
            continue
        m = _ALONE.fullmatch(s)
        if m:
            style = "bare" if s == m[3] else "styled"
            alone[style].append((i, int(m[3])))
            continue
        m = _BRACKETED.fullmatch(s)
        if m:
            alone["bracketed"].append((i, int(m[1])))
            continue
        for pattern, number, rest in ((_LEADING, 1, 2), (_TRAILING, 2, 1)):
            m = pattern.fullmatch(s)
            if m:
                numbers[i], s = int(m[number]), m[rest].strip()
                break
        groups[skeleton(s, table)].append((i, s))
    pages: set[int] = set()
    for style, least in (("styled", 2), ("bare", 3), ("bracketed", 3)):
        if edges:
            run = _chain([x for x in alone[style] if edges[x[0]]], 1)
            if len(run) >= 2:
                pages.update(run)
        run = _chain(alone[style], PAGE_LINES + 2 if style == "bracketed" else PAGE_LINES)
        if len(run) >= least:
            pages.update(run)
            # numbers of the same style that a lost page parted from the run
            if style == "styled":
                pages.update(i for i, _ in alone[style])
    headers: set[int] = set()
    for found in groups.values():
        at = [i for i, _ in found]
        if len(at) < 2:
            continue
        if edges:
            on = [edges[i] for i in at if edges[i]]
            if len(set(on)) > 1 and len(on) >= AT_EDGE * len(at) and any(c.isalpha() for c in found[0][1]):
                headers.update(i for i in at if edges[i])
                continue
        if not any(_looks_running(s, len(at)) for _, s in found):
            continue
        gaps = sorted(b - a for a, b in zip(at, at[1:]))
        if gaps[len(gaps) // 2] >= PAGE_LINES:
            headers.update(at)
    numbered = [(i, numbers[i]) for i in sorted(headers) if i in numbers]
    if len(_chain(numbered)) >= 2:
        pages.update(i for i, _ in numbered)
    return headers, pages


# ---- repair -----------------------------------------------------------------

_ITEM = re.compile(r"\s*(?:[-•*]\s|\(?\d{1,3}[.)]\s|\[\d+\]|#|\||```|\\begin|\\end|\\item)")
#: A numbered heading, or a word that is one, alone on its line.
_HEADING = re.compile(r"(?:\d{1,2}(?:\.\d{1,2})*\.?\s+[A-Z][^.!?]{0,60}|Abstract|Acknowledg\w+|Appendix|Conclusions?|References|Bibliography)\Z")


def repair(text: str, editor: Editor) -> tuple[list[str], str]:
    """Kinds of damage found, and the text in continuous paragraphs."""
    lines, edges = page_lines(text)
    headers, pages = furniture(lines, edges, editor.alike)
    body = [x for i, x in enumerate(lines) if i not in headers and i not in pages]
    found = {"header"} if headers else set()
    if pages:
        found.add("page_no")
    misread, both = 0, editor.both
    paragraphs: list[str] = []
    current = ""
    longest = max((len(x) for x in body), default=0)
    after_break = False
    for n, raw in enumerate(body):
        line = raw
        for read, true in LIGATURES:
            if read in line:
                line = line.replace(read, true)
        fixed = []
        last = 0
        # the two parts of a word broken at a line end are no words of their own
        cut = len(line.rstrip()) - 1 if line.rstrip()[-1:] in HYPHENS else len(line)
        first = after_break
        for m in _TOKEN.finditer(line):
            token = m[0]
            made, mended = both(token)
            if made != token:
                misread += 1
            elif mended != token and not first and m.end() < cut:
                made = mended
            first = False
            if made != token:
                fixed += [line[last : m.start()], made]
                last = m.end()
        if line.strip():
            after_break = cut < len(line)
        line = "".join(fixed) + line[last:] if fixed else line
        if not line.strip():
            # a blank line within a sentence is where furniture stood
            if current and not (current[-1:].islower() or _BROKEN.search(current[-TAIL:])):
                paragraphs.append(current)
                current = ""
            continue
        if current:
            broken = _BROKEN.search(current[-TAIL:]) if current.rstrip(" \t")[-1:] in HYPHENS else None
            start = _HEAD_WORD.match(line)
            if broken and start and editor.joins(broken[1], broken[2], start[1]):
                found.add("hyphen")
                current = current.rstrip(" \t")[:-1] + line.strip()
                continue
            if broken and broken[2] == "-" and start:
                current = current.rstrip() + line.strip()
                continue
            if _HEADING.match(current) or _ITEM.match(line) or line[:1].isspace() or current[-1:] in ".!?:" and len(body[n - 1]) < 0.6 * longest:
                paragraphs.append(current)
                current = line.strip()
            else:
                current += " " + line.strip()
        else:
            current = line.strip()
    if current:
        paragraphs.append(current)
    if misread >= LEAST_MISREAD:
        found.add("misread")
    return sorted(found), "\n\n".join(paragraphs)


def count_words(df: DataFrame, text: str) -> DataFrame:
    """(word, files): in how many rows each word stands, words broken at line ends left out; of the empty word how many rows there are."""
    broken = re.compile(rf"\S+[-{SOFT_HYPHENS}][ \t]*\n\s*\S+")

    def run(batches):
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "files"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update({w for w in _TOKEN.findall(broken.sub(" ", t).lower()) if len(w) > 1} | {""})
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        yield out()

    parts = df.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(run, "word string, files bigint")
    return parts.groupBy("word").agg(F.sum("files").alias("files"))


def fit_editor(df: DataFrame, text: str) -> Editor:
    counts = cut_lineage(count_words(df, text))
    files = (counts.filter("word = ''").first() or {"files": 0})["files"]
    known = counts.filter((F.col("files") >= max(LEAST_FILES, files // KNOWN_SHARE)) & (F.col("word") != ""))
    vocabulary = {r["word"]: r["files"] for r in known.collect()}  # bounded by KNOWN_SHARE
    confusions = CONFUSIONS + learn_confusions(vocabulary)
    return Editor(train_editor(vocabulary, confusions), vocabulary, confusions)


def repair_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, damage, repaired) of each row: the sorted kinds of damage found and the repaired text.

    A null text gives no damage and null, an empty one no damage and an empty
    text. Rows repeated stay; other columns are dropped.
    """
    editor = df.sparkSession.sparkContext.broadcast(fit_editor(df, text))

    def run(batches):
        mine = editor.value
        for batch in batches:
            made = [([], None) if t is None else repair(t, mine) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d for d, _ in made], pa.list_(pa.string())), pa.array([t for _, t in made], pa.string())], ["key", "damage", "repaired"]
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, damage array<string>, repaired string").withColumnRenamed("key", key)


#: Files whose text only the papers have that are broadcast at most, about 20 MB of names.
MISSING_FILES = 200_000


def page_texts(texts: DataFrame, papers: DataFrame) -> DataFrame:
    """(file_path, text): each page text once, from arxiv_text_parquet and, where it differs or is missing there, from raw_text; a stored table.

    Which texts are missing is told by hashes; of the papers' texts only the
    missing ones are moved.
    """
    both = lambda df, c: df.select("file_path", F.col(c).alias("text"), F.xxhash64(c).alias("h")).filter("text is not null")
    ours, theirs = both(texts, "text"), both(papers, "raw_text")
    missing = cut_lineage(theirs.select("file_path", "h").distinct().join(ours.select("file_path", "h"), ["file_path", "h"], "left_anti"))
    n = missing.limit(MISSING_FILES + 1).count()
    if n:
        ours = ours.unionByName(theirs.join(F.broadcast(missing) if n <= MISSING_FILES else missing, ["file_path", "h"], "left_semi"))
    # a file written twice is one
    return cut_lineage(ours.groupBy("file_path", "h").agg(F.first("text").alias("text")).select("file_path", "text"))
