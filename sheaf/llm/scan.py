"""Repair of text from scanned pages: page furniture, hyphenated words and misread characters.

Two averaged perceptrons.  The first marks page furniture by page-position features (place between page ends, repeats,
likeness to the title, shape of the line).  The second is a character editor that predicts keep, replace, delete or
insert at characters and keep, cut, join or space at line ends.  Their labels come from the data: the two renderings of a page
are aligned, a line that only one of them has is furniture, and where the renderings differ in a few characters the
form whose character trigrams are the commoner is right.  Both are trained on ``train_pages`` pages, a documented
bound, taken in the order of a hash of their identifiers; all pages are then repaired by them.

Edge cases: null and empty texts give no row and are not trained on; a page with one rendering is repaired alike; long
pages are read whole; repeated rows give one row; without any page with two renderings nothing is edited but what the
seed rules for page numbers mark as furniture.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources.tables import spread, table

HYPHENS = "-­‐¬"
END = "。！？.!?:：；;”)）"
HAN = re.compile("[㐀-鿿]")
PAGE = re.compile(r"[-·\s(（]*(?:第\s*[\dlIoO一二三四五六七八九十]+\s*页(?:\s*共\s*[\dlIoO一二三四五六七八九十]+\s*页)?|(?:p\.?|page)\s*[\dlIoO]+(?:\s*of\s*[\dlIoO]+)?|[\dlIoO]{1,3}(?:\s*/\s*[\dlIoO]{1,3})?)[-·\s)）]*\.?\s*", re.I)


class Perceptron:
    """Averaged perceptron over string features; the first label is the default."""

    def __init__(self, labels: tuple[str, ...] = ("K",)):
        self.default = labels[0]
        self.w: dict[str, dict[str, float]] = {}

    def score(self, feats: list[str]) -> dict[str, float]:
        s: dict[str, float] = {}
        get = self.w.get
        for f in feats:
            row = get(f)
            if row:
                for label, x in row.items():
                    s[label] = s[label] + x if label in s else x
        return s

    def predict(self, feats: list[str]) -> str:
        """The best label; ties go to the default, then to the smaller."""
        s = self.score(feats)
        best, top = self.default, s.get(self.default, 0.0)
        for label, x in s.items():
            if x > top or (x == top and best != self.default and label < best):
                best, top = label, x
        return best

    def train(self, data: list[tuple[list[str], str]], rounds: int = 6) -> Perceptron:
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = defaultdict(int)
        t = 0
        for r in range(rounds):
            # A fixed stride visits the examples in another order each round.
            n = len(data)
            step = next((p for p in (7919, 104729, 1299709, 15485863, 32452843, 49979687)[r % 6 :] if n % p), 1)
            for k in range(n):
                feats, gold = data[(k * step) % n]
                t += 1
                guess = self.predict(feats)
                if guess == gold:
                    continue
                for f in feats:
                    for label, d in ((gold, 1.0), (guess, -1.0)):
                        row = self.w.setdefault(f, {})
                        total[f, label] += (t - stamp[f, label]) * row.get(label, 0.0)
                        stamp[f, label] = t
                        row[label] = row.get(label, 0.0) + d
        for f, row in self.w.items():
            for label in row:
                total[f, label] += (t - stamp[f, label]) * row[label]
                row[label] = round(total[f, label] / max(1, t), 4)
        self.w = {f: kept for f, row in self.w.items() if (kept := {a: x for a, x in row.items() if x})}
        return self


def squeeze(text: str) -> str:
    return "".join(text.split())


def line_key(line: str) -> str:
    return re.sub(r"[\d\s.]+", "", line)


def bigrams(text: str) -> set[str]:
    t = squeeze(text).lower()
    return {t[i : i + 2] for i in range(len(t) - 1)}


def likeness(a: set[str], b: set[str]) -> float:
    """Share of the bigrams of the smaller set that the larger has."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return len(small & large) / len(small) if small else 0.0


def title_likeness(bare: str, grams: set[str]) -> float:
    """``likeness`` of a squeezed line to the title's bigrams, mostly without the line's own set."""
    low = bare.lower()
    shared = sum(g in low for g in grams)
    if not shared:
        return 0.0
    size = len(grams) if len(set(low)) > len(grams) else min(len(grams), len({low[i : i + 2] for i in range(len(low) - 1)}))
    return shared / size


def shape(line: str) -> str:
    s = re.sub(r"\d+", "9", line.strip())
    s = re.sub("[一二三四五六七八九十]+", "一", s)
    s = re.sub(r"[㐀-䶿丁七-三上下与-九二五八六十四-鿿]{3,}", "字", s)
    return re.sub(r"[A-Za-zÀ-ɏ'3015]{2,}( [A-Za-zÀ-ɏ'3015]{2,})*", "w", s)[:24]


STOP = re.compile("[，。；,;]")


class Lines:
    """The lines of a page with what their features need, each computed when first asked for."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.bare = [x.strip() for x in lines]
        full = [i for i, x in enumerate(self.bare) if x]
        self.first = full[0] if full else 0
        title = self.bare[self.first].lstrip("# ").strip() if lines else ""
        self.grams, self.size = bigrams(title), len(squeeze(title))
        lengths = sorted(len(lines[i]) for i in full)
        self.wide = lengths[len(lengths) * 3 // 4] if lengths else 1
        #: Every line but blank ones and the title at the very top may be furniture.
        self.open = [i for i in full if i != self.first]
        self.numbers = {i for i in self.open if len(lines[i]) < 30 and PAGE.fullmatch(self.bare[i])}
        self.before = dict(zip(full[1:], full))
        self.last = len(lines) - 1

    @cached_property
    def keys(self) -> Counter:
        return Counter(line_key(self.lines[i]) for i in self.open)

    def keys_of(self, i: int, stop: bool) -> Iterator[tuple]:
        """What each group of a line's page-position features depends on, cheap groups first; ``spelt`` spells them out.

        ``stop`` tells whether the line has punctuation of running text."""
        lines, bare_lines, text = self.lines, self.bare, self.bare[i]
        end = text[-1]
        above = self.before.get(i)
        rel = min(5, len(text) * 5 // (self.wide or 1))
        yield (
            i in self.numbers, stop, min(12, len(text)), rel, "x" if end.isalnum() else end,
            not bare_lines[i - 1], i < self.last and not bare_lines[i + 1], i == self.last, i == self.first + 1, above is not None and bare_lines[above][-1] not in END,
        )
        bare = "".join(text.split())
        near = not self.numbers.isdisjoint((i - 2, i - 1, i + 1, i + 2)) if self.numbers else False
        like = int(title_likeness(bare, self.grams) * 5) if len(bare) > 2 else 0
        yield like, max(-3, min(3, (len(bare) - self.size) // 4)), rel, stop, near
        yield ("", "", near, stop) if stop else (bare[-4:], bare[:2], near, stop)  # running text ends in anything
        yield min(3, self.keys[line_key(lines[i])]), min(9, len(bare) // 3), stop
        yield (shape(text),)


def spelt(group: int, key: tuple) -> list[str]:
    """The features of one group."""
    if group == 0:
        page, stop, size, rel, end, blank, after, last, second, cut = key
        return [
            "bias", f"page{page}stop{stop}", f"stop{stop}len{size}", f"stop{stop}rel{rel}", f"page{page}len{size}", f"end={end}stop{stop}",
            f"blankbefore{blank}", f"blankafter{after}", f"last{last}", f"second{second}", f"cut{cut}stop{stop}", f"before{blank}after{after}stop{stop}rel{rel}",
        ]
    if group == 1:
        like, extra, rel, stop, near = key
        return [f"like{like}", f"like{like}extra{extra}", f"like{like}rel{rel}", f"like{like}stop{stop}", f"near{near}like{like}"]
    if group == 2:
        tail, head, near, stop = key
        return [f"near{near}stop{stop}"] if stop else [f"tail={tail[-2:]}", f"tail4={tail}", f"head={head}", f"near{near}stop{stop}"]
    if group == 3:
        again, short, stop = key
        return [f"repeat{again}stop{stop}", f"repeat{again}len{short}"]
    return [f"shape={key[0]}"]


def line_features(lines: list[str]) -> list[list[str] | None]:
    """All features of each line; None for blank lines and the title at the very top."""
    page = Lines(lines)
    out: list[list[str] | None] = [None] * len(lines)
    for i in page.open:
        out[i] = [f for group, key in enumerate(page.keys_of(i, STOP.search(page.bare[i]) is not None)) for f in spelt(group, key)]
    return out


class FurnitureModel:
    """The furniture perceptron with what its later feature groups can add at most.

    A line is given up as soon as these can't make it furniture any more: the same answer as with all features."""

    def __init__(self, w: dict[str, dict[str, float]], most: int = 200_000):
        self.gain = {f: row.get("F", 0.0) - row.get("K", 0.0) for f, row in w.items()}
        best: dict[str, float] = defaultdict(float)
        for f, x in self.gain.items():
            kind = kind_of(f)
            best[kind] = max(best[kind], x)
        self.rest = {}
        for stop, line in ((False, "y"), (True, "y，y")):
            sums = [sum(best[kind_of(f)] for f in spelt(g, key)) for g, key in enumerate(Lines(["x", line]).keys_of(1, stop))]
            self.rest[stop] = [sum(sums[k + 1 :]) for k in range(len(sums))]
        self.memo: list[dict[tuple, float]] = [{} for _ in range(5)]
        self.most = most

    def is_furniture(self, page: Lines, i: int) -> bool:
        stop = STOP.search(page.bare[i]) is not None
        total = 0.0
        for group, (key, memo, rest) in enumerate(zip(page.keys_of(i, stop), self.memo, self.rest[stop])):
            part = memo.get(key)
            if part is None:
                if len(memo) > self.most:
                    memo.clear()
                part = memo[key] = sum(self.gain.get(f, 0.0) for f in spelt(group, key))
            total += part
            if total + rest <= 1e-9:
                return False
        return total > 1e-9


def kind_of(feature: str) -> str:
    """Which of a line's features this is, without its values."""
    return FEATURE_VALUE.sub("", feature.partition("=")[0])


FEATURE_VALUE = re.compile(r"True|False|-?\d+$|(?<=page)-?\d+|(?<=like)\d|(?<=repeat)\d")



def line_labels(lines: list[str], other: str) -> list[str | None]:
    """'F' for lines the other rendering lacks, 'K' for those it has, None where that can't be told."""
    head = bigrams(next((x for x in lines if x.strip()), "").lstrip("# "))
    rest = "\n".join(x for x in other.split("\n") if not (len(x) < 60 and likeness(bigrams(x), head) > 0.75))
    body = squeeze(re.sub(f"[{HYPHENS}]\n", "", rest))
    grams = {body[i : i + 5] for i in range(len(body) - 4)}
    out: list[str | None] = []
    for line in lines:
        s = squeeze(line.rstrip(HYPHENS))
        if not s:
            out.append(None)
        elif PAGE.fullmatch(line.strip()) and not re.search(r"\d{4}", s):
            out.append("F")
        elif len(s) < 8:
            out.append("K" if s in body or s[-1] in "。.；，" else "F" if len(s) > 3 and s[:3] not in body else None)
        else:
            q = [s[i : i + 5] for i in range(len(s) - 4)]
            share = sum(g in grams for g in q) / len(q)
            out.append("K" if share > 0.5 else "F" if share < 0.12 else None)
    return out


def body_of(lines: list[str], furniture: set[int]) -> tuple[str, list[int], list[str]]:
    """(squeezed text, line of each character, whitespace before each character) of the lines that are no furniture."""
    text: list[str] = []
    where: list[int] = []
    gap: list[str] = []
    pending = ""
    for n, line in enumerate(lines):
        if n in furniture:
            continue
        body = line
        if n == next((i for i, x in enumerate(lines) if x.strip()), 0):
            body = line.lstrip("# ")
        for c in body:
            if c.isspace():
                pending += c
            else:
                text.append(c)
                where.append(n)
                gap.append(pending)
                pending = ""
        pending += "\n"
    return "".join(text), where, gap


def align(a: str, b: str, most: int = 3, far: int = 40) -> list[tuple[int, int, int, int]]:
    """Differences (a from, a to, b from, b to) of two nearly equal texts, by resynchronising after each."""
    out, i, j = [], 0, 0
    moves = sorted(((x, y) for x in range(most + 1) for y in range(most + 1) if x + y), key=lambda m: (sum(m), abs(m[0] - m[1])))
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for x, y in moves:
            tail = a[i + x : i + x + 5]
            if tail and tail == b[j + y : j + y + 5]:
                out.append((i, i + x, j, j + y))
                i, j = i + x, j + y
                break
        else:
            hit = None
            for s in range(2, far):
                for x, y in ((s, 0), (0, s), (s, s)):
                    if len(a[i + x : i + x + 8]) == 8 and a[i + x : i + x + 8] == b[j + y : j + y + 8]:
                        hit = (x, y)
                        break
                if hit:
                    break
            if not hit:
                break
            i, j = i + hit[0], j + hit[1]
    return out


class Lexicon:
    """Counts of character trigrams and words of the training pages."""

    def __init__(self):
        self.grams: Counter = Counter()
        self.words: Counter = Counter()

    def add(self, text: str, plain: str) -> None:
        self.grams.update(text[i : i + 3] for i in range(len(text) - 2))
        self.words.update(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9]+(?:-[A-Za-z]+)*", plain))

    def support(self, text: str, a: int, b: int) -> int:
        """The rarest trigram that touches the stretch."""
        return min((self.grams[text[k : k + 3]] for k in range(max(0, a - 2), max(a, b - 1) + 1) if k + 3 <= len(text)), default=0)


def kind(x: str) -> str:
    return "9" if x.isdigit() else "A" if "A" <= x <= "Z" else "a" if x.isascii() and x.isalpha() else "H" if HAN.match(x) else x


def han_features(window: str) -> list[str]:
    """Features of the middle of five characters ('^' where there is none)."""
    r, p, c, q, s = window
    return [f"c{c}", f"p{p}{c}", f"q{c}{q}", f"pq{p}{c}{q}", f"rp{r}{p}{c}", f"qs{c}{q}{s}", f"rpq{r}{p}{c}{q}", f"pqs{p}{c}{q}{s}", f"k{kind(p)}{c}{kind(q)}", "bias"]


def token_features(before: str, token: str, after: str, k: int, words: dict[str, int]) -> list[str]:
    """Features of a character of a run of Latin letters and digits; Han neighbours of the run count, others don't."""
    padded = "^^" + token + "^^"
    r, p, c, q, s = padded[k : k + 5]
    f = han_features(padded[k : k + 5])
    known = min(3, words.get(token.lower(), 0) // 3)
    f += [f"kk{kind(r)}{kind(p)}{c}{kind(q)}{kind(s)}", f"w{token.lower()}@{k}", f"known{known}", f"known{known}c{c}", f"known{known}{p}{c}", f"known{known}{c}{q}", f"known{known}cap{token[0].isupper()}c{c}", f"b{before}{kind(p)}{c}", f"a{c}{kind(q)}{after}", f"ba{bool(before)}{bool(after)}{'9' if token[0].isdigit() else 'a'}{c}"]
    return f


def in_token(c: str) -> bool:
    return c == "!" or (c.isascii() and c.isalnum())


def char_features(text: str, i: int, words: dict[str, int], gap: list[str]) -> list[str]:
    """Features of a character of a squeezed text, as in training."""
    if not in_token(text[i]):
        return han_features("".join(text[k] if 0 <= k < len(text) else "^" for k in range(i - 2, i + 3)))
    a, b = i, i + 1
    while a > 0 and in_token(text[a - 1]) and not gap[a]:
        a -= 1
    while b < len(text) and in_token(text[b]) and not gap[b]:
        b += 1
    han = lambda k: text[k] if 0 <= k < len(text) and HAN.match(text[k]) else ""
    return token_features(han(a - 1), text[a:b], han(b), i - a, words)


def break_features(text: str, i: int, gap: list[str], lines_wide: int, words: dict[str, int]) -> list[str]:
    """Features of the line end before character ``i``."""
    p, c = text[i - 1], text[i]
    a = i - 1
    while a > 0 and (text[a - 1].isalnum()) and text[a - 1].isascii() and not gap[a]:
        a -= 1
    b = i
    while b < len(text) and text[b].isalnum() and text[b].isascii() and (b == i or not gap[b]):
        b += 1
    left, right = text[a : i - 1] if p in HYPHENS else text[a:i], text[i:b]
    blank = gap[i].count("\n") > 1
    f = ["break", f"blank{blank}", f"p{p}" if not p.isalnum() else "px", f"pend{p in END}blank{blank}", f"han{bool(HAN.match(p))}{bool(HAN.match(c))}", f"ascii{p.isascii()}{c.isascii()}blank{blank}"]
    if p in HYPHENS:
        whole = (left + right).lower()
        known = lambda w: min(2, words.get(w.lower(), 0))
        f = ["hyphen", f"mark{p}", f"whole{known(whole)}", f"dash{known(left + '-' + right)}", f"l{known(left)}r{known(right)}", f"whole{known(whole)}l{known(left)}r{known(right)}", f"left={left.lower()}", f"right={right.lower()}", f"pair={left.lower()}-{right.lower()}"]
    return f


def learn(pages: list[tuple[str, str]], kept_places: int = 600, least_seen: int = 2) -> dict:
    """Train both perceptrons on pages with two renderings; the model is a plain dictionary.

    The editor learns from every misread place and, of each character that was ever misread, from ``kept_places`` places
    where it was not; characters misread fewer than ``least_seen`` times on the training pages are never edited."""
    lines_data = []
    for x, y in pages:
        for text, other in ((x, y), (y, x)):
            lines = text.split("\n")
            for f, label in zip(line_features(lines), line_labels(lines, other)):
                if f and label:
                    lines_data.append((f, label))
    furniture = Perceptron(("K", "F")).train(lines_data, 5)
    judge = FurnitureModel(furniture.w)
    lexicon, bodies = Lexicon(), []
    for x, y in pages:
        pair = []
        for text in (x, y):
            lines = text.split("\n")
            out = furniture_lines(judge, lines)
            body = body_of(lines, out)
            lexicon.add(body[0], " ".join(v for n, v in enumerate(lines) if n not in out))
            pair.append(body)
        bodies.append(pair)
    data, breaks, wrong, suspects, met = [], [], Counter(), defaultdict(list), Counter()
    for pair in bodies:
        for (a, wa, ga), (b, _, gb) in (pair, pair[::-1]):
            at = j = 0
            edits = {}
            same: list[tuple[int, int]] = []
            for i0, i1, j0, j1 in [*align(a, b), (len(a), len(a), len(b), len(b))]:
                same += [(i, j + i - at) for i in range(at, i0) if j + i - at < j0 and a[i] == b[j + i - at]]
                at, j = i1, j1
                if i0 == len(a):
                    break
                x, y = a[i0:i1], b[j0:j1]
                if x and x in HYPHENS and not y and i1 < len(a) and "\n" in ga[i1]:
                    edits[i0] = ("hyphen", i1)
                    continue
                if not x and y and y in HYPHENS:
                    continue
                mine, theirs = lexicon.support(a, i0, i1), lexicon.support(b, j0, j1)
                edits[i0] = ("edit", i1, x, y) if theirs >= 3 * mine + 3 else ("unknown",)
            matched = dict(same)
            for i, e in edits.items():
                if e[0] == "hyphen":
                    breaks.append((break_features(a, e[1], ga, 0, lexicon.words), "CUT"))
                elif e[0] == "edit":
                    x, y = e[2], e[3]
                    if not x:
                        data.append((a, i, ga, f"I:{y}"))
                        wrong[a[i]] += 1
                        continue
                    data.append((a, i, ga, f"R:{y}" if y else "D"))
                    wrong[x[0]] += 1
                    for k in range(1, len(x)):
                        data.append((a, i + k, ga, "D"))
                        wrong[x[k]] += 1
            touched = set(edits)
            for i, jj in same:
                if i in touched:
                    continue
                kept, most = suspects[a[i]], kept_places
                met[a[i]] += 1
                if len(kept) < most:
                    kept.append((a, i, ga))
                elif met[a[i]] % 5 == 0:
                    kept[met[a[i]] // 5 % most] = (a, i, ga)
                if i and "\n" in ga[i] and jj and matched.get(i - 1) == jj - 1:
                    if a[i - 1] in HYPHENS:
                        if "\n" not in gb[jj]:
                            breaks.append((break_features(a, i, ga, 0, lexicon.words), "KEEP"))
                    elif "\n" not in gb[jj]:
                        breaks.append((break_features(a, i, ga, 0, lexicon.words), "SPACE" if gb[jj] else "JOIN"))
                    elif gb[jj].count("\n") > 1:
                        breaks.append((break_features(a, i, ga, 0, lexicon.words), "KEEP"))
    words = {w: n for w, n in lexicon.words.items() if n > 1}
    seen = Counter(c for c, n in wrong.items() for _ in range(n))
    examples = [(char_features(a, i, words, g), label) for a, i, g, label in data]
    for c in seen:
        # Kept places of every character that was ever misread.
        examples += [(char_features(a, i, words, g), "K") for a, i, g in suspects[c]]
    editor = Perceptron(("K",)).train(examples, 6)
    liner = Perceptron(("KEEP",)).train(breaks, 6)
    return {"furniture": furniture.w, "editor": editor.w, "breaks": liner.w, "words": words, "suspects": sorted(c for c, n in wrong.items() if n >= least_seen), "examples": len(examples), "lines": len(lines_data), "line_ends": len(breaks)}


def furniture_lines(model: FurnitureModel, lines: list[str]) -> set[int]:
    page = Lines(lines)
    return {i for i in page.open if model.is_furniture(page, i)}


#: Features that look two places off, without what stands there.
FAR = re.compile(r"rpq.(...)|rp.(..)|pqs(...).|qs(..).|kk.(...).", re.S)
TOKEN = re.compile("[A-Za-z0-9!]+")
_BLANK = re.compile(r"\s+")


class Repairer:
    """Applies a model to pages.  Decisions are kept by what they depend on: a token, or a window of five characters."""

    def __init__(self, model: dict, most: int = 300_000):
        self.editor, self.breaks = Perceptron(("K",)), Perceptron(("KEEP",))
        self.editor.w, self.breaks.w = model["editor"], model["breaks"]
        self.furniture = FurnitureModel(model["furniture"]) if model["furniture"] else None
        self.words, self.most = model["words"], most
        self.suspects = set(model["suspects"])
        han = "".join(c for c in model["suspects"] if not in_token(c))
        self.han = re.compile("[" + re.escape(han) + "]") if han else None
        self.latin = re.compile("[" + re.escape("".join(c for c in model["suspects"] if in_token(c))) + "]") if self.suspects - set(han) else None
        self.operations = sorted({o for row in self.editor.w.values() for o in row} - {"K"})
        self.memo: dict = {}

    def remember(self, key, value):
        if len(self.memo) > self.most:
            self.memo.clear()
        self.memo[key] = value
        return value

    def flow(self, text: str) -> tuple[list[int], list[int], str, list[int]]:
        """(furniture lines, kept lines, their text, where each begins in it)."""
        lines = text.split("\n")
        if self.furniture:
            out = furniture_lines(self.furniture, lines)
        else:
            out = {i for i, x in enumerate(lines) if i and PAGE.fullmatch(x.strip() or "x")}
        kept = [i for i in range(len(lines)) if i not in out]
        first = next((i for i in kept if lines[i].strip()), -1)
        parts = [lines[i] if i != first else lines[i].lstrip("# ") for i in kept]
        starts, at = [], 0
        for x in parts:
            starts.append(at)
            at += len(x) + 1
        return sorted(out), kept, "\n".join(parts), starts

    def edits(self, flow: str) -> list[tuple[int, str]]:
        """(place, operation) of the characters to change."""
        found, memo = [], self.memo
        if self.han:
            for m in self.han.finditer(flow):
                i = m.start()
                window = flow[i - 2 : i + 3]
                if i < 2 or len(window) < 5 or "\n" in window or " " in window:
                    left, right = _BLANK.sub("", flow[max(0, i - 12) : i]), _BLANK.sub("", flow[i + 1 : i + 13])
                    window = ("^^" + left)[-2:] + flow[i] + (right + "^^")[:2]
                op = memo.get(window)
                if op is None:
                    op = self.remember(window, self.editor.predict(han_features(window)))
                if op != "K":
                    found.append((i, op))
        if self.latin:
            for m in TOKEN.finditer(flow):
                token = m.group()
                a, b = m.span()
                before = flow[a - 1] if a and flow[a - 1] > "\u33ff" else ""
                after = flow[b] if b < len(flow) and flow[b] > "\u33ff" else ""
                key = (before, token, after)
                ops = memo.get(key)
                if ops is None:
                    before, after = before if HAN.match(before) else "", after if HAN.match(after) else ""
                    ops = tuple((k, op) for k, c in enumerate(token) if c in self.suspects for op in (self.token_edit(before, token, after, k),) if op != "K")
                    self.remember(key, ops)
                if ops and not personal(flow, a, b):
                    if flow[b : b + 1] in HYPHENS and flow[b + 1 : b + 2] == "\n" or flow[a - 2 : a - 1] in HYPHENS and flow[a - 1 : a] == "\n":
                        ops = [(k, op) for k, op in ops if not token[k].isalpha()]  # half a word says little
                    found += [(a + k, op) for k, op in ops]
        return sorted(found)

    def token_edit(self, before: str, token: str, after: str, k: int) -> str:
        """The operation on a token's character; tokens the training pages lack differ by what stands around it only."""
        low = token.lower()
        if f"w{low}@{k}" in self.editor.w or token.isalpha():
            return self.editor.predict(token_features(before, token, after, k, self.words))
        known = min(3, self.words.get(low, 0) // 3)
        p, c, q = ("^" + token + "^")[k : k + 3]
        if before and f"b{before}{kind(p)}{c}" not in self.editor.w:
            before = "\0"  # some Han character the model knows nothing of
        if after and f"a{c}{kind(q)}{after}" not in self.editor.w:
            after = "\0"
        if (token.isdigit() or token[0].isupper() and token[1:].isdigit()) and self.kept_digit(before, token, after, k, known):
            return "K"
        key = (("^^" + token + "^^")[k : k + 5], before, after, token[0].isupper(), token[0].isdigit(), known)
        op = self.memo.get(key)
        return op if op is not None else self.remember(key, self.editor.predict(token_features(before, token, after, k, self.words)))

    def kept_digit(self, before: str, token: str, after: str, k: int, known: int) -> bool:
        """Whether a character of a number or code stays whatever stands two places off: its other features can't outweigh this.

        ``token`` has no feature of its own in the model.  Decided once for its neighbours and the number's surroundings."""
        p, c, q = ("^" + token + "^")[k : k + 3]
        key = (p, c, q, before, after, token[0].isupper(), known)
        kept = self.memo.get(key)
        if kept is not None:
            return kept
        feats = token_features(before, token, after, k, self.words)
        far = [f for f in feats if f[:2] in ("rp", "qs", "kk") or f.startswith("pqs")]
        score = self.editor.score([f for f in feats if f not in far])
        most: dict[str, float] = defaultdict(float)
        for group in (("rp", p + c), ("rpq", p + c + q), ("qs", c + q), ("pqs", p + c + q), ("kk", f"{kind(p)}{c}{kind(q)}")):
            for o, x in self.far.get(group, {}).items():
                most[o] += x
        return self.remember(key, all(score.get(o, 0.0) - score.get("K", 0.0) + most[o] <= 0 for o in self.operations))

    @cached_property
    def far(self) -> dict[tuple[str, str], dict[str, float]]:
        """For each group of features that differ in what stands two places off: the most one can favour an operation."""
        out: dict[tuple[str, str], dict[str, float]] = {}
        for f, row in self.editor.w.items():
            m = FAR.fullmatch(f)
            if not m:
                continue
            group = ("rpq", m[1]) if m[1] else ("rp", m[2]) if m[2] else ("pqs", m[3]) if m[3] else ("qs", m[4]) if m[4] else ("kk", m[5])
            best = out.setdefault(group, {})
            for o in self.operations:
                best[o] = max(best.get(o, 0.0), row.get(o, 0.0) - row.get("K", 0.0))
        return out

    def line_end(self, flow: str, i: int) -> tuple[str, bool]:
        """(operation, whether a word may be cut there) at the line break at place ``i``."""
        left = flow[max(0, i - 40) : i].rstrip()
        right = flow[i : i + 40]
        gap = re.match(r"\s*", right).group()
        right = right[len(gap) :]
        if not left or not right:
            return "KEEP", False
        body = left + right
        gaps = [""] * len(body)
        gaps[len(left)] = gap
        for k, c in enumerate(body):
            if c.isspace() and k + 1 < len(body):
                gaps[k + 1] = gaps[k + 1] or " "
        cut = left[-1] in HYPHENS and len(left) > 1 and left[-2].isalpha() and bool(re.match("[A-Za-z]", right))
        return self.breaks.predict(break_features(body, len(left), gaps, 0, self.words)), cut

    def noise(self, text: str) -> list[tuple[int, str]]:
        """Noisy lines (from 1) with their kind."""
        out, kept, flow, starts = self.flow(text)
        found = {(kept[bisect_right(starts, i) - 1] + 1, "misread") for i, _ in self.edits(flow)}
        for k in range(len(starts) - 1):
            end = starts[k + 1] - 1
            if end > 1 and flow[end - 1] in HYPHENS:
                op, cut = self.line_end(flow, end)
                if cut and op == "CUT":
                    found.add((kept[k] + 1, "hyphen"))
        return [(n + 1, "furniture") for n in out] + sorted(found)

    def repaired(self, text: str) -> str:
        """The text without furniture, with words and lines joined and characters put right."""
        _, _, flow, starts = self.flow(text)
        ops = dict(self.edits(flow))
        parts: list[str] = []
        i = 0
        title_end = flow.find("\n")
        while i < len(flow):
            c = flow[i]
            if c == "\n":
                gap = re.match(r"\s*", flow[i:]).group()
                op, cut = self.line_end(flow, i)
                if i == title_end or (gap.count("\n") > 1 and op not in ("JOIN", "SPACE") and not cut):
                    parts.append("\n\n")
                elif cut:
                    if op == "CUT" and parts and parts[-1] in HYPHENS:
                        parts.pop()
                elif op == "SPACE":
                    parts.append(" ")
                elif op != "JOIN":
                    parts.append("\n")
                i += len(gap)
                continue
            op = ops.get(i, "K")
            parts.append(c if op == "K" else "" if op == "D" else op[2:] + (c if op[0] == "I" else ""))
            i += 1
        return "".join(parts).strip()


def personal(flow: str, a: int, b: int) -> bool:
    """Whether the token at [a, b) is part of a mail address or an unknown proper name: these are never edited."""
    around = flow[max(0, a - 1) : b + 2]
    if re.search(r"[@#＠_]|\[at\]|\(at\)", flow[max(0, a - 14) : b + 14]) and re.search(r"[@#＠_.\-(\[]", around):
        return True
    before = re.search(r"[A-Z][a-z]{2,}\s$", flow[max(0, a - 12) : a])
    return bool(before and re.match(r"[A-Z][a-z]{7,}", flow[a:b]))


def train_model(pages: DataFrame, train_pages: int = 600) -> dict:
    """Learn from at most ``train_pages`` pages with two renderings, by the order of a hash of the page's key."""
    both = pages.where("length(raw_text) > 0 and length(markdown) > 0 and raw_text <> markdown")
    rows = both.orderBy(F.xxhash64("doc_id", "raw_text"), "doc_id").limit(train_pages).select("raw_text", "markdown").collect()
    return learn([(r.raw_text, r.markdown) for r in rows])


_OF_WORKER: dict[str, Repairer] = {}


def worker_repairer(name: str, shared) -> Repairer:
    """The repairer of a worker process, kept from task to task with what it has decided; only the last model's."""
    if name not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[name] = Repairer(shared.value)
    return _OF_WORKER[name]


def _with_model(texts: DataFrame, model: dict, ddl: str, name: str, f) -> DataFrame:
    """``texts`` with a column made by ``f(repairer, text)``; one repairer in each worker."""
    shared, mine = texts.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by train_pages

    def run(column: pd.Series) -> pd.Series:
        repairer = worker_repairer(mine, shared)
        return pd.Series([f(repairer, t) for t in column])

    return spread(texts).withColumn(name, F.pandas_udf(run, ddl).asNondeterministic()("text"))


def find_noise(texts: DataFrame, model: dict) -> DataFrame:
    """``texts`` with ``noise``: (line_no, kind)."""
    return _with_model(texts, model, "array<struct<line_no:int,kind:string>>", "noise", Repairer.noise)


def repair(texts: DataFrame, model: dict) -> DataFrame:
    """``texts`` with ``repaired``."""
    return _with_model(texts, model, "string", "repaired", Repairer.repaired)


def renderings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, folder, "pipeline_outputs").select("doc_id", "raw_text", "markdown")
    parts = [pages.select("doc_id", F.lit(c).alias("field_name"), F.col(c).alias("text")).where(F.length(c) > 0) for c in ("raw_text", "markdown")]
    return pages, parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with noise and its kind."""
    pages, texts = renderings(spark, folder)
    done = find_noise(texts, train_model(pages))
    return done.select("doc_id", "field_name", F.explode("noise").alias("n")).select("doc_id", "field_name", "n.line_no", "n.kind").distinct()


def p7_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired renderings."""
    pages, texts = renderings(spark, folder)
    return repair(texts, train_model(pages)).select("doc_id", "field_name", "repaired").distinct()
