r"""Operator 5: personal data by a linear-chain conditional random field over word-shape features.

Base patterns (email, ip, card, phone) are found first, leftmost and non-overlapping by kind, and always stay. A conditional random
field adds what no pattern has: local phone numbers, identity numbers, addresses spelled with (at), secrets (keys, tokens, passwords), names and
streets. It tags words by shape, digits, neighbours and cue words, and what it tags is a span; no pattern overrules it. It is trained on the driver
from labelled_lines(), some hundred short lines that a seeded rule makes from TEMPLATES, and is broadcast with each query.

Every word of a text is scored, and the text is one chain whose ends border on the outside tag. The outside tag is certain for a word where it
beats each other tag by more than any two neighbours' transitions could make up for; such words part the chain without changing the best tags, and
what lies between them goes through Viterbi, stretches of equal length together in numpy.

Defined cases: a null or empty text has no spans. Texts of any length are read whole, and the patterns are written so that they
take time in proportion to the text. Repeated rows are judged alike, whatever their ids; null ids stay null. An empty table gives an empty
result. Extra columns, whatever their names, pass through redact(); column names are taken as Spark takes them, without regard to case.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import reserve, table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("local_phone", "national_id", "spelled_email", "secret", "name", "street")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
OUTSIDE = "O"
TAGS = (OUTSIDE, *(f"{p}-{k}" for k in ADDED_KINDS for p in "BI"))

# The lookbehinds only skip starts inside a run of digits, where a match would have begun at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
#: Words beside which personal data often stands.
CUES = (
    "tel telephone phone mobile fax dial call number ssn id identity passport social security tax mail email write contact reach token password passwd pwd pass secret key apikey api_key "
    "access_token bearer credential mr mrs ms dr prof herr frau monsieur madame señor señora name named signed regards sincerely dear street avenue road lane drive straße strasse rue calle via address lives"
).split()
CUE_SET = frozenset(CUES)
MARK = re.compile(r"[0-9@]|[\[(]at[\])]|(?<![^\W_])(?:" + "|".join(sorted(CUES, key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)
#: Words that are scored at once.
BLOCK = 65_536
WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Grown outwards from each at sign, so that long runs cost no more than their length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Labelled lines: a slot {kind} is filled by FILLERS[kind] and is a span of that kind; {w}, {W} and {n} are plain words, capitals and numbers.
TEMPLATES = """
call me on {local_phone} after {w}
tel {local_phone} or {w}
phone: {local_phone}, {w} {w}
{w} {w} {local_phone} {w}
mobile {local_phone}.
ssn {national_id} on {w}
social security number {national_id}
his id is {national_id}, see {w}
{w} tax id {national_id} {w} {w}
{w} {national_id} {w}
mail {spelled_email} soon
write to {spelled_email}, {w}
{w} {spelled_email} {w} {w}
{w} {w} token = {secret} {w} {w}
token = {secret} {W} {w}
{w} token: {secret}
password: {secret} {w}
the password is {secret} and {w}
{secret} {w} {w}
{w} {w} {secret} {w} {w}
api_key = {secret} {w}
secret {secret} {w} {w}
key: {secret}
bearer {secret}
{w} Mr. {name} {w} {w}
{w} {w} Mrs. {name}, {w} {w}
Dr. {name} {w} {w}
{w} Herr {name} {w}
Madame {name} {w} {w}
name: {name}, {w}
signed {name}.
dear {name}, {w} {w}
regards {name}
{w} lives at {street}, {w} {w}
address: {street}
{w} {w} {street} {w} {w}
{w} {street}.
version {n} was {w}
in {n} and {n} {w}
{w} {n} {w} {w} {n} {w}
{n} {w} {w}
{W} {w} {n}
{n} {W} {w} {w}
{n} {n} {n} {n} {n}
{w} {w} {n} {w}
{w} {n}, {w} {w} {n}. {W} {w}
{w} {w} key {w} {w} {w}
a token of {w} {w} {w}
the street {w} {w} {w} {w}
{w} {w} street {w} {w}. {W} {w}
the name {w} {w} {w}
{w} number {w} {w} {n} {w}
the secret {w} {w}. {W} {w}
{w} call {w} {w} {w}
my password {w} {w} {w} {w}
{W} {w} via {w} {w}
id {w} {w}. {W} {w} {w}
{w} {w} st {w} {w} {W} {w}
st. {W} {w} {w} {w}
rue {w} {w} {w}
write {w} {w} {W} {w} {w}
{w} {w}. {W}. {W} {w} {w}
{W}. {W}. {W}. {W}. {W}.
{W} {W} {W} {W} {W} {w}
{w}. {W} {w}. {W} {w}. {W}. {W} {w}
{w} {W} {W} {W}, {W} {n} {w}
{w} {w} {W} {W}, {W} {n}.
{w} {W} {n}. {W} {w}
{W} {n}. {n} {W}. {w}
{w} {W}. {W} {W}. {w} {w} {W}, {W} {w}
{W}. {n}. {W} {W} {w} {W}
"""
#: Parts of names and streets.
FIRST = "Anna John Maria Peter Laura James Sofia Thomas Julia Robert Elena Michael Clara David Nina Paul Emma Lukas Ines Carlos".split()
LAST = "Keller Smith Moreau Garcia Fischer Brown Lopez Martin Weber Johnson Dubois Schneider Taylor Romero Wagner Wilson Bernard Novak Miller Rossi".split()
ROADS = "Street Avenue Road Lane Drive St. Ave. Rd.".split()
FOREIGN_ROADS = ("Hauptstraße {}", "Lindenstraße {}", "rue Pasteur {}", "calle Mayor {}", "via Roma {}")


def filler(rng: np.random.Generator) -> dict[str, Callable[[], str]]:
    """Makes the text of a slot, by kind."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    chars = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    word = lambda: "".join(pick("th an er on re in le ou ge ch at en de la es or ti is al st éa mé ü ña".split()) for _ in range(int(rng.integers(1, 5))))
    shaped = lambda form: re.sub("9", lambda m: digits(1), form)
    hexes, mixed = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    noise = lambda: pick(("", "", "", "!!", "***", "###", "%%%", "$$$", "&&&"))

    def number() -> str:
        forms = ("9.", "99.", "9.9.", "999", "9", "99", "9999", "9:99", "99:99", "9999-99-99", "99.99.9999", "99/99/9999", "9,999.99", "99%", "$99", "99-99", "9999-9999", "9.9.9", "999.999.999.999", "99.9.99.99", "9999999999", "9999999999999999",
                 "9999 9999 9999 9999", "+9 (999) 999-9999", "9)", "(9)", "a9", "A99-B99", "9th", "@aaa", "aaa.99@aaaa9.example.com", "99x99", "999-9", "#9", "v9.9.9", "978-9-99-999999-9")
        return shaped(pick(forms)).replace("aaaa", word()).replace("aaa", word()) + noise()

    def secret() -> str:
        value = pick((lambda: chars(hexes, 40), lambda: chars(hexes, 32), lambda: chars(mixed, int(rng.integers(16, 44))), lambda: "AKIA" + chars("ABCDEFGHJKLMNPQRSTUVWXYZ234567", 16), lambda: "ghp_" + chars(mixed, 36), lambda: "sk-" + chars(mixed, 32), lambda: chars(mixed, 9) + pick("!$#") + digits(2)))()
        return pick((lambda v: v, lambda v: f'"{v}"', lambda v: f"'{v}'", lambda v: f"password={v}", lambda v: f"token={v}", lambda v: f"api_key={v}"))(value) + noise()

    return {
        "w": lambda: word() + pick(("", "", "", ",", "'", noise())), "W": lambda: word().capitalize(), "n": number, "secret": secret,
        "local_phone": lambda: shaped(pick(("999-999-9999", "(999) 999-9999", "999.999.9999", "099 9999 9999", "09999 999999", "(0)99 9999 9999", "099-9999-9999", "999 999 9999"))),
        "national_id": lambda: shaped("999-99-9999"), "spelled_email": lambda: f"{word()}{pick(('', '.', '_'))}{word()}{pick(('(at)', '[at]'))}{word()}.{pick(('org', 'com', 'net', 'de'))}",
        "name": lambda: f"{pick(FIRST) if rng.random() < 0.6 else word().capitalize()} {pick(LAST) if rng.random() < 0.6 else word().capitalize()}",
        "street": lambda: f"{digits(int(rng.integers(1, 4)))} {word().capitalize()} {pick(ROADS)}" if rng.random() < 0.7 else pick(FOREIGN_ROADS).format(digits(2)),
    }


def labelled_lines(seed: int, turns: int = 8) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Each template `turns` times: text and its spans (kind, start, end)."""
    make, out = filler(np.random.default_rng(seed)), []
    for line in TEMPLATES.strip().split("\n"):
        for _ in range(turns):
            text, marks = "", []
            for part in re.split(r"(\{\w+\})", line):
                kind = part[1:-1] if part.startswith("{") else ""
                body = make[kind]() if kind else part
                if kind in ADDED_KINDS:
                    marks.append((kind, len(text), len(text) + len(body)))
                text += body
            out.append((text, marks))
    return out


def shape(word: str) -> str:
    """Digits as 9, letters as a or A; runs of letters count once and digits singly up to five."""
    s = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", re.sub(r"[^\x00-\x7F]+", "u", word[:80]))))
    return re.sub(r"9{6,}", "9+", s)[:24]


EDGES = ".,;:!?'\"<>*#%$&"


@lru_cache(maxsize=100_000)
def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(EDGES)
    digits, letters = sum(map(str.isdigit, core)), sum(map(str.isalpha, core))
    turns = len(re.findall(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", core[:80]))
    return (
        "bias", f"shape={shape(core)}", f"digits={min(digits, 12)},{letters > 0}", f"dash={min(core.count('-'), 4)},{min(core.count('.'), 4)}", f"paren={'(' in core}{')' in core}",
        f"at={'(at)' in core or '[at]' in core},{'@' in core}", f"mixed={min(turns, 4)},{min(len(core) // 8, 4)}", f"own={cue(word)}", f"capital={core[:1].isupper()},{core[1:].islower()},{digits > 0}", f"equals={'=' in core},{'_' in core}",
        f"quoted={word[:1] in chr(34) + chr(39)}", f"stop={word[-1:] in '.,;:!?'}",
    )


@lru_cache(maxsize=100_000)
def cue(word: str) -> str:
    """The cue word that this is, else nothing."""
    core = word.strip(".,;:!?'\"=()").lower()[:16]
    return core if core in CUE_SET else "=" if word == "=" else ""


def kind_of(word: str) -> str:
    return "9" if any(map(str.isdigit, word)) else "A" if word[:1].isupper() else "a"


def run_features(words: list[str]) -> list[tuple[str, ...]]:
    """Features of the words of a chain; as many for each."""
    out, n = [], len(words)
    at = lambda i: words[i] if 0 <= i < n else ""
    for i, w in enumerate(words):
        own, last, later = word_features(w), at(i - 1), at(i + 1)
        out.append((*own, f"prev={shape(last.strip(EDGES))}", f"next={shape(later.strip(EDGES))}", f"around={kind_of(last)}{kind_of(w)}{kind_of(later)}", f"cue={cue(last)}", f"cue2={cue(at(i - 2))},{cue(last)}", f"cuekind={cue(last) or cue(at(i - 2))},{kind_of(w)}", f"cue_next={cue(later)},{kind_of(w)}", f"last_stop={last[-1:] in '.!?' and last[-1:] != ''}"))
    return out


def runs_of(text: str) -> Iterator[list[tuple[int, int]]]:
    """The chain of a text: the places of all its words."""
    run = [m.span() for m in WORD.finditer(text)]
    if run:
        yield run


ALIKE = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "9")})
KINDS_OF_WORDS, CUE_WORDS = ("a", "A", "9"), ("", "=", *sorted(set(CUES)))
CUE_INDEX = {c: i for i, c in enumerate(CUE_WORDS)}


class WordScores:
    """Scores of whole texts by tables: what run_features gives depends on the word, on either neighbour and on their kinds and cues.

    Words that differ only in their letters or digits have equal features and share a row, but for cue words and (at).
    """

    def __init__(self, features: dict[str, int], emit: np.ndarray):
        none = np.zeros(emit.shape[1])
        self.of = lambda *fs: sum((emit[features[f]] for f in fs if f in features), none)
        table = lambda form, *axes: np.array([self.of(form(*x)) for x in product(*axes)]).reshape(*map(len, axes), -1)
        self.around = table(lambda a, b, c: f"around={a}{b}{c}", *[KINDS_OF_WORDS] * 3)
        self.cue2 = table(lambda a, b: f"cue2={a},{b}", CUE_WORDS, CUE_WORDS)
        self.cuekind = table(lambda c, k: f"cuekind={c},{k}", CUE_WORDS, KINDS_OF_WORDS)
        self.cue_next = table(lambda c, k: f"cue_next={c},{k}", CUE_WORDS, KINDS_OF_WORDS)
        self.forget()

    def forget(self) -> None:
        self.words, self.rows = {}, {}
        self.own, self.before, self.after, self.kind, self.cue = [], [], [], [], []
        self.packed = None
        self.row("")

    def row(self, word: str) -> int:
        own = cue(word)
        like = word if own or "(at)" in word or "[at]" in word else word.translate(ALIKE)
        found = self.rows.get(like)
        if found is None:
            found = self.rows[like] = len(self.rows)
            self.own.append(self.of(*word_features(like)))
            self.before.append(self.of(f"prev={shape(like.strip(EDGES))}", f"cue={own}", f"last_stop={like[-1:] in '.!?' and like[-1:] != ''}"))
            self.after.append(self.of(f"next={shape(like.strip(EDGES))}"))
            self.kind.append(KINDS_OF_WORDS.index(kind_of(like)))
            self.cue.append(CUE_INDEX[own])
        if len(word) <= 64:
            self.words[word] = found
        return found

    def ids(self, text: str) -> list[int]:
        get, row = self.words.get, self.row
        return [get(w) or row(w) for w in text.split()]

    def scores(self, ids: np.ndarray, start: int, end: int) -> np.ndarray:
        """Of the words at start to end (without it); ids has two empty words before and one after those."""
        if self.packed is None or len(self.packed[0]) < len(self.rows):
            self.packed = [np.array(x) for x in (self.own, self.before, self.after, self.kind, self.cue)]
        own, before, after, kind, cues = self.packed
        word, last, earlier, later = ids[start:end], ids[start - 1 : end - 1], ids[start - 2 : end - 2], ids[start + 1 : end + 1]
        k, c = kind[word], cues[last]
        out = own[word] + before[last]
        out += after[later]
        out += self.around[kind[last], k, kind[later]]
        out += self.cue2[cues[earlier], c]
        out += self.cuekind[np.where(c > 0, c, cues[earlier]), k]
        out += self.cue_next[cues[later], k]
        return out


class ChainField:
    """Emission weights by feature, transition weights by tag pair; the outside borders each run."""

    def __init__(self, features: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.features, self.emit, self.move = features, emit, move
        self.known: dict[tuple[str, ...], np.ndarray] = {}
        self.tables: WordScores | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "tables": None}

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """The best tags of all words of every text."""
        if self.tables is None:
            self.tables = WordScores(self.features, self.emit)
        elif len(self.tables.words) > 400_000 or len(self.tables.rows) > 50_000:
            self.tables.forget()
        flat, ends = [0, 0], []
        for t in texts:
            flat += self.tables.ids(t)
            ends.append(len(flat))
            flat += [0, 0]
        ids = np.array(flat)
        tags = self.tag_words(ids)
        starts = [2, *(e + 2 for e in ends[:-1])]
        return [tags[s:e] for s, e in zip(starts, ends, strict=True)]

    def tag_words(self, ids: np.ndarray) -> np.ndarray:
        """Tags by place; texts are parted by two empty words (0). A stretch of words in doubt that a block would cut goes to the next block."""
        gain = (self.move - self.move[:, :1]).max(0) + (self.move - self.move[:1]).max(1)
        tags, at, size = np.zeros(len(ids), np.int16), 2, BLOCK
        while at < len(ids) - 1:
            end = min(at + size, len(ids) - 1)
            s = self.tables.scores(ids, at, end)
            doubt = ((s - s[:, :1] + gain)[:, 1:] >= 0).any(1) & (ids[at:end] != 0)
            if end < len(ids) - 1 and doubt[-1]:
                sure = np.flatnonzero(~doubt)
                if not len(sure):
                    size *= 2
                    continue
                end = at + int(sure[-1]) + 1
                doubt = doubt[: end - at]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], doubt.astype(np.int8), [0]])))
            first, lengths = edges[::2], edges[1::2] - edges[::2]
            for n in np.unique(lengths):
                those, step = first[lengths == n], max(1, 20_000 // int(n))
                for i in range(0, len(those), step):
                    places = those[i : i + step, None] + np.arange(n)
                    tags[at + places] = self.viterbi(s[places])
            at, size = end, BLOCK
        return tags

    def emissions(self, features: tuple[str, ...]) -> np.ndarray:
        found = self.known.get(features)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[features] = self.emit[[self.features[f] for f in features if f in self.features]].sum(0)
        return found

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags for runs of one length: scores (runs, words, tags) to (runs, words)."""
        n, length, tags = scores.shape
        best, back = scores[:, 0] + self.move[0], np.empty((n, length, tags), np.int16)
        for t in range(1, length):
            steps = best[:, :, None] + self.move
            back[:, t] = steps.argmax(1)
            best = steps.max(1) + scores[:, t]
        out = np.empty((n, length), np.int16)
        out[:, -1] = (best + self.move[:, 0]).argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out

    def decode(self, runs: list[list[tuple[str, ...]]]) -> list[np.ndarray]:
        """Tags of every run; runs of one length together, in blocks of bounded size."""
        out: list = [None] * len(runs)
        by_length = defaultdict(list)
        for i, r in enumerate(runs):
            by_length[len(r)].append(i)
        for length, those in by_length.items():
            step = max(1, 200_000 // length)
            for k in range(0, len(those), step):
                part = those[k : k + step]
                tags = self.viterbi(np.array([[self.emissions(f) for f in runs[i]] for i in part]))
                for i, t in zip(part, tags, strict=True):
                    out[i] = t
        return out


def tagged_runs(lines: list[tuple[str, list[tuple[str, int, int]]]]) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """The chains of labelled lines, as features and tags."""
    out = []
    for text, marks in lines:
        for run in runs_of(text):
            tags = []
            for s, e in run:
                kind = next((m for m in marks if m[1] < e and s < m[2]), None)
                tags.append(TAGS.index(f"{'B' if s <= kind[1] else 'I'}-{kind[0]}") if kind else 0)
            out.append((run_features([text[s:e] for s, e in run]), tags))
    return out


@lru_cache(maxsize=1)
def trained(seed: int = 5, rounds: int = 120, rate: float = 0.3, ridge: float = 0.02) -> ChainField:
    """Maximum conditional likelihood with a ridge, by AdaGrad over all chains, those of one length together; the seed makes the lines."""
    data = tagged_runs(labelled_lines(seed))
    features = {f: i for i, f in enumerate(sorted({f for run, _ in data for fs in run for f in fs}))}
    k, by = len(TAGS), defaultdict(list)
    for run, tags in data:
        by[len(run)].append(([[features[f] for f in fs] for fs in run], tags))
    groups = [(np.array([x for x, _ in g]), np.array([t for _, t in g])) for g in by.values()]
    emit, move = np.zeros((len(features), k)), np.zeros((k, k))
    seen_e, seen_m = np.full(emit.shape, 1e-6), np.full(move.shape, 1e-6)

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis)
        return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))

    for _ in range(rounds):
        ge, gm = ridge * emit, ridge * move
        for at, tags in groups:
            n, length, _ = at.shape
            s, rows = emit[at].sum(2), np.arange(n)
            fwd, bwd = np.empty((n, length, k)), np.empty((n, length, k))
            fwd[:, 0], bwd[:, -1] = s[:, 0] + move[0], move[:, 0]
            for t in range(1, length):
                fwd[:, t] = total(fwd[:, t - 1, :, None] + move, 1) + s[:, t]
            for t in range(length - 2, -1, -1):
                bwd[:, t] = total(move + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            z = total(fwd[:, -1] + move[:, 0], 1)
            p = np.exp(fwd + bwd - z[:, None, None])
            np.subtract.at(p, (rows[:, None], np.arange(length)[None], tags), 1)
            np.add.at(ge, at.reshape(n * length, -1), p.reshape(n * length, 1, k))
            gm[0] += p[:, 0].sum(0)
            gm[:, 0] += p[:, -1].sum(0)
            for t in range(1, length):
                q = np.exp(fwd[:, t - 1, :, None] + move + (s[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
                np.subtract.at(q, (rows, tags[:, t - 1], tags[:, t]), 1)
                gm += q.sum(0)
        seen_e += ge * ge
        seen_m += gm * gm
        emit -= rate * ge / np.sqrt(seen_e)
        move -= rate * gm / np.sqrt(seen_m)
    return ChainField(features, emit, move)


def tagged_spans(text: str, places: list[tuple[int, int]], tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Spans of a decoded chain, without the marks around them."""
    names = [TAGS[t] for t in tags]
    i = 0
    while i < len(names):
        mark, _, kind = names[i].partition("-")
        j = i + 1
        while j < len(names) and names[j] == f"I-{kind}":
            j += 1
        if mark != OUTSIDE:
            s, e = places[i][0], places[j - 1][1]
            body = text[s:e]
            s += len(body) - len(body.lstrip(EDGES))
            body = body.strip(EDGES)
            if body:
                yield kind, s, s + len(body)
        i = j


def all_spans(texts: list[str], field: ChainField) -> list[list[tuple[str, int, int]]]:
    """Base spans of each text and those that the field adds clear of them, by kind and start."""
    out, i = [base_spans(t) if t and MARK.search(t) else [] for t in texts], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and size < 8 * BLOCK:
            size, j = size + len(texts[j]), j + 1
        for k, tags in enumerate(field.tag(texts[i:j]), i):
            if tags.any():
                places, marked = next(runs_of(texts[k])), np.concatenate([[0], tags > 0, [0]]).astype(np.int8)
                edges, base = np.flatnonzero(np.diff(marked)), list(out[k])
                for s, e in zip(edges[::2], edges[1::2], strict=True):
                    own = [b for b in base if b[1] < places[e - 1][1] and places[s][0] < b[2]]
                    out[k] += [x for x in tagged_spans(texts[k], places[s:e], tags[s:e]) if not any(b[1] < x[2] and x[1] < b[2] for b in own)]
        i = j
    rank = {k: n for n, k in enumerate(KINDS)}
    return [sorted(spans, key=lambda x: (rank[x[0]], x[1])) for spans in out]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_batches(batches: Iterator[pd.DataFrame], field: ChainField) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t if isinstance(t, str) else "" for t in batch["text"]]
        found = all_spans(texts, field)
        base = [[x for x in spans if x[0] in BASE_KINDS] for spans in found]
        out = {"doc_id": batch["doc_id"]} | {f"n_{k}": [sum(x[0] == k for x in spans) for spans in base] for k in BASE_KINDS}
        yield pd.DataFrame(out | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(s) for s in found]})


def find(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as kind:start:end."""
    rows = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(trained())
    return rows.mapInPandas(lambda batches: find_batches(batches, shared.value), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's place taken by its kind; of overlapping spans the union goes, under the first kind."""
    out, done, open_ = [], 0, None
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if open_ and s < open_[2]:
            open_ = (open_[0], open_[1], max(open_[2], e))
            continue
        if open_:
            out += [text[done : open_[1]], f"<{open_[0]}>"]
            done = open_[2]
        open_ = (kind, s, e)
    if open_:
        out += [text[done : open_[1]], f"<{open_[0]}>"]
        done = open_[2]
    return "".join(out) + text[done:]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of its text masked; rows and columns as they were, null texts stay null."""

    shared = df.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def masked(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = shared.value
        for batch in series:
            texts = [t if isinstance(t, str) else "" for t in batch]
            yield pd.Series([mask(t, s) if isinstance(own, str) else None for own, t, s in zip(batch, texts, all_spans(texts, field), strict=True)], dtype=object)

    n = reserve(df, "masked")
    own = df.withColumn(n["masked"], masked(F.col(f"`{text}`").cast("string")))
    return own.select(*((F.col(n["masked"]).alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns))


def op5_chain_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
