"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The field is trained on the driver from the small labelled table below (a few hundred words: its size does not depend on the data),
by maximum likelihood with forward and backward sums in numpy. Words without a digit or an at sign are certain: their margin for "no
personal data" exceeds all that transitions can add, which is checked after training (else every word is decoded). A certain word cuts the chain, so Viterbi
decoding of the runs of other words between two certain ones gives exactly what decoding the whole text would give.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("none", *KINDS)

#: The labelled table: a word, and after a bar its kind if it is part of personal data.
LABELLED = """
write to ann.lee@mail.example.com|email for the notes
mail bob_77@post.example.org|email or call +44|phone 20|phone 7946|phone 0958|phone today
contact joe@localhost|email about page 12 of 40
send it to <kim@corp.example.net>|email before 2021
her address is mia+news@example.io|email and his is sam@intranet|email now
ask admin@host|email for access in 3 days
the server 10.0.0.12|ip answered in 45 ms
host 192.168.1.254|ip and host 172.16.0.1|ip are down
ping 8.8.8.8|ip then 1.1.1.1:53|ip twice
from 203.0.113.77:8080|ip at 10:45 on 2020-01-31
version 2.4.1 of the tool and version 10.2 of the other
paid with 4111|card 1111|card 1111|card 1111|card in May
card 5500|card 0000|card 0000|card 0004|card expires 12/27
number 4012888888881881|card was charged 30 times
his card 3782|card 822463|card 10005|card has 500 left
card: 6011-1111-1111-1117|card since 2019
call (212)|phone 555-0147|phone after 5 pm
phone 555-867-5309|phone or 415-555-2671|phone for Jenny
dial +1|phone (415)|phone 555-2671|phone and wait
reach me on +33|phone 1|phone 42|phone 68|phone 53|phone 00|phone at noon
fax 1-800-555-0199|phone until 31.12.2022
tel. (030)|phone 123456|phone or +49|phone 30|phone 123456|phone by day
my mobile is 07700|phone 900123|phone since 2018
in 1999 there were 365 days and 52 weeks
chapter 3 verse 16 has 27 words
it rose 4.5% to 1,250 points on 12-03-2020
room 101 is on floor 2 of block 7b
build 20231105 took 93s and used 512MB
the 1st and 2nd of 100 lines at 3.14 per unit
ids a1b2c3d4 and 9f86d081884c7d65 differ
order 48213 shipped 2020-05-06 for $19.99
the model x100 costs 1500 and weighs 20kg
see section 4.2.1 and table 5-3 on pages 10-12
a 5 by 7 grid of 35 cells with 2 or 3 marks
between 1914 and 1918 or 1939 and 1945
scores were 3-1 and 2-2 in 2006 and 2010
isbn 978-3-16-148410-0 was printed in 2007
token 1eb9c654e721b4f812088970e66a6345 is not a number
"""


def shape(word: str) -> str:
    """Letters as x or X, digits as d, runs of over four cut to four and a space, which no word holds; other characters stay."""
    s = re.sub(r"[0-9]", "d", re.sub(r"[A-Z]", "X", re.sub(r"[^\W\d_A-Z]", "x", word)))
    return re.sub(r"(.)\1{4,}", lambda m: m[1] * 4 + " ", s)


def features(word: str) -> list[str]:
    """What the field sees of a word; it depends on the whole shape and on the counts of digits and dots."""
    s, digits = shape(word), sum(c.isdigit() for c in word)
    if "@" not in word and not re.search("[0-9]", word):
        return ["any", "no digit"]
    out = ["any", f"shape={re.sub(r'[.,;:!?]+$', '', s)}", f"start={s[:2]}", f"dots={min(word.strip('.,').count('.'), 4)}", f"digits={min(digits, 17)}"]
    out += ["has " + name for name, ok in (("at", "@" in word[1:-1]), ("letters", "x" in s.lower()), ("plus", word[0] == "+"), ("bracket", word[0] == "(" and ")" in word), ("dash", "-" in word[1:-1]), ("only digits", digits == len(word))) if ok]
    return out


@dataclass
class Field:
    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    certain: bool

    def scores(self, word: str) -> np.ndarray:
        return self.emit[[self.index[f] for f in features(word) if f in self.index]].sum(axis=0)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(labelled: str = LABELLED, rounds: int = 250, ridge: tuple = (0.01, 0.3)) -> Field:
    """Maximise the likelihood of the labelled lines, each between two words without personal data."""
    lines = [[(w.partition("|")[0], TAGS.index(w.partition("|")[2] or "none")) for w in ["the", *line.split(), "the"]] for line in labelled.strip().split("\n")]
    index: dict[str, int] = {}
    for line in lines:
        for word, _ in line:
            for f in features(word):
                index.setdefault(f, len(index))
    n, most, k = len(lines), max(map(len, lines)), len(TAGS)
    on, tags, there = np.zeros((n, most, len(index))), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, line in enumerate(lines):
        for j, (word, tag) in enumerate(line):
            on[i, j, [index[f] for f in features(word)]] = 1
            tags[i, j], there[i, j] = tag, True
    gold = np.eye(k)[tags] * there[:, :, None]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    emit, move = np.zeros((len(index), k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (emit, emit, move, move)]
    for t in range(1, rounds + 1):
        e = on @ emit
        forward, back = np.zeros((most, n, k)), np.zeros((most, n, k))
        forward[0] = e[:, 0]
        for j in range(1, most):
            step = logsum(forward[j - 1][:, :, None] + move, 1) + e[:, j]
            forward[j] = np.where(there[:, j, None], step, forward[j - 1])
        for j in range(most - 2, -1, -1):
            step = logsum(move + (e[:, j + 1] + back[j + 1])[:, None, :], 2)
            back[j] = np.where(there[:, j + 1, None], step, back[j + 1])
        whole = logsum(forward[-1], 1)
        each = np.exp(forward + back - whole[None, :, None]).transpose(1, 0, 2) * there[:, :, None]
        both = np.exp(forward[:-1, :, :, None] + move + (e[:, 1:].transpose(1, 0, 2) + back[1:])[:, :, None, :] - whole[None, :, None, None])
        both = (both * there[:, 1:].T[:, :, None, None]).sum(axis=(0, 1))
        slopes = np.einsum("ntf,ntk->fk", on, gold - each) - ridge[0] * emit, gold_moves - both - ridge[1] * move
        for x, g, m, v in ((emit, slopes[0], state[0], state[1]), (move, slopes[1], state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    plain = emit[[index[f] for f in features("the")]].sum(axis=0)
    change = move[:, :, None] + move[None, :, :]  # at p, t, n: what moving from p to t and on to n adds
    gain = (change - change[:, :1, :]).max(axis=(0, 2))
    return Field(index, emit, move, bool((plain[0] - plain > gain)[1:].all()))


def viterbi(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags (runs x words) of equally long runs with emissions e (runs x words x tags), each between two words tagged 0."""
    n, m, k = e.shape
    best, back = move[0] + e[:, 0], np.zeros((n, m, k), np.int8)
    for j in range(1, m):
        step = best[:, :, None] + move
        back[:, j] = step.argmax(axis=1)
        best = step.max(axis=1) + e[:, j]
    out = np.zeros((n, m), np.int8)
    out[:, -1] = (best + move[:, 0]).argmax(axis=1)
    for j in range(m - 1, 0, -1):
        out[:, j - 1] = back[np.arange(n), j, out[:, j]]
    return out


IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
OPEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGES = "\"'<>()[]{},;:.!?"


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern: the name is all that stands before an at sign, back to the match before."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := HOST.match(text, at)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)  # an at sign without a match ends what can be a name
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted, of the fixed patterns' matches that pass their tests."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) < 4 or len(p.lstrip("0")) < 4 for p in m[0].split(".")) and all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


class Finder:
    """Finds spans in batches of texts; emissions of what features() depends on are kept, up to a bound, but not those of long words."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}

    def emission(self, word: str) -> np.ndarray:
        if len(word) > 200:
            return self.field.scores(word)
        key = shape(word), min(sum(c.isdigit() for c in word), 17), min(word.strip(".,").count("."), 4)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self.field.scores(word)
        return self.known[key]

    def field_spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        runs = defaultdict(list)
        find = OPEN if self.field.certain else re.compile(r"\S+")
        for i, text in enumerate(texts):
            run, end = [], None
            for m in find.finditer(text):
                if run and not (m.start() == end + 1 or text[end : m.start()].isspace()):
                    runs[len(run)].append((i, run))
                    run = []
                run.append((m.start(), m.end()))
                end = m.end()
            if run:
                runs[len(run)].append((i, run))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for length, group in runs.items():
            step = max(1, 200_000 // length)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                e = np.array([[self.emission(texts[i][a:b]) for a, b in run] for i, run in part])
                tags = viterbi(e, self.field.move)
                for r in np.nonzero(tags.any(axis=1))[0]:
                    i, run = part[r]
                    before = 0
                    for tag, (a, b) in zip(tags[r].tolist(), run):
                        if tag and tag == before and tag >= 3:
                            out[i][-1] = (out[i][-1][0], tag - 1, b)
                        elif tag:
                            out[i].append((a, tag - 1, b))
                        before = tag
        return out

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text its base spans, and all spans: of the field's, trimmed of edge signs, those that meet no base span."""
        found = []
        for text, more in zip(texts, self.field_spans(texts)):
            base = base_spans(text)
            added, k = [], 0
            for a, kind, b in sorted(more):
                while a < b and text[a] in EDGES and not (kind == 3 and text[a] == "("):
                    a += 1
                while b > a and text[b - 1] in EDGES:
                    b -= 1
                while k < len(base) and base[k][2] <= a and all(s[2] <= a for s in base[max(0, k - 3) : k + 1]):
                    k += 1
                if a < b and not any(s[0] < b and s[2] > a for s in base[max(0, k - 4) : k + 8]):
                    added.append((a, kind, b))
            found.append((base, sorted(base + added)))
        return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


_finders: dict[int, Finder] = {}


def find_pii(docs: DataFrame, labelled: str = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): spans as strings kind:start:end, joined by commas, in code points; base holds those of the patterns alone.

    Null and empty texts have no spans; every row gives a row, repeated or not, with a null id or not; texts of any length are read
    whole, in linear time; the empty table gives no rows; other columns are ignored, whatever their names. Of spans that start
    together the kinds' order decides.
    """
    field = train(labelled)
    key = hash(labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finders.get(key) or _finders.setdefault(key, Finder(field))
        for b in batches:
            found = finder.find([t or "" for t in b["text"]])
            counts = {f"n_{kind}": [sum(s[1] == k for s in base) for base, _ in found] for k, kind in enumerate(KINDS)}
            yield pd.DataFrame({"id": b["id"]} | counts | {"base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], "spans": [joined(s) for _, s in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    counts = "".join(f"n_{k} long, " for k in KINDS)
    return rows.mapInPandas(run, f"id {kind}, {counts}base_sha256 string, spans string").withColumnRenamed("id", id_col)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """find_pii() over documents: one row for each row."""
    return find_pii(table(spark, sf_dir, "documents"))
