"""Toxicity of texts after undoing disguises: leetspeak, spacing, repetition.

A disguised word is a lattice: each sign may stand for letters, for itself, or for nothing, and a
run of one letter or sign for one or two of it.  Every token that holds such a sign is decoded, of any length and
number of letters; numbers are read too, and their readings weigh what the labels give them.  Viterbi finds the best path under a character trigram
model counted over the training texts.  Plain words have one path and are taken as they are.

Scoring reads words and word beginnings of the restored text.  Those whose document rates differ
between the labels (log-likelihood ratio) carry a log-odds weight, learned over labelled training
rows; a logistic curve over a few sums and maxima of these weights gives the score.

Defined results: null and empty texts are scored like any text without marked words; without
labelled rows of both kinds every score is the share of label 1 (0.1 if there are none); rows of
labels without id or label are passed over, repeated ids count as label 1 if any row says so;
repeated documents are scored each; extra columns stay.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from gradeloom.llm.frames import LOWER, NOT_SPACE, U, Texts, Words, map_pieces, pieces

#: Labelled rows used at most, the first by hash of the id; about 1 MB when broadcast.
TRAIN_ROWS = 30_000
#: Marked words and beginnings kept at most, the strongest first.
TRAIN_MARKS = 50_000
PREFIXES = (4, 5, 6, 7, 8)

#: Letters that a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "aeiou"}
_SYMBOLS = 28  # 0 is the edge of a word, 1 to 26 are letters, 27 is any other letter
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = np.zeros(256, bool)
_ODD[[b for c in STANDS_FOR for b in c.encode() if b < 128] + [ord(c) for c in ".-_"]] = True
#: Where the inside of a token may begin and end: a letter or a sign that stands for one; a closing ``!`` is a mark.
_SIGN = _LETTER.copy()
_SIGN[[ord(c) for c in STANDS_FOR if ord(c) < 128]] = True
_CLOSE = _SIGN.copy()
_CLOSE[[ord(c) for c in "!("]] = False


def sample_labels(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids (doc_id, y), marked for broadcast: the bound makes that safe."""
    plain = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return F.broadcast(plain.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def letter_model(train: DataFrame) -> np.ndarray:
    """log P(letter | two before it) over every word of the training texts, counted once per task."""
    code = np.zeros(256, np.int64)
    for b in range(256):
        code[b] = LOWER[b] - 96 if 97 <= LOWER[b] <= 122 else 27 if b >= 128 else 0

    def count(batches):
        total = np.zeros(_SYMBOLS ** 3, np.int64)
        for piece in pieces(batches):
            c = code[Texts(piece.column("text")).data]
            c = c[np.concatenate([[True], (c[1:] != 27) | (c[:-1] != 27)])] if len(c) else c
            c = np.concatenate([[0, 0], c, [0]])
            total += np.bincount(c[:-2] * _SYMBOLS ** 2 + c[1:-1] * _SYMBOLS + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])
    counts = np.zeros(_SYMBOLS ** 3)
    for r in train.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 21952
        counts[r["at"]] = r["n"]
    three = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1)) + 1
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))


#: Letters that stand once each, or a run of one sign.
_RUN = re.compile(r"(?:([^\W\d_])(?!\1))+|(.)\2*", re.S)
#: Tokens up to this length are remembered; longer ones are decoded each time they come.
_REMEMBERED = 64
#: Letters of a spaced run that are read from each of its places on.
_SPACED = 40
_LEAD = re.compile(r"^[^\w@$]+")
_TAIL = re.compile(r"([^\w\s@$])\1+$|[.,;:?!\"')\]]+$")
_PLAIN = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"([^\W\d_])\1\1")


def _ways(sign: str, run: int, last: bool, full: bool = False) -> list[tuple[str, float]]:
    """What a run of one sign may stand for, with log channel weights; ``full``: a sign that may be a letter is one."""
    if sign.isalpha():
        return [(sign, 0.0)] if run == 1 else [(sign * 2, -0.2), (sign, -2.0)] if run == 2 else [(sign, -1.0), (sign * 2, -1.5)]
    ways = [] if full and sign in STANDS_FOR else [("", -1.0 if sign not in STANDS_FOR else -2.0 if last else -9.0 if sign.isdigit() else -5.0)]
    if sign in STANDS_FOR:
        each = -1.0 - math.log(len(STANDS_FOR[sign]))
        ways += [(c * n, each + w) for c in STANDS_FOR[sign] for n, w in ([(1, 0.0)] if run == 1 else [(2, 0.0), (1, -2.0)] if run == 2 else [(1, -1.0), (2, -1.5)])]
    return ways


def restore(token: str, model: np.ndarray, full: bool = False) -> str:
    """The likeliest plain word behind a token, by Viterbi over states of the last two letters.

    Where one state is left all paths share what lies before it, which is then settled, so time and memory grow
    with the length of the token only.
    """
    token = token.lower()
    settled: list[str] = []

    def code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # score, (path before, letters)

    def spelled(path: tuple | None) -> str:
        out = []
        while path:
            out.append(path[1])
            path = path[0]
        return "".join(reversed(out))

    def step(sign: str, run: int, last: bool) -> None:
        nonlocal states
        ways = _ways(sign, run, last, full)
        fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letters, weight in ways:
                x, y, s = a, b, score + weight
                for c in letters:
                    k = code(c)
                    s += float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in fresh or fresh[x, y][0] < s:
                    fresh[x, y] = (s, (path, letters) if letters else path)
        states = fresh
        if len(states) == 1:
            (key, (_, path)), = states.items()
            settled.append(spelled(path))
            states = {key: (0.0, None)}

    for m in _RUN.finditer(token):
        last, part = m.end() == len(token), m[0]
        if m[2] is not None:
            step(m[2], len(part), last)
            continue
        at = 0
        while at < len(part):
            if len(states) == 1 and len(part) - at > 2 and part.isalpha():  # single letters have one way, so the rest follows at once
                settled.append(part[at:])
                states = {(code(part[-2]), code(part[-1])): (0.0, None)}
                break
            step(part[at], 1, last and at == len(part) - 1)
            at += 1
    ends = {k: v[0] + float(model[k[0], k[1], 0]) for k, v in states.items()}
    best = max(ends.values())
    return "".join(settled) + max(spelled(states[k][1]) for k, s in ends.items() if s == best)


class Restorer:
    def __init__(self, model: np.ndarray):
        self.short = functools.lru_cache(1 << 16)(lambda t: self._readings(t, model))
        self.model = model

    def words(self, token: str) -> tuple[str, ...]:
        """What a token may say: without the marks before it, and with a sign among them read as a letter; the likeliest
        word, and the likeliest one that drops no sign for a letter, since in words all of signs many may seem to be noise."""
        return self.short(token) if len(token) <= _REMEMBERED else self._readings(token, self.model)

    def word(self, token: str) -> str:
        return next(iter(self.words(token)), "")

    @staticmethod
    def _readings(token: str, model: np.ndarray) -> tuple[str, ...]:
        whole = _TAIL.sub("", token)
        core = _LEAD.sub("", whole)
        cores = [core] if any(not c.isalpha() for c in core) or _THRICE.search(core) else []
        if core and len(whole) > len(core) and whole[-len(core) - 1] in STANDS_FOR:
            cores.append(whole[-len(core) - 1:])
        plain = {"", *_PLAIN.findall(token.lower())} if cores else ()  # these are read as words anyway
        ways = [(c, full) for c in cores for full in (False, True) if not full or not STANDS_FOR.keys().isdisjoint(c)]
        return tuple(dict.fromkeys(w for w in (restore(c, model, full) for c, full in ways) if w not in plain))

    def extra(self, words: Words) -> tuple[list[int], list[str]]:
        """(text, word) of what disguised tokens stand for."""
        data = words.data
        sign = _ODD[data]
        if len(data) > 2:  # the signs of two and three bytes
            sign[:-1] |= (data[:-1] == 0xC2) & (data[1:] == 0xA3)
            sign[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] == 0xAC)
        odd = np.concatenate([[0], np.cumsum(sign)])
        same = np.zeros(len(data), bool)
        if len(data) > 2:
            same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
        thrice = np.concatenate([[0], np.cumsum(same)])
        s, e = words.starts, words.ends
        held = thrice[e] > thrice[s]
        opens, closes = np.flatnonzero(_SIGN[data]), np.flatnonzero(_CLOSE[data])
        if len(opens) and len(closes):  # signs between the first and the last letter, or sign for one, of a token
            low = opens[np.minimum(np.searchsorted(opens, s), len(opens) - 1)]
            high = closes[np.maximum(np.searchsorted(closes, e) - 1, 0)] + 1
            held |= (high > low) & (low >= s) & (high <= e) & (odd[high] > odd[np.minimum(low, high)])
        owner, out = [], []
        for i in np.flatnonzero(held).tolist():
            for w in self.words(data[s[i]:e[i]].tobytes().decode("utf-8", "replace")):
                owner.append(int(words.text[i]))
                out.append(w)
        single = np.flatnonzero((e - s == 1) & (_LETTER | _ODD)[data[np.minimum(s, max(len(data) - 1, 0))]] if len(s) else np.zeros(0, bool))
        breaks = np.flatnonzero((np.diff(single) > 1) | (np.diff(words.text[single]) != 0)) + 1
        first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(single)]])
        for low, high in zip(first[last - first >= 4], last[last - first >= 4]):
            run = single[low:high]
            for joined in self.join("".join(chr(data[s[i]]) for i in run)):
                for k in range(max(1, len(joined) - 3)):  # words inside the run are read by their beginnings
                    owner.append(int(words.text[run[0]]))
                    out.append(joined[k:k + _SPACED])
        return owner, out

    def join(self, text: str) -> tuple[str, ...]:
        return self.words(text) or (text.lower(),)


def _letters(texts: Texts) -> Words:
    """Runs of letters, lower case also for the Latin-1 capitals."""
    words = Words(texts, _LETTER, True)
    data = words.data.copy()
    if len(data) > 1:
        upper = np.zeros(len(data), bool)
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[upper] += 32
    words.data = data
    return words


def marks_of(words: Words) -> list[np.ndarray]:
    """Per kind of mark (whole word, beginnings) its hash for every word; 0 where the word is shorter."""
    out = [words.hashes ^ U(0x5555)]
    for k in PREFIXES:
        long = words.ends - words.starts >= k
        h = np.zeros(len(words.starts), U)
        h[long] = words.hash_of(words.starts[long], words.starts[long] + k) ^ U(k)
        out.append(h)
    return out


def _all_marks(texts: Texts, restorer: Restorer) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text, word hash, marks) of every word and every restored word."""
    plain = _letters(texts)
    owner, found = restorer.extra(texts.words(NOT_SPACE))
    more = _letters(Texts(pa.array(found, pa.string())))
    kinds = [np.concatenate(p) for p in zip(marks_of(plain), marks_of(more))]
    return np.concatenate([plain.text, np.array(owner, int)[more.text]]), kinds[0], kinds


@dataclasses.dataclass
class Model:
    letters: np.ndarray
    marks: np.ndarray
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    curve: np.ndarray
    share: float

    def sums(self, texts: Texts, restorer: Restorer) -> np.ndarray:
        """The few numbers per text that the curve reads."""
        text, word, kinds = _all_marks(texts, restorer)
        sieve = np.zeros(1 << 16, bool)
        sieve[(self.marks & U(0xFFFF)).astype(np.int64)] = True
        weight = np.zeros(len(text))
        for h in kinds if len(self.marks) else []:
            at = np.flatnonzero(sieve[(h & U(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.marks, h[at]), len(self.marks) - 1)
            hit = self.marks[place] == h[at]
            weight[at[hit]] = np.maximum(weight[at[hit]], self.weights[place[hit]])
        total = np.bincount(text, minlength=texts.size)
        marked = np.flatnonzero(weight > 0)
        often = np.bincount(text[marked], minlength=texts.size)
        per: dict[int, dict[int, float]] = defaultdict(dict)
        for i in marked.tolist():
            per[int(text[i])][int(word[i])] = weight[i]
        out = np.zeros((texts.size, 11))
        out[:, 4], out[:, 5] = np.log1p(often), np.log1p(total)
        for i, found in per.items():
            top = sorted(found.values(), reverse=True)
            out[i, :4] = *(top + [0.0, 0.0])[:3], np.log1p(len(top))
            out[i, 6:] = out[i, 3] / (1 + out[i, 5]), sum(top[:8]), out[i, 0] * out[i, 1], out[i, 0] > 3.5, out[i, 3] ** 2
        return out

    def score(self, sums: np.ndarray) -> np.ndarray:
        z = ((sums - self.center) / self.scale) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return center, scale, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, marks: int = TRAIN_MARKS, least: float = 12.0) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text); the letter model reads all of them, the weights the labelled ones."""
    letters = letter_model(docs)
    known = docs.join(sample_labels(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), label, rows), "doc_id").select("text", "y")
    handle = docs.sparkSession.sparkContext.broadcast(letters)

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        y = np.array(piece.column("y").to_pylist(), int)
        text, _, kinds = _all_marks(Texts(piece.column("text")), Restorer(handle.value))
        pairs = np.unique(np.stack([np.tile(text, len(kinds)).astype(U), np.concatenate(kinds)]), axis=1)
        pairs = pairs[:, pairs[1] != 0]
        mark, at = np.unique(pairs[1], return_inverse=True)
        ones = np.bincount(at, y[pairs[0].astype(int)], minlength=len(mark)).astype(np.int64)
        alls = np.bincount(at, minlength=len(mark)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(ones), pa.array(alls)],
                                          ["mark", "ones", "n"])
    counts = map_pieces(known, count, "mark long, ones long, n long").groupBy("mark").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    counts = counts.where("ones >= 3")
    whole = known.agg(F.sum("y"), F.count(F.lit(1))).first()
    ones, n = float(whole[0] or 0), float(whole[1] or 0)
    empty = Model(letters, np.zeros(0, U), np.zeros(0), np.zeros(11), np.ones(11), np.zeros(12), ones / n if n else 0.1)
    if not 0 < ones < n:
        empty.curve[-1] = np.log(max(empty.share, 1e-3) / max(1 - empty.share, 1e-3))
        return empty
    a, b = F.col("ones").cast("double"), (F.col("n") - F.col("ones")).cast("double")
    expected = (a + b) * ones / n
    ratio = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0))
    odds = F.log((a + 0.5) / (ones + 1)) - F.log((b + 0.5) / (n - ones + 1))
    kept = counts.select("mark", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") > 0.7) & (F.col("ratio") > least))
    table = kept.orderBy(F.desc("ratio"), "mark").limit(marks).select("mark", "odds").toPandas()
    keys = table["mark"].to_numpy(np.int64).view(U)
    order = np.argsort(keys)
    model = dataclasses.replace(empty, marks=keys[order], weights=table["odds"].to_numpy()[order])
    handle2 = docs.sparkSession.sparkContext.broadcast(model)

    def read(piece: pa.RecordBatch) -> pa.RecordBatch:
        sums = handle2.value.sums(Texts(piece.column("text")), Restorer(handle2.value.letters))
        return pa.RecordBatch.from_arrays([piece.column("y").cast(pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["y", "x"])
    seen = map_pieces(known, read, "y int, x array<double>").toPandas()  # at most ``rows`` rows of eleven numbers
    model.center, model.scale, model.curve = _fit_curve(np.array(seen["x"].tolist()), seen["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``: the chance in [0, 1] that the label is 1."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])

    def run(batches):
        restorer = Restorer(handle.value.letters)
        for piece in pieces(batches, text):
            value = handle.value.score(handle.value.sums(Texts(piece.column(text)), restorer))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(value, pa.float64())], [*piece.schema.names, name])
    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))
