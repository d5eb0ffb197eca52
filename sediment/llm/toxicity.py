"""Toxicity: noisy-channel restoration of obfuscated words, then a linear score of the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, slices, table
from .dedup import C1, Hashes, mix, shingles

# Fixed values of the channel: what a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Costs of the channel in nats: a sign for a letter, a hidden letter, punctuation dropped, a sign that may be a letter dropped, the second of equal letters dropped, further ones dropped, a word break put in.
SIGN, HIDDEN, DROP, DROP_SIGN, DOUBLE, REPEAT, BREAK = 0.5, 4.0, 0.5, 9.0, 7.0, 0.3, 6.0
PLAIN = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"(\w)\1\1")
SPACED = re.compile(r"(?<!\S)[a-zA-Z0-9@$!|+(<*](?:[ \t]+[a-zA-Z0-9@$!|+(<*]){2,}(?!\S)")
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
#: Of tokens longer than MOST characters: further equal ones, and what separates words in them. What is still longer is decoded in pieces that overlap.
LONG, BETWEEN = re.compile(r"(.)\1{3,}"), re.compile(r"[^\w@$!|+(<*€£¡]+|_+")
MOST, OVERLAP = 60, 24
TWICE, REPEATED, NO_LETTER = re.compile(r"(.)\1"), re.compile(r"(.)\1+"), re.compile(r"[^a-z]")
GRAM = 4
NUMBER = re.compile(r"[^\w]*\d[\d.,:/%+\-()]*[^\w]*")
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 3)
THRESHOLD = 0.7
#: Labelled rows that a model is learned from, about and at most.
SAMPLE = 10_000
#: Scrambles that tell copies among the training rows, parts of these for cross-validation, and the doubts about single features that it chooses from.
COPY_KEYS, FOLDS, DOUBTS = 3, 5, (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
CACHE, CACHE_NAMES = 150_000, 10_000


class Channel:
    """Viterbi decoding of a character lattice; lm holds log P(c | a, b) at (a * 27 + b) * 27 + c, 0 being the word border."""

    def __init__(self, lm: list[float]):
        self.lm = lm

    def whole(self, word: str) -> bool:
        """Whether restore leaves a word of a-z without equal neighbours as it is: only breaks could change it."""
        lm, x = self.lm, [ord(ch) - 96 for ch in word]
        b = x[0]
        a, inside, first, unbroken = 0, math.inf, -lm[b], -lm[b]  # cost where the last letter goes on a word, and where it begins one
        for c in x[1:]:
            at, start = (a * 27 + b) * 27, b * 27
            unbroken -= lm[at + c]
            ends = min(inside - lm[at], first - lm[start])
            inside, first = min(inside - lm[at + c], first - lm[start + c]), ends + BREAK - lm[c]
            a, b = b, c
        at = (a * 27 + b) * 27
        return unbroken - lm[at] <= min(inside - lm[at], first - lm[b * 27]) + 1e-9

    def restore(self, token: str, gap: float = BREAK) -> str:
        """The likeliest words of an obfuscated token, joined by spaces; gap is the cost of a word break.

        A letter stands for itself, a sign for the letters of LEET or for nothing, an asterisk also for any
        letter, a repeated letter for itself or for nothing more; a word break may fall between letters.
        A state is the last two letters (0 at a border).
        """
        lm, token = self.lm, token.lower()
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        was, run = "", 0
        for ch in token:
            letters = [(ord(ch) - 96, 0.0)] if "a" <= ch <= "z" else [(ord(x) - 96, SIGN) for x in LEET.get(ch, "")]
            if ch == "*" and was != "*":
                letters = [(i, HIDDEN) for i in range(1, 27)]
            run = run + 1 if ch == was else 1
            again = DOUBLE if run == 2 and token.count(ch * 3) == 0 else REPEAT
            skip = again if run > 1 and letters else None if "a" <= ch <= "z" else DROP_SIGN if ch in LEET else DROP
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                if skip is not None and (b or not letters) and cost + skip < new.get((a, b), (math.inf,))[0]:
                    new[a, b] = (cost + skip, path)
                for c, paid in letters:
                    total = cost + paid - lm[(a * 27 + b) * 27 + c]
                    if total < new.get((b, c), (math.inf,))[0]:
                        new[b, c] = (total, (c, path))
                    if b:  # the word may end before this letter
                        total = cost + paid + gap - lm[(a * 27 + b) * 27] - lm[c]
                        if total < new.get((0, c), (math.inf,))[0]:
                            new[0, c] = (total, (c, (0, path)))
            states = new or states
            was = ch
        best = min(states.items(), key=lambda x: x[1][0] - (lm[(x[0][0] * 27 + x[0][1]) * 27] if x[0][1] else 0), default=None)
        out, path = [], best[1][1] if best else None
        while path:
            out.append(" " if path[0] == 0 else LETTERS[path[0] - 1])
            path = path[1]
        return "".join(reversed(out))


def squeezed(token: str) -> str:
    """The letters a-z of a token, equal neighbours once."""
    if not token.isascii():
        token = NO_LETTER.sub("", token)
    return REPEATED.sub(r"\1", token) if TWICE.search(token) else token


class Grams:
    """A test of bytes for any of some strings of four bytes."""

    def __init__(self, strings: set[bytes]):
        self.codes = np.array(sorted(int.from_bytes(x, "little") for x in strings), np.uint32)
        self.table = np.zeros(1 << 16, bool)
        self.table[self.places(self.codes)] = True

    @staticmethod
    def places(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(16)

    def within(self, b: np.ndarray) -> bool:
        if len(b) < 4 or not len(self.codes):
            return False
        x = b.astype(np.uint32)
        codes = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
        some = codes[self.table[self.places(codes)]]
        return bool(len(some)) and bool(np.isin(some, self.codes).any())


class Reader:
    """Features of texts: restored words, their prefixes for inflected forms, and that 2 or 3 words share a prefix.

    wanted numbers the features to return; without it all are returned by name. With as_written the channel is
    kept from tokens of plain letters, which gives no more features than a whole reading.
    """

    def __init__(self, lm: list[float], wanted: dict[str, int] | None = None, as_written: bool = False):
        self.channel, self.known, self.as_written = Channel(lm), {}, as_written
        self.levels: dict[str, tuple] | None = None
        if wanted is not None:
            names = {f.partition("#")[0] for f in wanted}
            self.starts = {f[2:i] for f in names if f[0] == "w" for i in range(3, len(f) + 1)}
            self.levels = {f: tuple(wanted.get(f if k == 1 else f"{f}#{k}", -1) for k in LEVELS) for f in names}
            self.exact = {f[2:]: self.levels[f] for f in names if f[0] == "w"}
            self.heads = {f[2 : 2 + GRAM] for f in names}
            self.prefixes = [(n, {f[2:]: self.levels[f] for f in names if f[0] == str(n)}) for n in PREFIXES]
            self.grams = {squeezed(f[2:])[:GRAM] for f in names if f.isascii() and len(squeezed(f[2:])) >= GRAM}  # the channel writes a-z only
            short = [h for h in self.heads if len(h.encode()) < 4]
            self.short = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, short)) + r")(?![^\W\d_])") if short else None
            self.begun = Grams({h.encode()[:4] for h in self.heads if len(h.encode()) >= 4})
            self.inside = Grams({g.encode() for g in self.grams})

    def may_tell(self, text: str) -> bool:
        """Whether tokens of plain letters could have wanted features: as written or, repeats gone, by the channel. A letter three times in a row counts too."""
        low = text.lower()
        b = np.frombuffer(low.encode("utf-8", "replace"), np.uint8)
        if self.begun.within(b) or (self.short is not None and self.short.search(low)):
            return True
        same = b[1:] == b[:-1]
        if (same[1:] & same[:-1] & (b[2:] >= 97)).any():
            return True
        b = b[b < 128]
        b = b[np.append(True, b[1:] != b[:-1])] if len(b) else b
        return self.inside.within(b)

    def may_hold(self, token: str) -> bool:
        """Whether the channel could find a wanted word in a token of plain letters (lower case): it only drops repeats and adds breaks, so these stand in it once repeats are gone."""
        if self.levels is None or self.as_written:
            return not self.as_written
        s, grams = squeezed(token), self.grams
        return any(s[i : i + GRAM] in grams for i in range(len(s) - GRAM + 1))

    def decoded(self, token: str, gap: float = BREAK) -> list[str]:
        """The words of a token by the channel; a long token is cut at separators, then into pieces that overlap."""
        if len(token) <= MOST:
            if gap == BREAK and PLAIN.fullmatch(token):  # other letters than a-z are dropped at the same cost everywhere
                word = NO_LETTER.sub("", token.lower())
                if word and not TWICE.search(token.lower()) and not TWICE.search(word) and self.channel.whole(word):
                    return [word]
            return self.channel.restore(token, gap).split()
        out = []
        for part in BETWEEN.split(LONG.sub(r"\1\1\1", token.lower())):
            for i in range(0, max(1, len(part) - OVERLAP), MOST - OVERLAP):
                piece = part[i : i + MOST]
                if any("a" <= c <= "z" or c in LEET for c in piece):
                    out += self.channel.restore(piece, gap).split()
        return out

    def words(self, token: str) -> list[str]:
        """The words that a token may stand for; in one of plain letters the channel's words of GRAM letters or more, repeats not counted."""
        return self.run(token[1:]) if token[0] == " " else self.words_of(token)

    def run(self, token: str) -> list[str]:
        """The words of a spaced-out run, joined to a token without its word breaks: those likeliest to follow each other, and any wanted one of 4 letters or more."""
        out = self.words_of(token, 0.0)
        if self.levels is not None:
            token = token.lower()
            for i in range(len(token)):
                live = [""]
                for ch in token[i:]:
                    letters = LETTERS if ch == "*" else LEET.get(ch, ch)
                    live = [p + x for p in live for x in letters if p + x in self.starts]
                    if not live:
                        break
                    out += [w for w in live if len(w) > 3 and f"w:{w}" in self.levels]
        return out

    def words_of(self, token: str, gap: float = BREAK) -> list[str]:
        found = CORE.search(token)
        core = found[0] if found else ""
        plain = core.lower()
        letters = any("a" <= c <= "z" for c in token.lower())
        if core and PLAIN.fullmatch(core) and not TRIPLE.search(plain):
            found = self.decoded(core, gap) if letters and self.may_hold(plain) else ()
            return [plain, *(w for w in found if len(squeezed(w)) >= GRAM)]
        if not letters and (NUMBER.fullmatch(token) or len({LEET[c] for c in token if c in LEET}) < 2):
            return []  # a number or punctuation
        if "-" in core and all(len(x) > 2 and PLAIN.fullmatch(x) for x in core.split("-")):
            return [w for x in core.split("-") for w in self.words_of(x)]
        tidy = re.sub(r"[.,;:?\"')\]}]+$|^[\"'(\[{]+", "", token)
        return [*self.decoded(tidy, gap), *(self.decoded(core, gap) if core != tidy else ())]

    def of_word(self, word: str) -> list:
        """What numbers a word adds to a text's features, by how many words add them; their names without wanted ones."""
        if self.levels is None:
            return [(f"w:{word}", "", "")] + [(f, f"{f}#2", f"{f}#3") for f in (f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]
        if word[:GRAM] not in self.heads:
            return []
        out = [self.exact[word]] if word in self.exact else []
        return out + [t[word[:n]] for n, t in self.prefixes if len(word) > n and word[:n] in t]

    def of_token(self, token: str) -> tuple:
        core = token.strip(punctuation)
        if core.isalpha() and token[0] != " " and not self.may_hold(plain := core.lower()) and not TRIPLE.search(plain):
            return tuple(self.of_word(plain))  # the channel would find nothing that is wanted
        return tuple(f for w in dict.fromkeys(self.words(token)) for f in self.of_word(w))

    def features(self, text: str) -> set:
        known, seen = self.known, Counter()
        if len(known) > (CACHE_NAMES if self.levels is None else CACHE):
            known.clear()
        tokens = set(text.split())
        if self.levels is not None and not self.as_written and not self.may_tell(text):
            singles = [t for t in tokens if len(t) == 1 and t.isalpha()]
            tokens = {t for t in tokens if not t.strip(punctuation).isalpha()}.union(singles)
        if sum(len(t) == 1 and t not in ".,;:-" for t in tokens) > 1:
            tokens.update(" " + re.sub(r"\s+", "", m[0]) for m in SPACED.finditer(text))
        for t in tokens:
            f = known.get(t)
            if f is None:
                f = known[t] = self.of_token(t)
            if f:
                seen.update(f)
        out = {names[k - 1] for names, n in seen.items() for k in LEVELS if n >= k}
        return out - {"", -1}


class Score:
    """The log odds of a text's features: the linear model's, or those of its surest single feature where they are higher."""

    def __init__(self, weights: list[float], single: list[float], bias: float):
        self.weights, self.single, self.bias = weights, single, bias

    def of(self, features: set) -> float:
        z = self.bias
        for f in features:
            z += self.weights[f]
        return max([z, *(self.single[f] for f in features)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def character_model(docs: DataFrame, prior: float = 0.5) -> list[float]:
    """Trigram log probabilities of letters within words, counted over the whole text of all docs; other characters are borders."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.zeros(256, np.int32)
        for i in range(26):
            kind[97 + i] = kind[65 + i] = i + 1
        sums = np.zeros(27**3, np.int64)
        for b in batches:
            for s in slices(b):
                x = kind[np.frombuffer(b"\n".join(t.as_buffer().to_pybytes() for t in s.column("text")), np.uint8)]  # a border after each text
                x = np.concatenate([[0, 0], x[(x > 0) | (np.append(0, x[:-1]) > 0)] if len(x) else x, [0]])
                left = np.where(x[1:-1] == 0, 0, x[:-2])  # nothing before a border matters
                sums += np.bincount((left * 27 + x[1:-1]) * 27 + x[2:], minlength=27**3)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["i", "n"])

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    c = np.full(27**3, prior)
    for i, n in text.mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        c[i] += n
    c[0] = prior  # border after border
    c = c.reshape(27, 27, 27)
    return np.log(c / c.sum(axis=2, keepdims=True)).ravel().tolist()


def worth_trying(feature: str) -> bool:
    """Words of three letters or more, and prefixes that have GRAM letters when repeats count once."""
    name = feature[2:].partition("#")[0]
    return len(name) > 2 if feature[0] == "w" else len(REPEATED.sub(r"\1", name)) >= GRAM


def no_copies(texts: DataFrame) -> DataFrame:
    """Of the rows of texts (text, toxic, fold) with one label that share the least hash of their five-word shingles, under any of COPY_KEYS scrambles, one.

    Copies with a Jaccard similarity of 0.8 share one with a chance of over 99 %, texts with nothing in common share none.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, scrambles = Hashes(), mix(np.arange(1, COPY_KEYS + 1, dtype=np.uint64) * C1)
        for b in batches:
            least = np.zeros((COPY_KEYS, b.num_rows), np.uint64)
            for j, t in enumerate(b.column("text")):
                if len(e := shingles(t.as_buffer().to_pybytes(), hashes)):
                    least[:, j] = [mix(e ^ k).min() for k in scrambles]
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic").cast(pa.int32()), b.column("fold"), *map(pa.array, least.astype(np.int64))], ["text", "toxic", "fold", *names])

    names = [f"k{i}" for i in range(COPY_KEYS)]
    out = texts.mapInArrow(sign, "text string, toxic int, fold int, " + ", ".join(f"{n} long" for n in names))
    for n in names:
        first = F.row_number().over(Window.partitionBy("toxic", n).orderBy(F.md5("text"), "fold"))
        out = out.withColumn("_n", first).filter("_n = 1").drop("_n")
    return out.drop(*names).repartition(texts.sparkSession.sparkContext.defaultParallelism, F.md5("text"))  # few rows, but slow ones


def train(docs: DataFrame, labels: DataFrame, lm: list[float], sample: int = SAMPLE, most_features: int = 4096) -> tuple[dict[str, int], Score]:
    """Features and score of a logistic model of labels (doc_id, toxic), from rows that are not held out.

    At most about sample labelled rows are used (by a hash of doc_id), near copies of equal label once, as they
    are no further evidence for what they share. A feature must occur in 4 toxic rows
    and pass a likelihood-ratio test corrected for the number of features tried. Without toxic or without
    clean rows there are no features, and the bias alone gives the share of toxic rows.
    """
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    texts = materialize(no_copies(texts.select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))), "labelled")

    def tally(toxic: int, wanted: dict[str, int] | None, as_written: bool = False):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, n = Reader(lm, wanted, as_written), Counter()
            for b in batches:
                for t in b.column("text"):
                    n.update(reader.features(t.as_py()))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in n]), pa.array(list(n.values()), pa.int64())], ["f", "n"])

        return texts.filter(F.col("toxic") == toxic).mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    total = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    bias = math.log((pos + 0.5) / (neg + 0.5))
    if not pos or not neg:
        discard(texts)
        return {}, Score([], [], bias)
    tried = {r["f"]: r["n"] for r in tally(1, None).filter("n >= 4").collect() if worth_trying(r["f"])}
    least = 2 * math.log(max(1, len(tried))) + 8

    def telling(features: list[str], as_written: bool) -> list[tuple[float, str]]:
        """Features more of the toxic rows have, by a likelihood-ratio test, with its statistic."""
        number, out = {f: i for i, f in enumerate(sorted(features))}, []
        clean = {int(r["f"]): r["n"] for r in tally(0, number, as_written).collect()}
        for f, i in number.items():
            a, b = tried[f], clean.get(i, 0)
            if a * neg <= b * pos:
                continue
            x = lambda n, e: n * math.log(n / e) if n else 0.0
            p = (a + b) / (pos + neg)
            g = 2 * (x(a, pos * p) + x(pos - a, pos * (1 - p)) + x(b, neg * p) + x(neg - b, neg * (1 - p)))
            if g > least:
                out.append((g, f))
        return out

    # what fails as written fails whole: the channel only adds clean rows to a feature
    gain = telling([f for _, f in telling(list(tried), True)], False)
    wanted = {f: i for i, (_, f) in enumerate(sorted(gain, reverse=True)[:most_features])}

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm, wanted)
        for b in batches:
            f = [sorted(reader.features(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), b.column("toxic").cast(pa.int32()), b.column("fold")], ["f", "y", "fold"])

    kinds = texts.mapInArrow(matrix, "f array<int>, y int, fold int").groupBy("f", "y", "fold").count().collect()
    discard(texts)
    y, n, fold = (np.array([k[x] for k in kinds], float) for x in ("y", "count", "fold"))
    r = np.repeat(np.arange(len(kinds)), [len(k["f"]) for k in kinds])
    c = np.array([i for k in kinds for i in k["f"]], np.int64)
    doubt = least_loss(r, c, y, n, fold, len(wanted), bias)
    weights, bias = fit(r, c, y, n, len(wanted), bias)
    return wanted, Score(weights.tolist(), single_odds(r, c, y, n, len(wanted), doubt).tolist(), bias)


def single_odds(r: np.ndarray, c: np.ndarray, y: np.ndarray, n: np.ndarray, k: int, doubt: float) -> np.ndarray:
    """Log odds of a row by one feature alone, for those that no clean row has: a low estimate of how many toxic rows have it, against doubt clean ones."""
    a, b = np.bincount(c, (n * y)[r], k), np.bincount(c, (n * (1 - y))[r], k)
    low = a - 1.64 * np.sqrt(a)
    return np.where((b == 0) & (low > 0), np.log(np.maximum(low, 1e-9) / doubt), -np.inf)


def least_loss(r: np.ndarray, c: np.ndarray, y: np.ndarray, n: np.ndarray, fold: np.ndarray, k: int, bias: float) -> float:
    """The doubt with the least log loss on rows that neither model nor counts saw, over FOLDS parts of the training rows; of equal ones the largest."""
    loss = np.zeros(len(DOUBTS))
    for f in np.unique(fold):
        seen = n * (fold != f)
        w, b = fit(r, c, y, seen, k, bias, steps=500)
        z = b + np.bincount(r, w[c], len(y))
        for i, doubt in enumerate(DOUBTS):
            best = z.copy()
            np.maximum.at(best, r, single_odds(r, c, y, seen, k, doubt)[c])
            loss[i] += ((n - seen) * (np.logaddexp(0, best) - y * best)).sum()
    return DOUBTS[len(DOUBTS) - 1 - int(loss[::-1].argmin())]


def fit(r: np.ndarray, c: np.ndarray, y: np.ndarray, n: np.ndarray, k: int, bias: float, ridge: float = 0.005, steps: int = 3000) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient on 0/1 features given as (row, column) pairs; weights are not negative."""
    w, v, b, vb = np.zeros(k), np.zeros(k), bias, bias
    size = np.bincount(r, minlength=len(y)) + 1
    rate = 1.0 / (0.25 * np.maximum(np.bincount(c, (n * size)[r], k), 1.0) + ridge)
    rate_b = 1.0 / (0.25 * (n * size).sum())
    for t in range(steps):
        p = 1 / (1 + np.exp(-(vb + np.bincount(r, v[c], len(y)))))
        d = n * (p - y)
        new = np.maximum(0, v - rate * (np.bincount(c, d[r], k) + ridge * v))
        new_b = vb - rate_b * d.sum()
        m = t / (t + 3)
        v, vb = new + m * (new - w), new_b + m * (new_b - b)
        w, b = new, new_b
    return w, b


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    The character model counts all docs; labels (doc_id, toxic) of rows with crc32(doc_id) mod 3 = 1 are
    never learned from, nor are null or other labels. A null text is empty and gets the bias's score, below
    the threshold when toxic rows are the fewer. Repeated rows are scored each by itself; a null doc_id is never held out.
    Other columns are ignored, whatever their names; an empty table gives no rows. A text of any length is read
    whole, token by token. Of features that tell equally much the later name comes first when most_features cuts them;
    of readings of a token that cost the same the one met first is taken, the same in every run.
    """
    lm = character_model(docs)
    wanted, model = train(docs, labels, lm, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm, wanted)
        for b in batches:
            for s in slices(b):
                z = np.array([model.of(reader.features(t)) for t in s.column("text").to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text and any others) whose score stays below the threshold, with all their columns.

    Nulls, repeated rows and empty tables are as for score; null texts stay.
    """
    lm = character_model(docs)
    wanted, model = train(docs, labels, lm, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm, wanted)
        limit = math.log(THRESHOLD / (1 - THRESHOLD))
        for b in batches:
            at = b.schema.get_field_index("text")
            for s in slices(b):
                clean = [model.of(reader.features(t or "")) < limit for t in s.column(at).to_pylist()]
                yield s.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
