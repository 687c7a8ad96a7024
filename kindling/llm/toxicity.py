"""Toxicity of texts, scored after a noisy channel has been undone.

Writers hide words by look-alike characters, spaces or marks between letters, and repeated
letters. A word with such signs becomes a lattice: each character is itself, or a letter it
may stand for, or nothing, each at a price. A Viterbi search picks the path that is cheapest
under those prices and a character language model, counted over the whole corpus. The score
is a logistic function of the evidence of the restored text's words.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.worker_memory import Recent, remembered, tidy

# Labelled rows that a model is fitted on, about: rows are chosen by a hash of their key.
TRAINING_ROWS = 20_000

# Words whose restored form and evidence a worker remembers.
MEMORY = 100_000

# --- fixed values: what a character may stand for -----------------------------

LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "*": "aeiou", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "[": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k",
}
MARKS = frozenset("*.-_~^'`\"#%&,;:/\\+=|!$@​‌‍­")
# ------------------------------------------------------------------------------

# Prices, in nats: a letter for a look-alike, a mark or space dropped, a repeated letter dropped.
SWAP, DROP_MARK, DROP_REPEAT, KEEP_ODD = 0.5, 0.3, 0.4, 12.0
# A mark or space read as the end of a word, where letters are set apart.
BREAK = 0.3

# --- the character language model ----------------------------------------------

SYMBOLS = 27  # 0 is the edge of a word, 1 to 26 are a to z


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x250, np.uint8)
    for code in range(len(table)):
        base = unicodedata.normalize("NFKD", chr(code).lower())[:1]
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
    return table


_SYMBOL = _symbol_table()


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(codes < len(_SYMBOL), _SYMBOL[np.minimum(codes, len(_SYMBOL) - 1)], 0)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for at in range(0, len(texts), 256):
            s = _symbols("\n\n".join(t for t in texts[at : at + 256] if t)).astype(np.int32)
            if len(s) > 2:
                counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs -ln p(c | a, b) of all letter trigrams, counted over every text.

    At most 27 cubed counts reach the driver, whatever the corpus.
    """
    grams = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_trigrams, "gram int, n long")
    rows = grams.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(0)
    smooth = (pairs + 1) / (pairs.sum(1, keepdims=True) + SYMBOLS)
    return -np.log((counts + 4 * smooth[None]) / (counts.sum(2, keepdims=True) + 4))


def restore(word: str, costs: list, breaks: bool = False) -> str:
    """The cheapest reading of a word's lattice, by Viterbi over the last two letters.

    ``costs[a][b][c]`` are the language model's. Characters without any reading as a letter
    stay outside of the lattice: a word with none that can be read comes back unchanged. With ``breaks``, marks and
    spaces may end a word, and several words come back with spaces between.
    """
    # Per state (two letters before): cost and letters so far, each with those before it.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last = ""
    for ch in word:
        options: list[tuple[float, str]] = []
        letter = ch if "a" <= ch <= "z" else unicodedata.normalize("NFKD", ch)[:1]
        if "a" <= letter <= "z":
            options.append((0.0, ch))
            if ch == last:
                options.append((DROP_REPEAT, ""))
            last = ch
        else:
            options += [(SWAP, x) for x in LOOKALIKES.get(ch, "")]
            mark = ch in MARKS or ch.isspace()
            options.append((DROP_MARK if mark else KEEP_ODD, ""))
            if breaks and mark:
                options.append((BREAK, " "))
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, text) in states.items():
            for price, x in options:
                if x:
                    c = int(_SYMBOL[ord(x)]) if ord(x) < len(_SYMBOL) else 0
                    state, total, longer = (b, c), cost + price + costs[a][b][c], (text, x)
                else:
                    state, total, longer = (a, b), cost + price, text
                known = new.get(state)
                if known is None or total < known[0]:
                    new[state] = (total, longer)
        states = new
    node = min(((cost + costs[a][b][0], text) for (a, b), (cost, text) in states.items()), key=lambda end: end[0])[1]
    letters = []
    while node:
        node, x = node
        letters.append(x)
    return "".join(reversed(letters)).strip() or word


# --- words and their evidence ---------------------------------------------------

# Single letters or look-alikes set apart by one or two spaces or marks each: at least three of them.
_LETTER = r"[^\W_]|[@$!€£¡§]"
_SPACED = re.compile(rf"(?<![^\W_])(?:{_LETTER})(?:[ .\-_*~|/,]{{1,2}}(?:{_LETTER})){{2,}}(?![^\W_])")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_ODD = re.compile(r"[^\W\d_].*[\d@$!|+(<\[{€£¡§*.\-_~^#%&/\\​‌‍­].*[^\W\d_]|(.)\1\1|[\d@$!|+€£¡§][^\W\d_]|[^\W\d_][\d@$€£]")
_EDGES = "\"'.,;:!?()[]{}<>«»„“”‘’*%$&#|-–—…"
# Edges that stand for no letter, and look-alikes at an edge of a word.
_OUTSIDE = "\"'.,;:?)]}>«»„“”‘’%&#-–—…"
_PAIRS = ("()", "[]", "{}", "<>", "**", "||")
_EDGE_ALIKE = re.compile(r"[$!|(\[{<*]+[^\W_]|[^\W_][$!|*]+\Z")

_THRICE = re.compile(r"(.)\1\1")

PREFIXES = (4, 5, 6)
FORMS = 4


def features(word: str) -> list[str]:
    """A restored word's features: itself and its beginnings, as inflected forms share those."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


class Reader:
    """Restored words of texts, and the features of those."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.tolist()
        self.known = Recent(MEMORY)

    def _readings(self, token: str) -> tuple[str, ...]:
        plain = token.rstrip(".,;:?")
        if plain.isalpha() and not _THRICE.search(plain):
            return (plain,)
        core = token.strip(_EDGES)
        if not core:
            return ()
        pieces = (core,) if _PLAIN.match(core) else tuple(p for p in re.split(r"[\W\d_]+", core) if p)
        whole = token.strip(_OUTSIDE)
        for first, last in _PAIRS:
            if token.lstrip("\"'„“«").startswith(first) and last in token[1:]:
                whole = whole.strip(first + last)
        if _EDGE_ALIKE.match(whole) or _EDGE_ALIKE.search(whole, max(0, len(core) - 1)) or _ODD.search(core):
            return (restore(whole, self.costs), *pieces)
        return pieces

    def _spaced(self, run: str) -> tuple[str, ...]:
        """A run of single letters as one word and as several."""
        return (restore(run, self.costs), *restore(run, self.costs, breaks=True).split())

    def words(self, text: str) -> set[str]:
        """All different words of a text, lower case, as read through the noisy channel."""
        text = text.lower()
        tokens = set(text.split())
        for m in _SPACED.finditer(text):
            tokens.add(" " + m[0])
        known, out = self.known, set()
        # What only the generation before holds comes back through get, below.
        found = list(map(known.now.get, tokens))
        for token, words in zip(tokens, found, strict=True):
            if words is None:
                words = known.get(token)
                if words is None:
                    words = self._spaced(token[1:]) if token[0] == " " else self._readings(token)
                    if len(token) < 100:
                        known.put(token, words)
            out.update(words)
        return out


# Evidence of a document: its strongest words, and how many words are strong.
TOP = 3
STRONG = 2.0


def evidence(weights: list[float]) -> list[float]:
    best = sorted(weights, reverse=True)[:TOP]
    best += [0.0] * (TOP - len(best))
    strong = sum(w > STRONG for w in weights)
    return [1.0, *best, math.log1p(strong)]


def _weight(pos: float, neg: float, share: float) -> float:
    """Log odds of a feature against the share of toxic rows, drawn to 0 where it is rare."""
    return math.log((pos + 4 * share) / (neg + 4 * (1 - share)) * (1 - share) / share)


class Model:
    """Feature weights and a logistic function of a document's evidence."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], logistic: list[float]) -> None:
        self.costs, self.weights, self.logistic = costs, weights, logistic

    def __getstate__(self):
        return self.costs, self.weights, self.logistic

    def __setstate__(self, state):
        self.__init__(*state)

    def strength(self, word: str) -> float:
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return max(found) if found else 0.0

    def score(self, text: str | None) -> float:
        reader, strengths = remembered(("toxicity", id(self)), lambda: (Reader(self.costs), Recent(MEMORY)))
        found, now = [], strengths.now.get
        for word in reader.words(text or ""):
            w = now(word)
            if w is None:
                w = strengths.get(word)
                if w is None:
                    w = self.strength(word)
                    strengths.put(word, w)
            if w > 0:
                found.append(w)
        z = sum(a * b for a, b in zip(self.logistic, evidence(found), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(texts: list[str], toxic: list[int], costs: np.ndarray) -> Model:
    """Fit on labelled texts. A row's own evidence is counted without that row."""
    n, n_pos = len(texts), sum(toxic)
    if not n or n_pos in (0, n):  # nothing to tell apart
        share = (n_pos + 0.5) / (n + 1)
        return Model(costs, {}, [math.log(share / (1 - share)), *[0.0] * (TOP + 1)])
    reader, share = Reader(costs), n_pos / n
    # Only features of several toxic rows can be evidence: those are counted in all rows.
    # A beginning has to stand before several different words there.
    counts: dict[str, list[int]] = {}
    words_of: dict[str, set[str]] = {}
    for text in (t for t, label in zip(texts, toxic, strict=True) if label):
        words = reader.words(text)
        for f in {f for w in words for f in features(w)}:
            counts.setdefault(f, [0, 0])[1] += 1
        for w in words:
            for f in features(w)[1:]:
                if len(known := words_of.setdefault(f, set())) < FORMS:
                    known.add(w)
    counts = {f: c for f, c in counts.items() if c[1] > 1 and (f[0] == "=" or len(words_of[f]) >= FORMS)}
    vocabulary: dict[str, list[list[int]]] = {}  # the counts of each word's features
    dull: set[str] = set()  # words without any
    per_row = []
    for text, label in zip(texts, toxic, strict=True):
        own = []
        for w in reader.words(text):
            if w in dull:
                continue
            found = vocabulary.get(w)
            if found is None:
                found = [counts[f] for f in features(w) if f in counts]
                if not found:
                    if len(dull) >= 2 * MEMORY:
                        dull.clear()
                    dull.add(w)
                    continue
                vocabulary[w] = found
            own.append(found)
        if not label:
            for c in {id(c): c for found in own for c in found}.values():
                c[0] += 1
        per_row.append(own)
    rows = []
    for own, label in zip(per_row, toxic, strict=True):
        best = [max((_weight(c[1] - label, c[0] - (1 - label), share) for c in found if c[1] > label), default=0.0) for found in own]
        rows.append(evidence([w for w in best if w > 0]))
    weights = {f: w for f, c in counts.items() if (w := _weight(c[1], c[0], share)) > 0.5}
    return Model(costs, weights, _logistic(np.array(rows), np.array(toxic, float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton's method with a small ridge."""
    beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


# --- on tables --------------------------------------------------------------------


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the key as text divides by 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """A model from the language of all ``docs`` and about ``rows`` labelled ones.

    Only rows that are not held out count; more than ``rows`` of them are thinned by a
    hash of the key. Null labels, keys and texts are left out; of repeated labels the larger
    counts. Without labels of both kinds, every score is the share of toxic rows.
    """
    ident = F.col(f"`{key}`")
    known = labels.select(ident.cast("long").alias("key"), F.col(f"`{label_col}`").alias("label")).filter("key is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("key"))).groupBy("key").agg(F.max("label").alias("label"))
    n = known.count()
    if n > rows:
        steps = 1 << 30
        known = known.filter(F.pmod(F.xxhash64("key"), F.lit(steps)) < int(rows / n * steps))
    texts = docs.select(ident.cast("long").alias("key"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    # About ``rows`` keys: few bytes whatever the corpus.
    chosen = texts.join(F.broadcast(known), "key")
    costs = language_model(docs, text_col)
    return _fit_in_task(chosen, costs)


def _fit_in_task(chosen: DataFrame, costs: np.ndarray) -> Model:
    """Fit in one task on the bounded sample; the model, not the texts, reaches the driver."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("label").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode("utf-8", "replace")), texts[i]))
        model = fit([texts[i] for i in order], [int(toxic[i]) for i in order], costs)
        del texts, toxic, order
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.weights, model.logistic))], pa.binary())], ["model"])

    row = chosen.select("text", "label").repartition(1).mapInArrow(run, "model binary").first()
    weights, logistic = pickle.loads(row[0]) if row else ({}, fit([], [], costs).logistic)
    return Model(costs, weights, logistic)



def score(docs: DataFrame, model: Model, text_col: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with each text's score from 0 to 1; null and empty texts get a score, too.

    Every row stays; an input column named like ``output`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            texts = (t for at in range(0, len(batch), 512) for t in batch.slice(at, 512).to_pylist())
            yield pa.array([shared.value.score(t) for t in texts], pa.float64())

    return docs.withColumn(output, scores(F.col(f"`{text_col}`")))
