"""Toxicity: a learned lexicon, met by Levenshtein automata, judged in its context.

Lexicon. Words, and beginnings of words (stems), that are far more frequent in documents
labelled toxic become terms. They stand in a trie. A text's word is a term if the
automaton of its Levenshtein neighbourhood (one edit, of which a swap of neighbouring
characters is one) and the trie have a common path;
words that are frequent in clean documents themselves are never taken for a misspelling.

Context. Each place of a term looks at the ``WINDOW`` words on both sides: quotation marks
around it or words of reporting make it a quotation, further terms make it abuse.

Score. A logistic regression over a document's places (number, weight, kind, density, most
in a window, quotations) gives the score. Lexicon and regression are learned from
different rows.

Learning uses at most ``SAMPLE`` labelled rows, those with the smallest hash of their id,
with ``crc32(doc_id)`` mod 3 not 1; equal texts count once. All documents are scored, on
their whole texts. Neither labels, lang, source nor doc_id go into a score.

Cases: null and empty texts have no places, and get the score of such a text. Rows with a
null ``doc_id`` are scored and never learned from. Without labelled rows of both classes
all scores are 0. Empty tables give an empty result. Other columns, whatever their names,
are ignored by ``scored`` and passed on by ``clean``.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.llm import common

SAMPLE = 40_000
THRESHOLD = 0.7
#: Words on each side that make a place's context.
WINDOW = 8
#: A term's documents: at least so many labelled toxic, and that share of all such.
LEAST_DOCS, LEAST_SHARE = 4, 0.01
#: Least log odds ratio of a term, and least deviations from chance.
LEAST_WEIGHT, LEAST_Z = 1.5, 5.0
MOST_TERMS = 4000
STEM_SIZES = range(4, 9)
#: Terms shorter than this are not met with an edit.
FUZZY_FROM = 4
CACHE_WORDS = 150_000

#: Words of reporting, and quotation marks.
REPORTING = frozenset("said says quoted quote quotes called word words term terms wrote writes sic dit mot wort sagte dijo palabra".split())
MARKS = "\"“”„«»‘’'`"
STRIP = MARKS + ".,;:!?()[]{}<>|%&$#*+-=_/\\~^@"

NOTHING, EXACT, STEM, FUZZY = range(4)


class Trie:
    """Terms with numbers; ``nearest`` intersects it with a word's automaton."""

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        #: Half the length of the shortest term at or below each node.
        self.half: list[int] = [min((len(term) // 2 for term in terms), default=0)]
        for number, term in enumerate(terms):
            node, half = 0, len(term) // 2
            for char in term:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.half.append(half)
                node = self.children[node][char]
                self.half[node] = min(self.half[node], half)
            self.term[node] = number

    def longest_prefix(self, word: str) -> int:
        """Number of the longest term that the word begins with, or -1."""
        node, found = 0, -1
        for char in word:
            node = self.children[node].get(char, -1)
            if node < 0:
                break
            if self.term[node] >= 0:
                found = self.term[node]
        return found

    def nearest(self, word: str, edits: int = 1, from_middle: bool = False) -> int:
        """Number of a term within the edits, the closest and then the first; or -1.

        A state is a node of the trie with a state of the word's Levenshtein automaton:
        characters read, and edits left. With ``from_middle`` an edit is made only in the
        last half of a term; a swap may begin right before it.
        """
        best, least = -1, edits + 1
        size = len(word)
        todo = [(0, 0, edits)]
        seen = set(todo)
        while todo:
            node, i, left = todo.pop()
            while True:  # without an edit as far as it goes
                number = self.term[node]
                if number >= 0 and size - i <= left:
                    away = edits - left + size - i
                    if away < least or away == least and number < best:
                        best, least = number, away
                after: list[tuple[int, int, int]] = []
                if left and (not from_middle or i >= self.half[node]):
                    after += [(node, i + 1, left - 1)] if i < size else []  # only the word has the character
                    for char, child in self.children[node].items():
                        after.append((child, i, left - 1))  # only the term has it
                        if i < size and char != word[i]:
                            after.append((child, i + 1, left - 1))
                if left and i + 1 < size and word[i] != word[i + 1]:
                    swapped = self.children[node].get(word[i + 1], -1)
                    child = self.children[swapped].get(word[i], -1) if swapped >= 0 else -1
                    if child >= 0 and (not from_middle or i + 1 >= self.half[child]):
                        after.append((child, i + 2, left - 1))
                if after:
                    if left > 1:  # several ways may lead to a state
                        after = [state for state in after if state not in seen]
                        seen.update(after)
                    todo += after
                if i == size:
                    break
                node = self.children[node].get(word[i], -1)
                if node < 0:
                    break
                i += 1
        return best


@dataclass
class Model:
    """What was learned; its size is bounded by MOST_TERMS."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Words next to a term that are clean words of their own.
    own: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    #: Tells models apart in a Python worker.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _matcher(model: Model) -> Matcher:
    """One for all tasks of a Python worker, which keeps the words it has seen."""
    return common.kept_in_worker(("matcher", model.key), lambda: Matcher(model))


class _Seen(dict):
    """Codes of the words met so far."""

    def __init__(self, matcher: Matcher) -> None:
        super().__init__()
        self.matcher = matcher

    def __missing__(self, token: str) -> int:
        self[token] = code = self.matcher._look_up(token.strip(STRIP))
        return code


class Matcher:
    """Code of each word: kind and term; remembers the words it has seen."""

    def __init__(self, model: Model) -> None:
        self.terms = list(model.words)
        self.stems = list(model.stems)
        self.weight = np.array([0.0, *model.words.values(), *model.stems.values()])
        self.own = model.own
        self.number = {term: number for number, term in enumerate(self.terms)}
        self.stem_trie = Trie(self.stems)
        self.beginnings = {stem[: STEM_SIZES.start] for stem in self.stems}
        # One edit leaves the first or the last half of a term as it is.
        fuzzy = [term for term in self.terms if len(term) >= FUZZY_FROM]
        self.forward = Trie(fuzzy)
        self.backward = Trie([term[::-1] for term in fuzzy])
        self.fuzzy_number = [self.number[term] for term in fuzzy]
        self.sizes = {len(term) + d for term in fuzzy for d in (-1, 0, 1)}
        self.seen = _Seen(self)

    def near(self, word: str) -> int:
        """Number of the term that the word misspells, or -1."""
        if len(word) not in self.sizes:
            return -1
        if word in self.number and len(word) >= FUZZY_FROM:
            return self.number[word]
        ways = self.forward.nearest(word, 1, True), self.backward.nearest(word[::-1], 1, True)
        found = min((way for way in ways if way >= 0), default=-1)
        return self.fuzzy_number[found] if found >= 0 else -1

    def _look_up(self, word: str) -> int:
        """0, or term * 4 + kind, terms counted from 1, stems after words."""
        if not word:
            return NOTHING
        number = self.number.get(word, -1)
        if number >= 0:
            return (number + 1) * 4 + EXACT
        if word[: STEM_SIZES.start] in self.beginnings:
            number = self.stem_trie.longest_prefix(word)
            if number >= 0:
                return (len(self.terms) + number + 1) * 4 + STEM
        if word not in self.own:
            number = self.near(word)
            if number >= 0:
                return (number + 1) * 4 + FUZZY
        return NOTHING

    def codes(self, tokens: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > CACHE_WORDS:
            seen.clear()
        return np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))


def is_quotation(tokens: list[str], at: int) -> bool:
    """Whether marks stand around the place, or a word of reporting stands near it."""
    before = tokens[max(0, at - WINDOW) : at + 1]
    after = tokens[at : at + WINDOW + 1]
    if any(t[0] in MARKS for t in before) and any(t.rstrip(".,;:!?")[-1:] in MARKS and t.rstrip(".,;:!?") for t in after):
        return True
    return any(t.strip(STRIP) in REPORTING for t in [*before[:-1], *after[1:]])


def features(text: str | None, matcher: Matcher) -> np.ndarray:
    """What the regression sees of a text."""
    tokens = (text or "").lower().split()
    codes = matcher.codes(tokens)
    places = np.flatnonzero(codes)
    if not len(places):
        return np.array([0.0] * 10 + [np.log1p(len(tokens))])
    kinds, weights = codes[places] & 3, matcher.weight[codes[places] >> 2]
    quoted = np.array([is_quotation(tokens, int(p)) for p in places])
    abuse = ~quoted
    # Most weight within one window.
    upto = np.concatenate([[0.0], np.cumsum(weights * abuse)])
    ends = np.searchsorted(places, places + 2 * WINDOW, "right")
    densest = float((upto[ends] - upto[np.arange(len(places))]).max())
    size = len(tokens)
    exact, stem, fuzzy = (abuse & (kinds == k) for k in (EXACT, STEM, FUZZY))
    return np.array(
        [
            np.log1p(weights[exact].sum()),
            np.log1p(weights[stem].sum()),
            np.log1p(weights[fuzzy].sum()),
            np.log1p(exact.sum()),
            np.log1p(100 * weights[abuse].sum() / size),
            np.log1p(100 * weights[exact].sum() / size),
            np.log1p(100 * weights[stem].sum() / size),
            np.log1p(densest),
            np.log1p(len(np.unique(codes[places][abuse]))),
            np.log1p(quoted.sum()),
            np.log1p(size),
        ]
    )


def _third(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string")) % 3


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, part (0: lexicon, 2: regression); at most SAMPLE rows, each text once."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_third(F.col("doc_id")) != 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("body"))
    once = (
        slim.join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most
        .groupBy("body")
        .agg(F.min(F.struct("doc_id", "toxic")).alias("row"))
        .select("row.*")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (
        texts.join(F.broadcast(common.durable(once)), "doc_id")
        .dropDuplicates(["doc_id"])
        .select("text", "toxic", _third(F.col("doc_id")).cast("int").alias("part"))
    )


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, n, t: documents of the lexicon's part with the word, and toxic ones among them."""

    def counted(n: Counter[str], t: Counter[str]) -> Iterator[pd.DataFrame]:
        words = list(n)
        for at in range(0, len(words), 10_000):  # small frames, and none without rows
            part = words[at : at + 10_000]
            yield pd.DataFrame({"word": part, "n": [n[w] for w in part], "t": [t[w] for w in part]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        t: Counter[str] = Counter()
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                found = {w.strip(STRIP) for w in (text or "").lower().split()}
                n.update(found)
                if toxic:
                    t.update(found)
                if len(n) > CACHE_WORDS:
                    yield from counted(n, t)
                    n.clear()
                    t.clear()
        yield from counted(n, t)

    part = rows.filter("part = 0").select("text", "toxic")
    return (
        part.mapInPandas(run, "word string, n long, t long")
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    )


def _telling(counts: DataFrame, name: str, clean: int, toxic: int) -> dict[str, float]:
    """Terms with their log odds ratio, the most frequent in toxic documents first."""
    share = toxic / (clean + toxic)
    weight = F.log(
        (F.col("t") + 0.5) / (toxic + 1) / (F.greatest(F.col("n") - F.col("t"), F.lit(0)) + 0.5) * (clean + 1)
    )
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    rows = (
        counts.filter(F.col("t") >= max(LEAST_DOCS, LEAST_SHARE * toxic))
        .withColumn("weight", weight)
        .filter((F.col("weight") >= LEAST_WEIGHT) & (z >= LEAST_Z))
        .orderBy(F.desc("t"), name)
        .limit(MOST_TERMS)
        .collect()
    )
    return {row[name]: row.weight for row in rows}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = common.durable(learning_rows(docs, labels))
    size = {(r.part, r.toxic): r["count"] for r in rows.groupBy("part", (F.col("toxic") > 0).alias("toxic")).count().collect()}
    if not all(size.get((part, toxic)) for part in (0, 2) for toxic in (False, True)):
        return Model()
    clean, toxic = size[0, False], size[0, True]
    counts = common.durable(_word_counts(rows))
    stems = (
        counts.select(
            F.explode(F.array_distinct(F.array(*(F.substring("word", 1, k) for k in STEM_SIZES)))).alias("stem"),
            "word", "n", "t",
        )
        .filter(F.char_length("stem") >= STEM_SIZES.start)
        .groupBy("stem")
        .agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.count("*").alias("words"))
        .filter("words >= 3")
    )
    model = Model(_telling(counts, "word", clean, toxic), _telling(stems, "stem", clean, toxic))
    # Of stems that say the same, the shortest stays.
    for stem in sorted(model.stems, key=len, reverse=True):
        if any(stem != s and stem.startswith(s) and model.stems[s] >= model.stems[stem] - 0.5 for s in model.stems):
            del model.stems[stem]
    model.own = _own_words(counts, model)
    return _fitted(rows, model)


def _own_words(counts: DataFrame, model: Model) -> frozenset[str]:
    """Frequent words one edit from a term that are not terms: as many as terms have neighbours."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for frame in frames:
            yield frame[[matcher.near(word) >= 0 for word in frame["word"]]]

    frequent = counts.filter("n >= 3").select("word")
    return frozenset(r.word for r in frequent.mapInPandas(run, "word string").collect()) - model.words.keys()


def _fitted(rows: DataFrame, model: Model) -> Model:
    """The model with a regression over the features of the rows of its part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(model)
        for frame in frames:
            yield pd.DataFrame(
                {"x": [features(text, matcher).tolist() for text in frame["text"]], "y": frame["toxic"].clip(0, 1)}
            )

    part = rows.filter("part = 2").select("text", "toxic").mapInPandas(run, "x array<double>, y int").toPandas()
    x, y = np.array(part["x"].tolist()), part["y"].to_numpy(float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 0.5)
    ridge[0] = 1e-6
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def score(x: np.ndarray, model: Model) -> np.ndarray:
    if model.weights is None:
        return np.zeros(len(x))
    z = (x - model.mean) / model.scale @ model.weights[1:] + model.weights[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    return _with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])


def _with_score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The columns, and ``score`` of ``text``, as the last column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(shared.value)
        for frame in frames:
            x = np.array([features(text, matcher) for text in frame["_text"]]).reshape(len(frame), -1)
            yield frame.drop(columns="_text").assign(_score=score(x, shared.value) if len(x) else np.zeros(0))

    source = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    schema = source.drop("_text").schema.add("_score", "double")
    return source.mapInPandas(run, schema).withColumnRenamed("_score", "score")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with their columns, whose score is below the threshold."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(shared.value)
        for part in parts:
            x = np.array([features(text, matcher) for text in part]).reshape(len(part), -1)
            yield pd.Series(score(x, shared.value) if len(x) else np.zeros(0))

    return docs.filter(of_text(F.col("text").cast("string")) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        F.coalesce(_third(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
