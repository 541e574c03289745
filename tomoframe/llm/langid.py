"""The language of each document and of each passage in it.

A sentence is the mean of the hashed embeddings of its words and their parts, and a linear softmax over it gives the
language. The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled documents. Labels
are partly wrong: first two models are trained on a half of the sentences each and judge the labels of the other half.
Confidence is calibrated on held-out sentences against the labels as they stand: the temperature of the softmax and the share of wrong labels are what makes these labels most likely.
Sentences that differ in digits, case or accents only count once, so that none is held out and trained on. The model that is used is then
trained on the held-out sentences too. Below the lowest
confidence at which all that is above it is expected to be right in PRECISION of the cases, a sentence has no language.

Training runs on the driver over at most SAMPLE documents per language; everything else runs over all documents, each
whole, in one pass without a shuffle.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.llm.mailtext import sentences, unpunctuated
from tomoframe.session import spread

# The languages with the codes and English names they go by, and Cyrillic letters in Latin.
LANGUAGES = "en de fr es it pt nl sv pl ru ja".split()
SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish castilian", "it": "it ita italian",
    "pt": "pt por portuguese", "nl": "nl nld dut dutch flemish", "sv": "sv swe swedish", "pl": "pl pol polish", "ru": "ru rus russian", "ja": "ja jpn japanese jp",
}
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "), strict=True))
PLAIN = {"ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ı": "i", "þ": "th"}

#: Labelled documents per language in the training sample, sentences per language, and texts longer than this aren't drawn.
SAMPLE, SENTENCES, LONGEST = 400, 1200, 20_000
BUCKETS, DIMENSION, RATE, BATCH = 1 << 16, 16, 1.2, 64
#: Every sentence is shown EPOCHS times, few sentences more often, so that SHOWN are shown in all; to judge labels, a half as often.
EPOCHS, SHOWN = 5, 25_000
#: Share of the sentences that are held out, and how many of them per language are used at most.
HELD, HELD_SENTENCES = 0.2, 600
#: A label that a sentence has so many times more often than any other is not doubted.
CERTAIN = 4
#: Expected share of right ones among sentences with at least the threshold's confidence.
PRECISION = 0.998
NONE = "und"
CLASSES = [*LANGUAGES, NONE]

_FOLD = str.maketrans({**CYRILLIC, **PLAIN})
_WORDS = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}ー]{1,6}|[^\W\d_]+(?:['’?][^\W\d_]+)*")
_DIGITS = regex.compile(r"\d+")
_MARKS = regex.compile(r"\p{Mn}+")
_CAN_FOLD = regex.compile(r"[^\x00-\x7f]")
_KANA = regex.compile(r"[\u3040-\u30ff]")


def declared(lang: Column) -> Column:
    """The code that a label names in any spelling; null if it names none of LANGUAGES."""
    word = F.regexp_replace(F.lower(F.trim(lang)), "[-_].*$", "")
    pairs = [F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), word)


def folded(text: str) -> str:
    """Small letters without accents, Cyrillic in Latin letters."""
    text = text.lower()
    if _CAN_FOLD.search(text):
        kept = text.replace("й", "\ue000").replace("ё", "е")
        text = _MARKS.sub("", unicodedata.normalize("NFD", kept)).replace("\ue000", "й") if not _KANA.search(kept) else kept
        text = text.translate(_FOLD)
    return text


def parts(word: str) -> list[int]:
    """Buckets of a word and of its parts of one to five letters; of Japanese, of its characters and pairs."""
    if ord(word[0]) >= 0x3040:
        grams = [*word, *(word[i : i + 2] for i in range(len(word) - 1))]
    else:
        w = f"<{word.replace('?', '')}>"
        grams = [w, *(w[i : i + n] for n in (2, 3, 4, 5) for i in range(len(w) - n + 1) if n < len(w))]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


@dataclass
class Model:
    """logits: of each bucket, for each class; divided by `temperature` for the confidence. `agreement` with the labels of
    held-out sentences, of which `wrong_labels` are estimated to be wrong."""

    logits: np.ndarray
    temperature: float
    threshold: float
    agreement: float
    wrong_labels: float


class Classifier:
    """A model, with the summed logits of the words seen so far in this task."""

    #: Words kept before they are forgotten again.
    MOST_WORDS = 200_000

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows = np.zeros((1024, len(CLASSES) + 1), np.float32)

    def _row(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            at = self.known[word] = len(self.known)
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            ids = parts(word)
            self.rows[at, :-1] = self.model.logits[ids].sum(0)
            self.rows[at, -1] = len(ids)
        return at

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class of each sentence and the confidence: NONE and 0 where it has fewer than three words."""
        if len(self.known) > self.MOST_WORDS:
            self.known.clear()
        flat: list[int] = []
        starts = np.zeros(len(texts), np.int64)
        few = np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            words = _WORDS.findall(folded(t))
            starts[i] = len(flat)
            few[i] = len(words) < 3 and sum(len(w) for w in words if w[0] >= "\u3040") < 8
            flat += [self._row(w) for w in words] or [self._row("-")]
        if not texts:
            return np.empty(0, np.int64), np.empty(0)
        sums = np.add.reduceat(self.rows[np.array(flat)], starts)
        p = softmax(sums[:, :-1] / np.maximum(1, sums[:, -1:]) / self.model.temperature)
        best = p.argmax(1)
        sure = p[np.arange(len(p)), best]
        return np.where(few, len(LANGUAGES), best), np.where(few, 0.0, sure)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _features(texts: list[str]) -> list[np.ndarray]:
    cache: dict[str, list[int]] = {}
    out = []
    for t in texts:
        ids: list[int] = []
        for w in _WORDS.findall(folded(t)) or ["-"]:
            if w not in cache:
                cache[w] = parts(w)
            ids += cache[w]
        out.append(np.array(ids, np.int32))
    return out


def _descend(features: list[np.ndarray], y: np.ndarray, seed: int, part: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and output weights by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    e = (rng.random((BUCKETS, DIMENSION), np.float32) - 0.5) / DIMENSION
    w = np.zeros((DIMENSION, len(CLASSES)), np.float32)
    sizes = np.array([len(f) for f in features])
    epochs = max(1, round(part * max(EPOCHS, -(-SHOWN // max(1, len(y))))))
    steps = epochs * -(-len(y) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            used, at = np.unique(np.concatenate([features[i] for i in rows]), return_inverse=True)
            # The share that each bucket has of each sentence, as a small dense matrix.
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            shares = np.bincount(owner * len(used) + at, minlength=len(rows) * len(used)).reshape(len(rows), -1)
            shares = (shares / sizes[rows, None]).astype(np.float32)
            h = shares @ e[used]
            g = softmax(h @ w)
            g[np.arange(len(rows)), y[rows]] -= 1
            rate = np.float32(RATE * (1 - step / steps))
            into = g @ w.T
            w -= rate * (h.T @ g)
            e[used] -= rate * (shares.T @ into)
            step += 1
    return e, w


def _scores(features: list[np.ndarray], logits: np.ndarray) -> np.ndarray:
    return np.stack([logits[f].mean(0) for f in features])


def _noise(rng: np.random.Generator, n: int) -> list[str]:
    """Sentences without sense, made of random letters; they stand for no language."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    return [" ".join("".join(rng.choice(letters, rng.integers(2, 11))) for _ in range(rng.integers(4, 14))) for _ in range(n)]


def calibrated(raw: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The temperature of the scores, and the share of wrong labels, at which the labels are most likely; a wrong label is
    taken to be any of the others."""
    rows = np.arange(len(truth))

    def loss(t: float, wrong: float) -> float:
        p = softmax(raw / t)[rows, truth]
        return float(-np.log((1 - wrong) * p + wrong * (1 - p) / (raw.shape[1] - 1) + 1e-12).sum())

    return min(((t / 20, w / 200) for t in range(4, 61) for w in range(0, 61)), key=lambda x: loss(*x))


def threshold_of(sure: np.ndarray, precision: float) -> float:
    """The lowest confidence at which that of everything above it is `precision` on average; above 1 if there is none."""
    order = np.sort(sure)[::-1]
    good = np.cumsum(order) / np.arange(1, len(order) + 1) >= precision
    return float(order[np.flatnonzero(good)[-1]]) if good.any() else 1.1


def distinct(labelled: list[tuple[str, str]]) -> dict[str, list[tuple[str, int]]]:
    """The sentences of each language, those that differ in digits, case or accents only once, and by how many labels each has
    that language rather than the next. One that stands under several labels has the one that is at least twice as frequent
    as the next; without such a one it says nothing and is left out."""
    labels: dict[str, Counter] = {}
    first: dict[str, str] = {}
    for text, lang in labelled:
        form = _DIGITS.sub("0", " ".join(folded(text).split()))
        labels.setdefault(form, Counter())[lang] += 1
        first.setdefault(form, text)
    by: dict[str, list[tuple[str, int]]] = {c: [] for c in LANGUAGES}
    for form, counts in labels.items():
        (lang, n), *others = counts.most_common(2)
        next_n = others[0][1] if others else 0
        if n >= 2 * next_n:
            by[lang].append((first[form], n - next_n))
    return by


def train(labelled: list[tuple[str, str]], seed: int = 1) -> Model:
    """A model of (sentence, language) pairs of which part may be wrong."""
    rng = np.random.default_rng(seed)
    texts, support, y, held = [], [], [], []
    for c, own in distinct(labelled).items():
        n_held = min(HELD_SENTENCES, int(len(own) * HELD))
        own = [own[i] for i in rng.permutation(len(own))[: n_held + SENTENCES]]
        texts += [t for t, _ in own]
        support += [n for _, n in own]
        y += [CLASSES.index(c)] * len(own)
        held += [i < n_held for i in range(len(own))]
    n_noise = SENTENCES // 3
    texts += _noise(rng, n_noise)
    y = np.array(y + [len(LANGUAGES)] * n_noise)
    certain = np.array(support + [CERTAIN] * n_noise) >= CERTAIN
    held = np.array(held + [i < HELD * n_noise for i in range(n_noise)])
    half = rng.permutation(len(y)) % 2
    features = _features(texts)

    def fitted_on(rows: np.ndarray, labels: np.ndarray, seed: int, part: float = 1.0) -> np.ndarray:
        e, w = _descend([features[i] for i in rows], labels[rows], seed, part)
        return (e @ w).astype(np.float32)

    def scores(logits: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return _scores([features[i] for i in rows], logits)

    with ThreadPoolExecutor(2) as both:
        # Each half is judged by a model of the other half. A contradicted label is left out, or replaced where that model is sure,
        # unless the sentence has it very often.
        parts = [np.flatnonzero(half == h) for h in (0, 1)]
        p = np.zeros((len(y), len(CLASSES)))
        for h, logits in enumerate(both.map(lambda h: fitted_on(parts[1 - h], y, seed, 0.5), (0, 1))):
            p[parts[h]] = softmax(scores(logits, parts[h]) * 4)
        guess, sure = np.where(certain, y, p.argmax(1)), p.max(1)
        kept = (guess == y) | (sure > 0.9)
        # One model without the held-out sentences is calibrated on them; the one that is used has them as well.
        without, logits = both.map(lambda rows: fitted_on(rows, guess, seed + 1), (np.flatnonzero(kept & ~held), np.flatnonzero(kept)))
    if not held.any():
        return Model(logits, 1.0, 0.5, 0.0, 0.0)
    raw, truth = scores(without, np.flatnonzero(held)), y[held]
    temperature, wrong = calibrated(raw, truth)
    p = softmax(raw / temperature)
    named = p.argmax(1) < len(LANGUAGES)
    return Model(logits, temperature, threshold_of(p.max(1)[named], PRECISION), float((p.argmax(1) == truth).mean()), wrong)


def sample(documents: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """Sentences of about `per_language` labelled documents of each language, chosen by a hash of their id."""
    known = documents.select("doc_id", declared(F.col("lang")).alias("code"), "text").where("code is not null")
    counts = known.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["code"], min(1.0, per_language / r["n"])))) if counts else None
    if share is None:
        return []
    u = F.shiftrightunsigned(F.xxhash64(F.lit(8), "doc_id"), 11) / F.lit(float(2**53))
    drawn = known.where((u < share[F.col("code")]) & (F.length("text") <= LONGEST)).limit(2 * per_language * len(LANGUAGES)).select("doc_id", "code", "text").collect()
    return [(s, r["code"]) for r in sorted(drawn, key=lambda r: (r["doc_id"] is None, r["doc_id"])) for flow in sentences(r["text"]) for s in flow]


#: Confidence that is enough beside a sentence of the same language that reaches the threshold.
ENOUGH = 0.5


def _settled(flows: list[list[str]], classes: np.ndarray, sure: np.ndarray, threshold: float) -> np.ndarray:
    """The classes, with NONE for sentences below the threshold that no neighbour in their flow supports. Sentences of too
    few words to tell take the class of those before and after them in their flow if it is the same."""
    none = len(LANGUAGES)
    out = np.where(sure >= threshold, classes, none)
    flow = np.repeat(np.arange(len(flows)), [len(f) for f in flows])
    for step in (1, -1):  # what a neighbour supports may support the next one
        order = range(len(out)) if step == 1 else range(len(out) - 1, -1, -1)
        for i in order:
            j = i - step
            if out[i] == none and sure[i] >= ENOUGH and 0 <= j < len(out) and flow[i] == flow[j] and classes[i] == out[j]:
                out[i] = classes[i]
    told = np.flatnonzero(sure > 0)
    for a, b in zip(told[:-1].tolist(), told[1:].tolist()):
        if b - a > 1 and out[a] == out[b] and flow[a] == flow[b]:
            out[a + 1 : b] = out[a]
    return out


def _runs(flows: list[list[str]], classes: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, int, int, float, int]]:
    """(first sentence, sentences, class, confidence, characters) of each run of sentences with one class."""
    k = 0
    for flow in flows:
        i = 0
        while i < len(flow):
            j = i
            while j + 1 < len(flow) and classes[k + j + 1] == classes[k + i]:
                j += 1
            yield k + i, j - i + 1, int(classes[k + i]), float(sure[k + i : k + j + 1].mean()), sum(map(len, flow[i : j + 1]))
            i = j + 1
        k += len(flow)


def _documents(batches: Iterator[pa.RecordBatch], classifier: Classifier) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    """Each document's runs. Sentences of many documents are classified at once."""
    model = classifier.model
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for k in range(0, len(texts), 256):
            flows = [sentences(t) if t else [] for t in texts[k : k + 256]]
            classes, sure = classifier.classify([s for d in flows for f in d for s in f])
            at = 0
            for i, d in enumerate(flows):
                n = sum(map(len, d))
                settled = _settled(d, classes[at : at + n], sure[at : at + n], model.threshold)
                yield batch, k + i, list(_runs(d, settled, sure[at : at + n]))
                at += n


def _passages(shared, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            doc, code, first, n, lang, sure = zip(*rows) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(code, pa.string()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "declared", "first_sentence", "n_sentences", "passage_lang", "confidence"])

        for batch, i, runs in _documents(batches, Classifier(shared.value)):
            for first, n, c, sure, _ in runs:
                if c < len(LANGUAGES) and n >= shortest:
                    rows.append((batch.column("doc_id")[i].as_py(), batch.column("declared")[i].as_py(), first, n, LANGUAGES[c], sure))
            if len(rows) >= 10_000:
                yield out()
                rows = []
        yield out()

    return run


def _whole(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64()))], names=["doc_id", "declared", "language", "confidence"])

        classifier = Classifier(shared.value)
        for batch, i, runs in _documents(batches, classifier):
            size, weight = np.zeros(len(CLASSES)), np.zeros(len(CLASSES))
            for _, _, c, sure, chars in runs:
                size[c] += chars
                weight[c] += sure * chars
            text = batch.column("text")[i].as_py()
            if not size[:-1].any() and text:  # no sentence tells: what stands there without a full stop
                loose = unpunctuated(text)
                for p, c, sure in zip(loose, *classifier.classify(loose)):
                    c = c if sure >= shared.value.threshold else len(LANGUAGES)
                    size[c] += len(p)
                    weight[c] += sure * len(p)
            best = int(size[:-1].argmax())
            there = size[best] > 0
            rows.append((batch.column("doc_id")[i].as_py(), batch.column("declared")[i].as_py(), CLASSES[best] if there else NONE, weight[best] / size.sum() if there else 0.0))
            if len(rows) >= 10_000:
                yield out()
                rows = []
        yield out()

    return run


def fitted(documents: DataFrame, per_language: int = SAMPLE) -> Model:
    """A model of `documents` (doc_id, text, lang), to be used for as many calls of `passages` and `languages` as wanted."""
    return train(sample(documents, per_language))


def _judged(documents: DataFrame, run, schema: str, model: Model | None, per_language: int) -> DataFrame:
    """`run` over all documents with a model, which is broadcast; its size is that of BUCKETS x classes."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fitted(documents, per_language))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), declared(F.col("lang")).alias("declared"), "text")
    return spread(rows).mapInArrow(run(shared), schema)


def passages(documents: DataFrame, shortest: int = 2, per_language: int = SAMPLE, model: Model | None = None) -> DataFrame:
    """doc_id, declared (code of the label or null), first_sentence, n_sentences, passage_lang, confidence of each run
    of at least `shortest` consecutive sentences in one language.

    documents: doc_id BIGINT, text, lang. Null, empty and blank texts have no passages, nor have texts without an end of a
    sentence. Rows with equal ids are judged each. Without a `model` one is fitted to the documents.
    """
    return _judged(documents, lambda shared: _passages(shared, shortest), "doc_id bigint, declared string, first_sentence int, n_sentences int, passage_lang string, confidence double", model, per_language)


def languages(documents: DataFrame, per_language: int = SAMPLE, model: Model | None = None) -> DataFrame:
    """doc_id, declared, language and confidence of every document: the language of most of its sentences, or where none has
    one of most of its other text; 'und' without either."""
    return _judged(documents, _whole, "doc_id bigint, declared string, language string, confidence double", model, per_language)
