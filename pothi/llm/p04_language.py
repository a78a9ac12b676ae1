"""Missing or wrong document language labels (problem 4).

Error-correcting output codes: every language has a codeword, and for every bit
of it a binary classifier on character n-grams of words (naive Bayes on
hashed n-grams of one to four characters and whole words). A sentence gets the language whose
codeword has the least loss over the bits, each weighed by its classifier's
margin; the gap to the next codeword gives the confidence (how often sentences
kept out of training are read right at such a gap), and a small gap marks the
sentence ambiguous. Ambiguous sentences, and those with too few letters,
take the language of their neighbours; runs of one language are stretches.

The classifiers are trained on the driver from at most ``per_class`` sentences
of each language, found by labels that agree with the folder in the id. Sanskrit
is learnt from verses, romanised Marathi from Latin text in Marathi works that
lacks the commonest English words. Both bounds are parameters; all text is then
classified. Words are scored once per process and looked up after that.

Defined results: null texts have no row; texts without a letter of a known
script have one stretch with language ``und`` and confidence 0; repeated ids
count once (the latest build); unknown labels name no language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.llm.p01_sentences import unit_ends
from pothi.llm.p02_encoding import unwind
from pothi.sources.tables import latest

# Classes, spellings of labels, the commonest English words.
CLASSES = ["en", "mr", "hi", "kn", "sa", "ja", "th", "mr-Latn"]
NAMES = {
    "en": "en eng english", "mr": "mr mar marathi मराठी", "hi": "hi hin hindi हिन्दी हिंदी", "kn": "kn kan kannada ಕನ್ನಡ",
    "sa": "sa san sanskrit संस्कृत संस्कृतम्", "ja": "ja jpn japanese 日本語", "th": "th tha thai ไทย ภาษาไทย", "mixed": "mixed mul multi multiple multilingual",
}
ENGLISH = frozenset("the of and in to was at with for that his her on by from had is it as he she they not but so until while".split())
BITS, FEATURES, PER_CLASS, AMBIGUOUS, ALPHA = 15, 1 << 16, 1500, 0.8, 3.0
_SPELLED = {x: k for k, v in NAMES.items() for x in v.split()}
_WORD = re.compile(r"[^\W\d_][\w‌‍ऀ-ॿಀ-೿฀-๿]*|[ऀ-ॿಀ-೿฀-๿‌‍]+")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")


def label_language(label: str | None) -> str | None:
    """Language (or ``mixed``) a label names, whatever its spelling; None if it names none."""
    if label is None:
        return None
    low = label.strip().lower()
    return _SPELLED.get(low) or _SPELLED.get(re.split(r"[-_ ]", low)[0] if low else "")


def codewords(bits: int = BITS, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per class, far apart from the others; the best of many random draws."""
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(400):
        c = rng.choice([-1, 1], (len(CLASSES), bits))
        if (np.abs(c.sum(0)) == len(CLASSES)).any():
            continue
        d = min(int((c[i] != c[j]).sum()) for i in range(len(c)) for j in range(i))
        if d > far:
            best, far = c, d
    return best.astype(np.float32)


def _hash(gram: str) -> int:
    h = 2166136261
    for x in gram:
        h = ((h ^ ord(x)) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % FEATURES


def _gram_hashes(w: str) -> list[int]:
    """``_hash`` of the runs of one to four characters of a long word, each with its length before it."""
    points, out = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), []
    for n in (1, 2, 3, 4):
        h = np.full(max(0, len(points) - n + 1), (2166136261 ^ ord(str(n))) * 16777619 & 0xFFFFFFFF, np.uint64)
        for k in range(n):
            h = ((h ^ points[k : k + len(h)]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        out += ((h ^ (h >> np.uint64(15))) % np.uint64(FEATURES)).tolist()
    return out


def word_features(word: str) -> list[int]:
    w = f"<{word.lower()}>"
    grams = [_hash(f"{n}{w[i : i + n]}") for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] if len(w) < 24 else _gram_hashes(w)
    return grams + [_hash(w)] * 3


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, calibration: tuple[float, float] = (0.0, 1.0)):
        self.weights, self.bias, self.codes, self.calibration = weights, bias, codewords(), calibration
        self._rows: dict[str, int] = {}
        self._scores = np.zeros((1024, BITS + 1), np.float32)

    def _row(self, word: str) -> int:
        """Row of a word's scores: sums over its n-grams, and their number."""
        k = self._rows.get(word)
        if k is None:
            k = len(self._rows)
            if k == len(self._scores):
                self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
            f = word_features(word)
            self._scores[k, :-1] = self.weights[f].sum(0)
            self._scores[k, -1] = len(f)
            self._rows[word] = k
        return k

    def nearest(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of the codeword with the least loss, and its gap to the next of another language, for each row."""
        margin = sums / np.maximum(1.0, n)[:, None] * ALPHA + self.bias
        loss = np.stack([np.log1p(np.exp(-np.clip(c * margin, -30, 30))).mean(1) for c in self.codes], 1)
        best = loss.argmin(1)
        names = np.array([c[:2] for c in CLASSES])
        others = np.where(names[None, :] == names[best][:, None], np.inf, loss)
        return best, others.min(1) - loss[np.arange(len(best)), best]

    def sure(self, gap: float) -> float:
        """How often a sentence with that gap is read right, by the sentences kept out of training."""
        a, b = self.calibration
        return float(1 / (1 + np.exp(-np.clip(a + b * gap, -30, 30))))

    def classify(self, sentences: list[str]) -> list[tuple[str, float, int]]:
        """Language, gap to the next, and letters of each sentence."""
        rows, starts, letters = [], [], []
        if len(self._rows) > 300_000:
            self._rows.clear()
        row = self._row
        for t in sentences:
            words = _WORD.findall(t)
            starts.append(len(rows))
            letters.append(sum(map(len, words)))
            rows += [row(w) for w in words]
        if not rows:
            return [("und", 0.0, 0)] * len(sentences)
        rows.append(0)
        total = np.add.reduceat(self._scores[np.array(rows)], np.array(starts), axis=0)
        best, gap = self.nearest(total[:, :-1], total[:, -1])
        return [(CLASSES[b][:2], float(g), n) if n else ("und", 0.0, 0) for b, g, n in zip(best, gap, letters)]

    def stretches(self, texts: list[str]) -> list[list[tuple[int, str, float, int, bool]]]:
        """start, language, confidence, sentences of each stretch of each text, and whether it is ambiguous."""
        bounds, sentences = [], []
        for text in texts:
            s, own = 0, []
            for e in unit_ends(text):
                part = text[s:e]
                start = s + len(part) - len(part.lstrip())
                own.append(start)
                sentences.append(readable(text[start:e]))
                s = e
            bounds.append(own)
        read, at, out = self.classify(sentences), 0, []
        for text, own in zip(texts, bounds):
            out.append(_runs(text, [(start, *r) for start, r in zip(own, read[at : at + len(own)])], self.sure))
            at += len(own)
        return out


def _runs(text: str, units: list[tuple[int, str, float, int]], sure_of: Callable[[float], float]) -> list[tuple[int, str, float, int, bool]]:
    if not units:
        return [(0, "und", 0.0, 0, True)] if text.strip() else []
    sure = [lang if letters >= 12 and gap >= AMBIGUOUS else None for _, lang, gap, letters in units]
    first = next((x for x in sure if x), None)
    if first is None:
        best = max(units, key=lambda u: (u[3] > 0, u[2]))
        return [(0, best[1], round(sure_of(best[2]), 6) if best[3] else 0.0, len(units), True)]
    out: list[list] = []
    now = first
    for (start, _, gap, _), lang in zip(units, sure):
        now = lang or now
        if out and out[-1][1] == now:
            out[-1][2].append(gap)
        else:
            out.append([start if out else 0, now, [gap]])
    return [(a, b, round(sure_of(float(np.mean(g))), 6), len(g), bool(np.mean(g) < AMBIGUOUS)) for a, b, g in out]


def readable(text: str) -> str:
    """A sentence with misread encodings undone, so that its letters can be judged."""
    if text.isascii() or not re.search("[à-åÃ‡Óвαа-яГР][^\x00-\x7f]", text):
        return text
    best, most = text, 3.0
    for chain in ("cp1252", "cp1252+cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251"):
        undone, n = unwind(text, chain)
        if n > most:
            best, most = undone, n
    return best


def train(samples: list[tuple[str, str]], rounds: int = 3) -> Model:
    """A model from (sentence, class) pairs.

    The classifier of a bit is naive Bayes between the classes with that bit and
    those without, each class weighing the same. Labels are noisy, so after each
    round but the last the sentences that the model reads otherwise are left out.
    """
    codes = codewords()
    every = [(np.array([f for w in _WORD.findall(t) for f in word_features(w)], np.int64), CLASSES.index(c)) for t, c in samples]
    # Every fifth sentence is kept out to tell how sure a gap makes.
    feats, kept = [x for i, x in enumerate(every) if i % 5], [x for i, x in enumerate(every) if i % 5 == 0 and len(x[0])]
    use = feats
    for k in range(rounds):
        counts = np.zeros((len(CLASSES), FEATURES))
        for f, c in use:
            np.add.at(counts[c], f, 1.0)
        known = counts.sum(1) > 0
        p = (counts + 0.02) / (counts + 0.02).sum(1, keepdims=True)
        weights = np.zeros((FEATURES, BITS), np.float32)
        for b in range(BITS):
            yes, no = (codes[:, b] > 0) & known, (codes[:, b] < 0) & known
            if yes.any() and no.any():
                weights[:, b] = np.clip(np.log(p[yes].mean(0)) - np.log(p[no].mean(0)), -6, 6)
        model = Model(weights, np.zeros(BITS, np.float32))
        if k + 1 < rounds:
            use = [(f, c) for f, c in feats if len(f) and model.nearest(weights[f].sum(0)[None], np.array([len(f)]))[0][0] == c]
    if kept:
        best, gap = model.nearest(np.stack([weights[f].sum(0) for f, _ in kept]), np.array([len(f) for f, _ in kept]))
        model.calibration = _calibrated(gap, best == np.array([c for _, c in kept]))
    return model


def _calibrated(gap: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Logistic curve of being right by the gap; one right and one wrong sentence more than seen keep it finite."""
    x, y = np.append(gap, [gap.mean()] * 2).astype(np.float64), np.append(right, [1, 0]).astype(np.float64)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        v = p * (1 - p) + 1e-6
        step = np.linalg.solve([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]], [(y - p).sum(), ((y - p) * x).sum()])
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def training_sample(rows: DataFrame, per_class: int = PER_CLASS) -> list[tuple[str, str]]:
    """At most ``per_class`` sentences of each class, from rows whose label and folder agree."""
    folder = F.split("id", "--").getItem(1)
    low = F.lower(F.trim("language"))
    spelled = F.create_map(*[F.lit(x) for kv in _SPELLED.items() for x in kv])
    named = F.coalesce(F.try_element_at(spelled, low), F.try_element_at(spelled, F.split(low, "[-_ ]").getItem(0)))
    verse = F.col("text").rlike("॥|।।")
    latin = F.col("text").rlike("[A-Za-z]{3}") & ~F.col("text").rlike("[ऀ-ॿ]") & ~F.lower("text").rlike(r"\b(the|of|and)\b")
    cls = F.when(verse, "verse").when((named == "mr") & latin, "mr-Latn").when(named == folder, named)
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("cls").orderBy(F.xxhash64("id")))
    # Ids are ranked, not texts; the window keeps the least of each task before its exchange.
    usable = rows.where("text IS NOT NULL AND kind_level = 'child'").select(cls.alias("cls"), "id", "text").where("cls IS NOT NULL AND cls <> 'mixed'")
    chosen = usable.select("cls", "id").withColumn("r", rank).where(F.col("r") <= per_class).select("cls", "id").distinct()
    # Bounded by per_class rows a class.
    picked = usable.join(F.broadcast(chosen), ["cls", "id"], "left_semi").select("cls", "id", "text").distinct().select("cls", "text").collect()
    out: dict[str, list[str]] = {}
    script = {"kn": "[ಀ-೿]", "ja": "[぀-ヿ]", "th": "[฀-๿]", "mr": "[ऀ-ॿ]", "hi": "[ऀ-ॿ]", "en": "[A-Za-z]", "mr-Latn": "[A-Za-z]"}
    for r in picked:
        s = 0
        for e in unit_ends(r.text):
            unit, s = r.text[s:e].strip(), e
            if r.cls == "verse":
                if re.search("(॥|।।)[ \\d०-९।॥]*$", unit) and re.search("[ऀ-ॿ]", unit):
                    out.setdefault("sa", []).append(unit)
            elif r.cls in script and re.search(script[r.cls], unit) and not re.search("॥|।।", unit) and len(unit) > 20:
                others = sum(len(re.findall(p, unit)) for k, p in script.items() if p != script[r.cls])
                if others < 0.2 * len(unit):
                    out.setdefault(r.cls, []).append(unit)
    return [(t, c) for c in CLASSES for t in out.get(c, [])[:per_class]]


def languages(df: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """id, named, segs(seg_start, language, confidence, sentences, ambiguous): all stretches of all rows of df(id, kind_level, language, text, built_at)."""
    rows = df.where("id IS NOT NULL AND text IS NOT NULL")
    model = train(training_sample(rows, per_class))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.calibration))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            ids, labels, built, texts = (batch.column(c).to_pylist() for c in ("id", "language", "built", "text"))
            for k in range(0, len(ids), 256):
                for i, segs in enumerate(own.stretches(texts[k : k + 256]), k):
                    out += [(ids[i], label_language(labels[i]), built[i], *x) for x in segs]
            if out:
                cols = list(zip(*out))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "named", "built", "seg_start", "language", "confidence", "sentences", "ambiguous"])

    found = rows.select("id", "language", F.coalesce(F.unix_micros("built_at"), F.lit(0)).alias("built"), "text").mapInArrow(go, "id string, named string, built bigint, seg_start int, language string, confidence double, sentences int, ambiguous boolean")
    segs = found.groupBy("id", "built", "named").agg(F.array_sort(F.collect_set(F.struct("seg_start", "language", "confidence", "sentences", "ambiguous"))).alias("segs"))
    return latest(segs, ["id"], "built").select("id", "named", F.col("segs"))


def mislabelled(found: DataFrame) -> DataFrame:
    """id, seg_start, language, confidence of the rows whose label is missing or not right."""
    langs = F.array_distinct(F.transform("segs", lambda s: s["language"]))
    right = F.when(F.size(langs) > 1, F.lit("mixed")).otherwise(langs.getItem(0))
    wrong = found.where((F.size(langs) > 1) | F.col("named").isNull() | (F.col("named") != right))
    return wrong.select("id", F.explode("segs").alias("s")).select("id", "s.seg_start", "s.language", "s.confidence")
