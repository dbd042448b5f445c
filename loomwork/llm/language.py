"""Languages of documents and of the passages inside them.

Method: Bayesian evidence fusion.  For a text with words w and declared label d,
written by host h and holding links of suffix s,

    log P(lang | all) = sum log P(w | lang) + log P(d | lang) + log P(s | lang) + log P(lang | h) + const.

* Text: word model over letters-only words with a letter n-gram model behind it for
  unseen words, fitted on a bounded sample of labelled rows (at most ``rows_per_language``
  rows a language in expectation) and refitted once on its own decisions, which
  removes wrong labels from the sample.
* Declared label: right with probability ``label_trust``, else any other language.
* Host (author) prior: label counts of the host by grouped aggregation, smoothed with
  the counts of all hosts (weight ``kappa``); the counts of all hosts are smoothed with
  a flat prior.
* Address suffix: label counts by last part of the link host, smoothed alike.

A text of ``other_words`` words or more of which less than ``other_share`` are words that speak for its
language (known words near its maximum) is in none of these languages: ``other``, with the
share of the remaining words as confidence.

Passages: a Viterbi path over the words, a change of language costing ``switch_cost``.
A language counts as a passage if its run has ``min_words`` words and evidence of at
least ``min_evidence`` against the rest of the text.
"""

from __future__ import annotations

import html
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.skew import lookup_join
from loomwork.session import shipped, written

LANGUAGES = ("en", "es", "fr", "de", "pt", "nl", "ja")
#: The language of texts that are in none of these.
OTHER = "other"
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown", "unk", "null", "none", "nan", "n/a", "na", "xx", "zxx", "mul", "mis", "other", "?", "-", "--")

_NOISE = re.compile(r"https?://\S+|www\.\S+|@\w+", re.I)
_TAIL = re.compile(r"\^\s?[A-Za-z]{1,3}\W*$")
_CJK = "぀-ヿ㐀-鿿ｦ-ﾟ"
_WORD = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+")


@dataclass
class Params:
    rows_per_language: int = 5000
    label_trust: float = 0.95
    kappa: float = 20.0
    switch_cost: float = 9.0
    min_words: int = 3
    min_evidence: float = 9.0
    clip: float = 4.0
    proper_weight: float = 0.25
    other_words: int = 6
    other_share: float = 0.3


def clean_text(text: str) -> str:
    """The running text: entities decoded, links, mentions and agent initials removed."""
    text = _NOISE.sub(" ", html.unescape(text) if "&" in text else text)
    return _TAIL.sub(" ", text) if "^" in text else text


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


@dataclass
class TextModel:
    """log P(word | language), centred to a maximum of 0 and clipped."""

    params: Params
    vocab: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, len(LANGUAGES)), dtype=np.float32))
    grams: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], params: Params) -> TextModel:
        k = len(LANGUAGES)
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        for text, lab in zip(texts, labels, strict=True):
            for w in words_of(clean_text(text)):
                counts[w.lower()][lab] += 1
        model = cls(params)
        if not counts:
            return model
        words = list(counts)
        c = np.array([counts[w] for w in words])
        total = c.sum(0) + 1
        rate = (c + 0.3 * c.sum(1, keepdims=True) * (total / total.sum()) * 0.02 + 1e-2) / total
        logp = np.log(rate)
        model.vocab = {w: i for i, w in enumerate(words)}
        model.table = model._centre(logp).astype(np.float32)
        g: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        for w, row in zip(words, c, strict=True):
            weight = np.minimum(row, 50)
            for gram in model._grams(w):
                g[gram] += weight
        gt = np.sum(list(g.values()), 0) + 1
        model.grams = {x: np.log((v + 0.5) / gt) for x, v in g.items() if v.sum() >= 3}
        return model

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"<{word}>"
        return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]

    def _centre(self, logp: np.ndarray) -> np.ndarray:
        return np.maximum(logp - logp.max(-1, keepdims=True), -self.params.clip)

    def unseen(self, word: str) -> np.ndarray:
        """Letter model: half the weight of a known word."""
        rows = [self.grams[x] for x in self._grams(word) if x in self.grams]
        if not rows:
            return np.zeros(len(LANGUAGES), dtype=np.float32)
        return (0.5 * self._centre(np.mean(rows, 0) * 3)).astype(np.float32)


class Scorer:
    """Scores batches of texts; keeps the vectors of words met before (bounded)."""

    MEMORY = 200_000

    def __init__(self, model: TextModel):
        self.model, self.params = model, model.params
        self.ids = dict(model.vocab)
        self.n = len(model.vocab)
        self.matrix = np.concatenate([model.table[: self.n], np.zeros((4096, len(LANGUAGES)), dtype=np.float32)])

    def _id(self, word: str) -> int:
        """Row of a word; a capital inside a text makes it a likely name, of less weight."""
        i = self.ids.get(word)
        if i is None:
            low = word.lower()
            at = self.model.vocab.get(low)
            row = self.model.unseen(low) if at is None else self.model.table[at]
            if word[0].isupper() and word[-1].islower():
                row = row * self.params.proper_weight
            i = self.ids[word] = self.n
            if i == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[i] = row
            self.n += 1
        return i

    def batch(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, the word scores of all, and the place where each text begins."""
        if self.n > len(self.model.vocab) + self.MEMORY:
            self.__init__(self.model)
        words = [words_of(clean_text(t)) for t in texts]
        get, ids = self.ids.get, []
        for ws in words:
            for at, w in enumerate(ws):
                w = w if at else w.lower()
                i = get(w)
                ids.append(self._id(w) if i is None else i)
        scores = self.matrix[ids] if ids else np.zeros((0, len(LANGUAGES)), dtype=np.float32)
        starts = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(int)
        return words, scores, starts

    def support(self, words: list[str], scores: np.ndarray, lang: int) -> float:
        """Share of the words (likely names left out) that are known and near their maximum in ``lang``."""
        known = self.model.vocab
        seen = [(w.lower() in known, s) for w, s in zip(words, scores[:, lang].tolist(), strict=True) if not (w[0].isupper() and w[-1].islower())]
        return sum(k and s > -1.5 for k, s in seen) / len(seen) if len(seen) >= self.params.other_words else 1.0

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, int]]:
        """``(from word, to word, language)`` runs of the best path."""
        n, cost = len(scores), self.params.switch_cost
        best = scores[0].copy()
        back = np.zeros((n, len(LANGUAGES)), dtype=np.int8)
        own = np.arange(len(LANGUAGES))
        for i in range(1, n):
            top = int(best.argmax())
            change = best[top] - cost
            stay = best >= change
            back[i] = np.where(stay, own, top)
            best = np.where(stay, best, change) + scores[i]
        lang = int(best.argmax())
        runs, end = [], n
        for i in range(n - 1, 0, -1):
            prev = int(back[i][lang])
            if prev != lang:
                runs.append((i, end, lang))
                end, lang = i, prev
        runs.append((0, end, lang))
        return runs[::-1]


def decide(
    scorer: Scorer, texts: list[str], prior: np.ndarray
) -> tuple[list[str | None], list[float], list[list[dict]]]:
    """For each text: main language, its probability and the passages.

    Texts without words have no language."""
    p = scorer.params
    words, scores, starts = scorer.batch(texts)
    cum = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(scores, 0, dtype=np.float64)])
    total = cum[starts[1:]] - cum[starts[:-1]]
    post = total + prior
    top = post.argmax(1)
    prob = 1 / np.exp(post - post.max(1, keepdims=True)).sum(1)
    gap = -total[np.arange(len(texts)), top]
    langs: list[str | None] = []
    confs: list[float] = []
    parts: list[list[dict]] = []
    for i, ws in enumerate(words):
        if not ws:
            langs.append(None), confs.append(0.0), parts.append([])
            continue
        runs = [(0, len(ws), int(top[i]))]
        if gap[i] > p.switch_cost:
            s = scores[starts[i] : starts[i + 1]]
            found = scorer.passages(s)
            strong = []
            for a, b, lang in found:
                seg = s[a:b].sum(0)
                against = max(float(seg[lang] - seg[o]) for _, _, o in found if o != lang) if len(found) > 1 else 99.0
                least = min((float(seg[lang] - seg[o]) for _, _, o in found if o != lang), default=99.0)
                if b - a >= p.min_words and least >= p.min_evidence and against > 0:
                    strong.append((a, b, lang))
            if len({x[2] for x in strong}) > 1:
                runs = strong
            elif strong:
                runs = [(0, len(ws), strong[0][2] if prob[i] < 0.5 else int(top[i]))]
        if len(runs) == 1 and len(ws) >= p.other_words:
            share = scorer.support(ws, scores[starts[i] : starts[i + 1]], int(top[i]))
            if share < p.other_share:
                langs.append(OTHER), confs.append(1 - share)
                parts.append([{"lang": OTHER, "confidence": 1 - share, "first_word": 0, "n_words": len(ws)}])
                continue
        langs.append(LANGUAGES[max(runs, key=lambda r: r[1] - r[0])[2]])
        confs.append(float(prob[i]))
        seen = []
        for a, b, lang in runs:
            s = scores[starts[i] + a : starts[i] + b].sum(0).astype(float)
            conf = float(prob[i]) if len(runs) == 1 else float(1 / np.exp(s - s[lang]).sum())
            seen.append({"lang": LANGUAGES[lang], "confidence": conf, "first_word": a, "n_words": b - a})
        parts.append(seen)
    return langs, confs, parts


def declared(label: Column) -> Column:
    """A label as a language code: blanks, case and region do not count; null if it names no language."""
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when((code != "") & ~code.isin(*NO_LANGUAGE), code)


def link_suffix(text: Column) -> Column:
    """Last part of the host name of the first link, lower case; null without link."""
    suffix = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)https?://[^\s/:?#]*?\.([a-z]{2,})(?=[/:?#\s]|$)", 1))
    return F.when(suffix != "", suffix)


def fit_text_model(rows: DataFrame, params: Params) -> TextModel:
    """The text model from a bounded sample of ``rows (key, text, declared)``.

    The sample is chosen by a hash of the key, so it is the same in every run."""
    known = rows.filter(F.col("declared").isin(*LANGUAGES) & F.col("text").isNotNull())
    sizes = {r["declared"]: r["n"] for r in known.groupBy("declared").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return TextModel(params)
    keep = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, params.rows_per_language / n)
        keep = keep | ((F.col("declared") == lang) & (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)))
    sample = known.filter(keep).select("text", "declared").limit(2 * params.rows_per_language * len(LANGUAGES)).toPandas()
    texts = sample["text"].tolist()
    labels = [LANGUAGES.index(x) for x in sample["declared"]]
    model = TextModel.fit(texts, labels, params)
    # one round on its own decisions: wrong labels of the sample drop out
    scorer, again = Scorer(model), []
    for a in range(0, len(texts), 5000):
        part = texts[a : a + 5000]
        _, scores, starts = scorer.batch(part)
        cum = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(scores, 0, dtype=np.float64)])
        again += (cum[starts[1:]] - cum[starts[:-1]]).argmax(1).tolist()
    kept = [(t, g) for t, g, lab in zip(texts, again, labels, strict=True) if g == lab]
    return TextModel.fit([t for t, _ in kept], [g for _, g in kept], params)


def smoothed_prior(rows: DataFrame, key: str, params: Params) -> tuple[DataFrame, list[float]]:
    """``key, n, prior`` (log probabilities in the order of LANGUAGES) from the declared
    labels of each key, smoothed with those of all keys; and the prior of all keys."""
    per = rows.groupBy(key).agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("declared") == x, 1)).alias("c_" + x) for x in LANGUAGES]
    )
    sums = per.agg(*[F.sum("c_" + x).alias(x) for x in LANGUAGES]).first()
    counts = [float(sums[x] or 0) + 1.0 for x in LANGUAGES]
    glob = [c / sum(counts) for c in counts]
    n_known = sum((F.col("c_" + x) for x in LANGUAGES), F.lit(0))
    prior = F.array(
        *[
            F.log((F.col("c_" + x) + params.kappa * g) / (n_known + params.kappa)).cast("float")
            for x, g in zip(LANGUAGES, glob, strict=True)
        ]
    )
    return per.filter(F.col(key).isNotNull()).select(key, "n", prior.alias("prior")), [math.log(g) for g in glob]


def identify(rows: DataFrame, params: Params | None = None) -> DataFrame:
    """Languages of ``rows (key, text, label, host)``: ``key, declared, lang, confidence,
    passages<lang, confidence, first_word, n_words>``, one row per input row.

    * Null and blank texts, and texts without words, have no language (null, confidence 0).
    * Null hosts get the prior of all hosts.  Repeated rows get equal results.
    * An empty table gives an empty result.
    """
    params = params or Params()
    base = rows.select("key", "text", declared(F.col("label")).alias("declared"), "host", link_suffix(F.col("text")).alias("suffix"))
    base = written(base, "lang-in")
    model = fit_text_model(base, params)
    hosts, overall = smoothed_prior(base, "host", params)
    suffixes, _ = smoothed_prior(base, "suffix", params)
    joined = lookup_join(base, written(hosts, "lang-hosts"), "host", "n", "left").drop("n")
    suffix_rows = written(suffixes.withColumnRenamed("prior", "suffix_prior"), "lang-suffixes")
    joined = lookup_join(joined, suffix_rows, "suffix", "n", "left").drop("n")
    sent = shipped(base.sparkSession, model)
    schema = (
        "key " + base.schema["key"].dataType.simpleString() + ", declared string, lang string, confidence double, "
        "passages array<struct<lang:string,confidence:double,first_word:int,n_words:int>>"
    )
    wrong = math.log((1 - params.label_trust) / len(LANGUAGES))
    right = math.log(params.label_trust)
    glob = np.array(overall)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(pickle.loads(sent.value))
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            prior = np.array([glob if p is None else p for p in pdf["prior"]], dtype=float).reshape(-1, len(LANGUAGES))
            prior += np.array([np.zeros(len(LANGUAGES)) if s is None else s - glob for s in pdf["suffix_prior"]]).reshape(-1, len(LANGUAGES))
            for i, d in enumerate(pdf["declared"]):
                if d in LANGUAGES:
                    prior[i] += wrong
                    prior[i, LANGUAGES.index(d)] += right - wrong
            langs, confs, parts = decide(scorer, texts, prior)
            yield pd.DataFrame({"key": pdf["key"], "declared": pdf["declared"], "lang": langs, "confidence": confs, "passages": parts})

    return joined.select("key", "text", "declared", "prior", "suffix_prior").mapInPandas(work, schema)


def doubtful_languages(result: DataFrame) -> DataFrame:
    """``key, lang`` for rows whose label is missing or wrong or whose text is mixed,
    one row per language."""
    langs = F.array_distinct(F.transform("passages", lambda x: x["lang"]))
    case = F.col("declared").isNull() | (F.col("declared") != F.col("lang")) | (F.size(langs) > 1)
    return result.filter(F.col("lang").isNotNull() & case).select("key", F.explode(langs).alias("lang")).distinct()
