"""Language of each text, and of the spans of mixed texts.

Method: words are runs of letters (Unicode category L); a word's script (fixed code point ranges) narrows the candidates to the languages that training
texts write in it; each candidate gets a score from hashed character n-grams and the whole word; a Viterbi pass over a text's
words, with a penalty for each change of language, labels spans. The text's language is that of most words.

A text needs no full pass when, against its best single language, no other language gains more than half a penalty over any run of
words: k other spans then gain at most k / 2 penalties and cost at least k - 1, and one alone can't beat the best total. That test is a running
minimum over sums; the other texts of a batch take the Viterbi steps together.

Model: counts from about ``sample_docs`` labelled rows a language, chosen by a hash of doc_id; 2**16 buckets a language at most
come to the driver. Defined results: null text, or text without a letter, is ``und`` with score 0; without training rows all is
``und``; words in a script that no language has leave all candidates equal; a tie goes to the first language by code point;
repeated rows are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import HashRows, mix, piece_hashes
from .quality import held_out

#: Unicode block ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
BUCKETS = 1 << 16


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter (Unicode category L), and a random odd number."""
    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
    return letter, mix(np.arange(0x110000, dtype=np.uint64)) | np.uint64(1)


def find_words(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, starts, ends, words before each text and in all): the runs of letters of the lower-cased texts."""
    low = [t.lower() if t else "" for t in texts]
    joined = "\n".join([*low, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = np.concatenate([[False], _letters()[0][code], [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edge[0::2], edge[1::2]
    return joined, start, end, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in low)]))


def _words(text: str | None) -> list[str]:
    joined, start, end, _ = find_words([text])
    return [joined[a:z] for a, z in zip(start.tolist(), end.tolist())]


def runs(texts: list[str | None], characters: int = 1 << 18) -> Iterator[list[str | None]]:
    """The texts in runs of about so many characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def script(word: str) -> str:
    c = ord(word[0])
    return next((name for name, ranges in SCRIPTS.items() for a, z in ranges if a <= c <= z), "other")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' 2- and 3-grams with their edges and of the whole words, and the index of each one's word."""
    text = "".join(f"^{w}$" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = (np.arange(len(c)) - start[owner]).astype(np.uint64)
    power = place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93)
    whole = np.add.reduceat((c + np.uint64(1)) * (power | np.uint64(1)), start)
    two = c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[1:] * np.uint64(0x165667B19E3779F9) + np.uint64(2)
    three = two[:-1] + c[2:] * np.uint64(0x27D4EB2F165667C5) + np.uint64(3)
    keep2, keep3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    h = np.concatenate([two[keep2], three[keep3], whole])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64), np.concatenate([owner[:-1][keep2], owner[:-2][keep3], np.arange(len(words))])


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # [BUCKETS, languages] log probabilities, centred over languages
    scripts: dict[str, np.ndarray]  # languages that have it
    #: words whose scores a worker keeps; then it begins anew
    most: int = 1_000_000

    def __post_init__(self):
        self._begin()

    def _begin(self) -> None:
        self.index, self.table = HashRows(), np.zeros((1 << 15, len(self.languages)), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._begin()

    def rows(self, joined: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scores of the words joined[start[i]:end[i]]."""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        h = piece_hashes(_letters()[1][code], start, end)
        found = self.index.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            unknown, first = np.unique(h[new], return_index=True)
            if self.index.n and self.index.n + len(unknown) > self.most:
                self._begin()
                return self.rows(joined, start, end)
            first = new[first]
            words = [joined[a:z] for a, z in zip(start[first].tolist(), end[first].tolist())]
            while self.index.n + len(words) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                self.table[self.index.n + i : self.index.n + i + len(part)] = self.word_scores(part)
            self.index.add(unknown)
            found[new] = self.index.find(h[new])
        return self.table[found]

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, owner = grams(words)
        order = np.argsort(owner, kind="stable")
        got = self.scores[bucket[order]]
        edges = np.searchsorted(owner[order], np.arange(len(words)))
        s = np.clip(np.add.reduceat(got, edges, axis=0) / 2.5, -8, 8)
        far = [i for i, w in enumerate(words) if not w.isascii()]
        for i in far:
            has = self.scripts.get(script(words[i]))
            s[i] = 0 if has is None else np.where(has, s[i], -12)
        if len(far) < len(words):
            ascii_has = self.scripts.get("latin")
            near = np.ones(len(words), bool)
            near[far] = False
            s[near] = 0 if ascii_has is None else np.where(ascii_has, s[near], -12)
        return s.astype(np.float32)


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of words with scores s [words, languages]."""
    n, k = s.shape
    back = np.empty((n, k), np.int16)
    own = np.arange(k)
    best = s[0].astype(np.float64)
    back[0] = own
    for t in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - penalty
        back[t] = np.where(stay, own, top)
        best = np.where(stay, best, best[top] - penalty) + s[t]
    path = np.empty(n, np.int64)
    path[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def viterbi_many(texts: list[np.ndarray], penalty: float, cells: int = 1 << 18) -> list[np.ndarray]:
    """As viterbi() of each; texts of like lengths take their steps together."""
    out: list[np.ndarray | None] = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    while order:
        longest, k = texts[order[0]].shape
        group, order = order[: max(1, cells // (longest * k))], order[max(1, cells // (longest * k)) :]
        lengths = np.array([len(texts[i]) for i in group])
        s = np.zeros((longest, len(group), k))
        for j, i in enumerate(group):
            s[: lengths[j], j] = texts[i]
        back = np.empty((longest, len(group), k), np.int16)
        best, own = s[0].copy(), np.arange(k)
        alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with more words than t, which come first
        for t in range(1, longest):
            m = alive[t]
            b = best[:m]
            top = b.argmax(axis=1)[:, None]
            change = np.take_along_axis(b, top, 1) - penalty
            stay = b >= change
            back[t, :m] = np.where(stay, own, top)
            best[:m] = np.where(stay, b, change) + s[t, :m]
        path = np.empty((longest, len(group)), np.int64)
        now = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            m = alive[t]
            path[t, :m] = now[:m]
            if t:
                now[:m] = back[t, np.arange(m), now[:m]]
        for j, i in enumerate(group):
            out[i] = path[: lengths[j], j]
    return out


def single(s: np.ndarray, penalty: float) -> int | None:
    """The language of all words where sums alone show that no change pays."""
    totals = s.sum(axis=0, dtype=np.float64)
    best = int(totals.argmax())
    gain = np.zeros((len(s) + 1, s.shape[1]))
    np.cumsum(s - s[:, best : best + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return best
    return None


def labels(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best labels of each text's words."""
    told = [single(s, penalty) for s in texts]
    rest = [i for i, x in enumerate(told) if x is None]
    out = [None if x is None else np.full(len(s), x, np.int64) for s, x in zip(texts, told)]
    for i, path in zip(rest, viterbi_many([texts[i] for i in rest], penalty)):
        out[i] = path
    return out


def label(s: np.ndarray, penalty: float) -> np.ndarray:
    return labels([s], penalty)[0]


def train(docs: DataFrame, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From rows with a language that aren't held out; about sample_docs of each language."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & ~held_out())
    counts = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    part = 1 << 30
    share = F.create_map(*(F.lit(x) for lang, n in counts for x in (lang, min(part, part * sample_docs // n + 1)))) if counts else None
    if share is None:
        return Model([], np.zeros((BUCKETS, 0), np.float32), {})
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(part)) < share[F.col("lang")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        kinds: set[tuple[str, str]] = set()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = _words(text)
                if words:
                    bucket, _ = grams(words)
                    own.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    own[lang] += np.bincount(bucket, minlength=BUCKETS)
                    kinds.update((lang, "latin" if w.isascii() else script(w)) for w in set(words))
        rows = [(lang, int(k), int(c[k]), None) for lang, c in own.items() for k in np.flatnonzero(c)] + [(lang, -1, 1, s) for lang, s in kinds]
        if rows:
            types = [pa.string(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lang", "bucket", "n", "script"])

    found = sample.select("text", "lang").mapInArrow(work, "lang string, bucket int, n long, script string").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toArrow()
    languages = [lang for lang, _ in counts]
    of = {lang: i for i, lang in enumerate(languages)}
    table, scripts = np.zeros((BUCKETS, len(languages))), {}
    at = np.array([of[x] for x in found["lang"].to_pylist()], np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    np.add.at(table, (bucket[bucket >= 0], at[bucket >= 0]), n[bucket >= 0])
    for k, name in zip(at, found["script"].to_pylist()):
        if name is not None:
            scripts.setdefault(name, np.zeros(len(languages), bool))[k] = True
    log = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS))
    return Model(languages, (log - log.mean(axis=1, keepdims=True)).astype(np.float32), scripts)


def predict_texts(model: Model, texts: list[str | None], penalty: float) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; a span is (first word, end word, language)."""
    if not model.languages:
        yield from (("und", 0.0, []) for _ in texts)
        return
    joined, start, end, upto = find_words(texts)
    scores = model.rows(joined, start, end)
    own = [scores[a:z] for a, z in zip(upto.tolist(), upto[1:].tolist())]
    paths = iter(labels([s for s in own if len(s)], penalty))
    for s in own:
        if not len(s):
            yield "und", 0.0, []
            continue
        path = next(paths)
        share = np.bincount(path, minlength=len(model.languages)) / len(s)
        best = int(share.argmax())
        totals = s.sum(axis=0, dtype=np.float64)
        rival = np.delete(totals, best).max() if len(totals) > 1 else totals[best] - 50
        sure = 1 / (1 + np.exp(-np.clip(totals[best] - rival, -50, 50)))
        cut = np.flatnonzero(path[1:] != path[:-1]) + 1
        spans = [(a, z, model.languages[path[a]]) for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(path)])]
        yield model.languages[best], float(share[best] * sure), spans


def predict(docs: DataFrame, model: Model, penalty: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, spans (first-end:language by word, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in runs(b.column(2).to_pylist()):
                part = b.slice(at, len(texts))
                at += len(texts)
                lang, score, spans = zip(*predict_texts(shared.value, texts, penalty))
                text = [",".join(f"{a}-{z}:{x}" for a, z, x in s) for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(text, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, spans string")
