"""Language of mixed texts: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Training counts hashed letter trigrams and scripts per language over all labelled training rows.  A word's score
for a language is the sum of its trigrams' log-probabilities; languages that hardly use the word's script are no
candidates for it.  Viterbi finds the labels of all words of a text at once, paying a penalty for each switch, so
one odd word does not start a span.  The model has at most ``MOST_LANGUAGES`` x 2**18 counts, whatever the corpus.
Prediction is a map over the rows: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.text import mix, portions

FEATURES = 1 << 18
MOST_LANGUAGES = 64
PORTION = 1 << 18  # bytes of text; a portion's arrays take some hundred times that
PREDICTED = "id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"

# First code points of Unicode ranges, and the script from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"),
    (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _script_of(code_points: np.ndarray) -> np.ndarray:
    names = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
    return names[np.searchsorted([start for start, _ in SCRIPTS], code_points, "right") - 1]


class Features:
    """Words (runs of letters) of many texts: trigram features per letter, script, and place in the text."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        # Lower-cased by code point, so that places stay those of the text.
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[points]
        lowered = np.where(letter, _lowered()[points], 0).astype(np.uint64)
        edges = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.at = np.searchsorted(self.starts, bounds)
        self.begins = bounds[:-1]
        inside = np.flatnonzero(letter)
        padded = np.concatenate((lowered, [np.uint64(0)]))  # its last entry also stands before the first
        code = (padded[inside - 1] << np.uint64(42)) ^ (padded[inside] << np.uint64(21)) ^ padded[inside + 1]
        self.trigrams = (mix(code) % np.uint64(FEATURES)).astype(np.int64)
        self.sizes = self.ends - self.starts
        self.first = np.cumsum(self.sizes) - self.sizes
        self.scripts = _script_of(points[self.starts])


@cache
def _lowered() -> np.ndarray:
    low = (chr(c).lower() for c in range(0x110000))
    return np.fromiter((ord(x) if len(x) == 1 else c for c, x in enumerate(low)), np.uint32, 0x110000)


def _strings(texts: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, texts in portions(batch, "text", PORTION):
            features = Features(_strings(texts))
            per_text = np.array(rows.column(0).to_pylist(), object)
            per_word = np.repeat(np.arange(len(texts)), np.diff(features.at))
            per_letter = np.repeat(per_word, features.sizes)
            for lang in set(per_text):
                mine = per_text == lang
                own = counts.setdefault(lang, np.zeros(FEATURES + len(SCRIPT_NAMES), np.int64))
                own[:FEATURES] += np.bincount(features.trigrams[mine[per_letter]], minlength=FEATURES)
                words = mine[per_word]
                own[FEATURES:] += np.bincount(features.scripts[words], features.sizes[words], len(SCRIPT_NAMES)).astype(np.int64)
    for lang, own in counts.items():
        used = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * len(used)), pa.array(used), pa.array(own[used])], names=["lang", "feature", "n"])


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict:
    """Log-probabilities of all languages that occur; rows without a language or text teach nothing."""
    rows = labelled.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    counted = rows.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_count, "lang string, feature long, n long")
    # One row per language and feature that occurs: bounded by the model's size, not by the corpus.
    table = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds {MOST_LANGUAGES}")
    counts = np.zeros((FEATURES + len(SCRIPT_NAMES), max(1, len(langs))))
    counts[table["feature"].to_numpy(np.int64), [langs.index(x) for x in table["lang"]]] = table["n"]
    grams, scripts = counts[:FEATURES], counts[FEATURES:]
    logs = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * FEATURES))
    share = scripts / np.maximum(scripts.sum(0), 1)
    candidate = share >= 0.01
    candidate[~candidate.any(1)] = True
    return {"langs": langs, "logs": logs.astype(np.float32), "barred": np.where(candidate, 0, -1e4).astype(np.float32)}


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts are rows ``at[i]:at[i + 1]`` and advance together, longest first."""
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = at[:-1][order], sizes[order]
    back = np.zeros(scores.shape, np.int8)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # texts with more than t words
    labels = np.zeros(len(scores), np.int64)
    if not longest:
        return labels
    now = np.zeros(active[0], np.int64)  # label of each text's last word, later of the word at t
    value = scores[first[: active[0]]]
    own = np.arange(scores.shape[1], dtype=np.int8)
    for t in range(1, longest):
        k = active[t]
        now[k : len(value)] = value[k:].argmax(1)
        value, rows = value[:k], first[:k] + t
        best = value.argmax(1)
        jump = value[np.arange(k), best][:, None] - penalty
        back[rows] = np.where(value >= jump, own, best[:, None].astype(np.int8))
        value = np.maximum(value, jump) + scores[rows]
    now[: len(value)] = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = first[:k] + t
        labels[rows] = now[:k]
        now[:k] = back[rows, now[:k]]
    return labels


class Words:
    """Words of many texts with their scores; only the letters of ``PORTION`` bytes of text are at hand at a time."""

    def __init__(self, texts: list[bytes], logs: np.ndarray, barred: np.ndarray):
        starts, ends, counts, scores, begins, before = [], [], [], [], [], 0
        cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // PORTION, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
            found = Features(strings := _strings(texts[a:b]))
            starts.append(found.starts + before)
            ends.append(found.ends + before)
            begins.append(found.begins + before)
            counts.append(np.diff(found.at))
            if len(found.starts):
                scores.append(np.add.reduceat(logs[found.trigrams], found.first, axis=0) + barred[found.scripts])
            before += sum(map(len, strings)) + len(strings)
        self.starts, self.ends, self.begins = np.concatenate(starts), np.concatenate(ends), np.concatenate(begins)
        self.at = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        self.sizes = self.ends - self.starts
        self.scores = np.concatenate(scores) if scores else np.zeros((0, logs.shape[1]), np.float32)


def _predict(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, barred = (model.value[k] for k in ("langs", "logs", "barred"))
        for batch in batches:
            for rows, texts in portions(batch, "text", 1 << 20):
                found = Words(texts, logs, barred)
                n_words = np.diff(found.at)
                if langs and len(found.starts):
                    labels = viterbi(found.scores, found.at, penalty)
                else:
                    labels = np.zeros(len(found.starts), np.int64)
                text_of = np.repeat(np.arange(len(texts)), n_words)
                width = max(1, len(langs))
                weight = np.bincount(text_of * width + labels, found.sizes, len(texts) * width).reshape(-1, width)
                best, total = weight.argmax(1), weight.sum(1)
                known = (total > 0) & bool(langs)
                score = np.where(known, weight.max(1) / np.maximum(total, 1), 0.0)
                new = np.ones(len(labels), bool)
                new[1:] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
                lead = np.flatnonzero(new) if langs else np.zeros(0, np.int64)
                last = np.append(lead[1:], len(labels))[: len(lead)] - 1
                base = found.begins[text_of[lead]]
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(found.starts[lead] - base, pa.int64()),
                        pa.array(found.ends[last] - base, pa.int64()),
                        pa.array([langs[x] for x in labels[lead]], pa.string()),
                    ],
                    names=["start", "end", "lang"],
                )
                cuts = np.searchsorted(text_of[lead], np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.record_batch(
                    [
                        rows.column(0),
                        pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                        pa.array(score, pa.float64()),
                        pa.ListArray.from_arrays(cuts, spans),
                    ],
                    names=["id", "lang_pred", "score", "spans"],
                )

    return run


def predict(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text", penalty: float = 12.0) -> DataFrame:
    """One row per input row: ``id, lang_pred, score, spans`` (code points and language of each labelled span).

    ``lang_pred`` covers most letters, ``score`` is its share of them; null, empty and letterless texts, and all
    texts when nothing was learned, are ``und`` with score 0 (ties: the language that sorts first).
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LANGUAGES x FEATURES
    return rows.mapInArrow(_predict(shared, penalty), PREDICTED)


def remainder(column: str, by: int):
    """crc32 of the id as text, divided; -1 for a null id, which is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by)), F.lit(-1))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Held-out evaluation: learn from rows whose id hashes outside the held-out third, predict every row."""
    held = remainder(id_column, 3) == 1
    model = train(docs.where(~held), text_column, lang_column)
    found = predict(docs, model, id_column, text_column)
    return found.select(
        F.col("id").alias("doc_id"), (remainder("id", 3) == 1).alias("held_out"), "lang_pred", "score", "spans"
    )


def keep_identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Rows whose text has a language: null texts and texts without a letter go."""
    held = remainder(id_column, 3) == 1
    model = train(docs.where(~held), text_column, lang_column)
    rejected = predict(docs, model, id_column, text_column).where("lang_pred = 'und'")
    gone = rejected.select(F.col("id").alias("gone")).distinct()
    unlettered = ~F.coalesce(docs[text_column].cast("string"), F.lit("")).rlike(r"\p{L}")
    kept = docs.join(gone, docs[id_column].cast("long").eqNullSafe(gone["gone"]) & unlettered, "left_anti")
    return kept
