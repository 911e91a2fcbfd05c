"""Language identification as mixture inference: op3.

Each learned language is a distribution over hashed letter trigrams (counted over all training texts, whole). A text's
trigrams are taken as drawn from a mixture of these; expectation-maximisation estimates the proportions. The set of
languages is chosen by penalised likelihood: languages enter in the order of their first estimated proportions, as long
as the gain in log-likelihood exceeds `penalty` * log(number of trigrams). The prediction is the language of the
largest proportion, the score that proportion.

Defined results: null texts and texts without a letter are `und` with score 0 and are not learned from, nor are rows
with null lang or null id; texts with letters but no trigram fall back to the prior; equal proportions go to the
language first in the alphabet; with nothing to learn from all are `und`; repeated rows yield a row each; an empty
table yields no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc
from panelloom.runtime import ship_package

BUCKETS = 1 << 15
#: Letters: a-z and all bytes of non-ASCII characters; anything else is one separator.
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_IS_LETTER = _LETTER > 0


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each letter with its neighbours, lower-cased; rows lie back to back."""
    text = _LETTER[tc.LOWER[raw[off[0] : off[-1]]]].astype(np.uint32)
    bounds = off - off[0]
    left, right = np.zeros_like(text), np.zeros_like(text)
    left[1:], right[:-1] = text[:-1], text[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(text))]
    left[inner] = 0
    right[inner - 1] = 0
    at = np.flatnonzero(text)
    code = (left[at] << np.uint32(16)) | (text[at] << np.uint32(8)) | right[at]
    row = np.searchsorted(bounds, at, side="right") - 1
    return row, ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def held_out(id_col: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text is 2 modulo 4 (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their trigram counts (languages x BUCKETS), over all rows that may be learned from."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(1).dictionary_encode()
            names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            raw, off = tc.string_buffers(batch.column(0))
            for lo, hi in tc.row_slices(off):
                row, bucket = trigrams(raw, off[lo : hi + 1])
                counts = np.bincount(code[lo + row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, own in zip(names, counts, strict=True):
                    total[name] = total[name] + own if name in total else own
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at].astype(np.int64))], names=["lang", "bucket", "n"])

    known = frame.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = tc.mapped(known.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")), scan, "lang string, bucket int, n long")
    # at most languages x BUCKETS rows, whatever the input
    summed = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(summed["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    if names:
        counts[np.searchsorted(names, summed["lang"]), summed["bucket"]] = summed["n"]
    return names, counts


def mixtures(row: np.ndarray, bucket: np.ndarray, rows: int, model: np.ndarray, prior: np.ndarray, penalty: float, rounds: int = 12) -> np.ndarray:
    """Proportions of the languages (rows x languages); model: probabilities (BUCKETS x languages)."""
    key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    first = np.searchsorted(row, np.arange(rows + 1))
    total = np.bincount(row, weights=count, minlength=rows)
    weight = count.astype(np.float32)
    langs = model.shape[1]
    out = np.tile(prior, (rows, 1)).astype(np.float32)
    some = np.flatnonzero(total > 0)
    if not len(some):
        return out

    def estimate(which: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihoods of some rows, with the languages allowed to each."""
        length = first[which + 1] - first[which]
        at = np.repeat(first[which] - np.cumsum(length) + length, length) + np.arange(length.sum())
        own = np.repeat(np.arange(len(which)), length)
        theta, w = model[bucket[at]], weight[at]
        start = np.cumsum(length) - length
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds if allowed.sum(axis=1).max() > 1 else 1):
            part = theta * share[own]
            mix = part.sum(axis=1)
            part *= (w / mix)[:, None]
            share = np.add.reduceat(part, start, axis=0)
            share /= share.sum(axis=1, keepdims=True)
        mix = (theta * share[own]).sum(axis=1)
        return share, np.add.reduceat(w * np.log(mix), start)

    begin, _ = estimate(some, np.ones((len(some), langs), np.float32))
    order = np.argsort(-begin, axis=1, kind="stable")
    left, best = some, np.full(rows, -np.inf)
    for k in range(1, langs + 1):
        allowed = np.zeros((len(left), langs), np.float32)
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        share, value = estimate(left, allowed)
        value = value - penalty * (k - 1) * np.log(total[left] + 1)
        better = value > best[left]
        out[left[better]] = share[better]
        best[left] = np.maximum(best[left], value)
        left, order = left[better], order[better]
        if not len(left):
            break
    return out


def predict(
    frame: DataFrame, names: list[str], counts: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = (), smoothing: float = 0.01, penalty: float = 6.0
) -> DataFrame:
    """The columns `keep`, lang_pred, score and proportions (language -> proportion above 0.001) of each row."""
    ship_package(frame.sparkSession)
    prior = counts.sum(axis=1) / max(counts.sum(), 1) if names else np.zeros(0)
    theta = ((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * BUCKETS)).T.astype(np.float32)
    model = frame.sparkSession.sparkContext.broadcast(np.ascontiguousarray(theta))  # BUCKETS x languages, a fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tc.string_buffers(batch.column(batch.num_columns - 1))
            pred, score, lists = [], [], []
            for lo, hi in tc.row_slices(off):
                row, bucket = trigrams(raw, off[lo : hi + 1])
                share = mixtures(row, bucket, hi - lo, model.value, prior, penalty) if names else None
                has = np.zeros(hi - lo, bool)
                has[row[raw[off[lo] : off[hi]][np.flatnonzero(_IS_LETTER[tc.LOWER[raw[off[lo] : off[hi]]]])] < 128]] = True
                for i in range(hi - lo):
                    letters = has[i] or any(c.isalpha() for c in raw[off[lo + i] : off[lo + i + 1]].tobytes().decode("utf-8", "replace"))
                    if not letters or not names:
                        pred.append("und")
                        score.append(0.0)
                        lists.append([])
                        continue
                    top = int(np.argmax(share[i]))
                    pred.append(names[top])
                    score.append(min(1.0, float(share[i][top])))
                    lists.append([(names[j], float(x)) for j, x in enumerate(share[i]) if x > 0.001])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names_out)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(lists, pa.map_(pa.string(), pa.float64()))],
                names=[*names_out, "lang_pred", "score", "proportions"],
            )

    # a text that is kept travels once: as the last of the kept columns
    names_out = [c for c in keep if c != text_col] + [text_col] * (text_col in keep)
    text = [] if text_col in keep else [F.col(text_col).cast("string").alias("__text")]
    chosen = frame.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in names_out], *text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(names_out)]), "lang_pred string", "score double", "proportions map<string,double>"])
    return tc.mapped(chosen, scan, schema)


def identify(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the rows that are not held out, predict all: (id, held_out, lang_pred, score, proportions)."""
    ship_package(frame.sparkSession)
    names, counts = learn(frame, id_col, text_col, lang_col)
    out = predict(frame, names, counts, text_col, keep=(id_col, *keep))
    return out.withColumn("held_out", held_out(F.col(id_col)))
