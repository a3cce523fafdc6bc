"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Characters are folded to lower-case letters, anything else to a space; the n-grams
of one to three characters are hashed into ``FEATURES`` columns. A feature's value is
its count in the text times its inverse document frequency, over the sum of all the
text's values. Document frequencies cover every training document. The model is
trained by follow-the-regularised-leader (proximal, one learning rate per weight) with
elastic-net penalties, which keeps it sparse, on a bounded sample of training documents,
and a temperature fitted on a part of the sample kept aside calibrates its scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from threadloom.llm import textkernel
from threadloom.llm.tables import summed_table
from threadloom.llm.textkernel import LETTER

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents that the model is fitted on, over all languages (the bound of the sample).
SAMPLE = 4_000
SCALE = 50.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.01, 0.01, 3
UNKNOWN = "und"


def _features(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, row of each), and no n-gram crosses a text's end."""
    kind, _, _ = textkernel.unicode_tables()
    low = textkernel.lowered(cps)
    letter = (textkernel.look(kind, cps) == LETTER) | ((cps > 0xFFFF) if cps.dtype != np.uint8 else False)
    c = np.where(letter, low, 32).astype(np.uint32)
    keep = np.ones(len(c), bool)  # runs of anything else count as one space
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    total = np.concatenate([[0], np.cumsum(keep)])
    c, bounds = c[keep] * np.uint32(0x9E3779B1), total[bounds]
    out, rows = [], []
    roll = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        roll = roll[: len(c) - n + 1] * np.uint32(0x85EBCA6B) + c[n - 1 :] if len(c) >= n else roll[:0]
        if n in ORDERS:
            row, pos = textkernel.positions_in_rows(bounds, n)
            h = roll[pos] + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            out.append((h & np.uint32(FEATURES - 1)).astype(np.uint16 if FEATURES <= 1 << 16 else np.uint32))
            rows.append(row.astype(np.int32))
    return np.concatenate(out), np.concatenate(rows)


def _has_letter(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    letter = textkernel.look(textkernel.unicode_tables()[0], cps) == LETTER
    if cps.dtype != np.uint8:
        import unicodedata

        for i in np.flatnonzero(cps > 0xFFFF).tolist():
            letter[i] = unicodedata.category(chr(cps[i]))[0] == "L"
    total = np.concatenate([[0], np.cumsum(letter)])
    return total[bounds[1:]] > total[bounds[:-1]]


def _by_row(feature: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(row, kind="stable")
    cut = np.searchsorted(row[order], np.arange(n + 1))
    feature = feature[order]
    return [feature[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _frequencies(batches):
    """Document frequencies of a task's texts; the last column counts the documents."""
    df = np.zeros(FEATURES + 1, np.int64)
    seen = np.zeros(FEATURES, bool)
    for batch in batches:
        for a, b, cps, bounds in textkernel.chunks(batch.column("text")):
            feature, row = _features(cps, bounds)
            for own in _by_row(feature, row, b - a):
                seen[own] = True
                df[:-1] += seen
                seen[own] = False
            df[-1] += b - a
    return df


@textkernel.tidied
def _sampled(batches):
    """Counts of each sampled text's features."""
    for batch in batches:
        lang = batch.column("lang")
        for a, b, cps, bounds in textkernel.chunks(batch.column("text")):
            feature, row = _features(cps, bounds)
            got = [np.unique(own, return_counts=True) for own in _by_row(feature, row, b - a)]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": lang.slice(a, b - a), "rank": batch.column("rank").slice(a, b - a),
                    "features": pa.array([f.astype(np.int32).tobytes() for f, _ in got], pa.binary()),
                    "counts": pa.array([n.astype(np.int32).tobytes() for _, n in got], pa.binary()),
                }
            )


class LanguageModel:
    """Weights by feature and language, inverse document frequencies and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature


def _values(f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = n * idf[f]
    total = x.sum()
    return SCALE * x / total if total > 0 else x


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int, n_features: int) -> np.ndarray:
    """Weights after ``EPOCHS`` passes over (language, features, values), in the order given."""
    z, g2 = np.zeros((n_features, n_languages)), np.zeros((n_features, n_languages))

    def weights(f):
        zf, nf = z[f], g2[f]
        return np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, f, x in rows:
            w = weights(f)
            m = x @ w
            p = np.exp(m - m.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            old = g2[f]
            new = old + g * g
            z[f] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            g2[f] = new
    return weights(np.arange(n_features))


def fit_temperature(margins: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the smallest log loss, by golden section over its logarithm.

    Targets are smoothed by 1 / (n + 2), so that a model without an error on its n
    rows does not become certain of everything.
    """
    if not len(y):
        return 1.0
    smooth = 1 / (len(y) + 2)

    def loss(t):
        m = margins / np.exp(t)
        m = m - m.max(1, keepdims=True)
        total = np.log(np.exp(m).sum(1))
        return float(np.mean(total - (1 - smooth) * m[np.arange(len(y)), y] - smooth * m.mean(1)))

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Rows to fit on of each language: an even share, what small ones leave shared by the others, and one at least."""
    out, left = {}, sample
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, left // (len(counts) - i)))
        left -= min(left, out[lang])
    return out


def train(documents: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """A model from the rows of ``documents`` (columns text, lang, key) that have a language.

    At most ``sample`` rows are fitted on (or one a language, if there are more languages than that), the
    ``quotas`` of the languages, those that a hash of ``key`` puts first; the document frequencies come from
    all rows. None if no row has a language.
    """
    known = documents.filter("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    df = summed_table(known.select("text"), _frequencies, FEATURES + 1)
    share = quotas(counts, sample)
    # A few more than the quota are drawn before the rows are ranked, so that few are.
    drawn = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, (share[k] + 6 * share[k] ** 0.5 + 20) / n))])
    quota = F.create_map(*[F.lit(v) for k, n in share.items() for v in (k, n)])
    uniform = (F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    chosen = known.filter(uniform < F.try_element_at(drawn, F.col("lang"))).select("lang", "text", F.xxhash64("key", F.lit(7)).alias("rank"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))
    chosen = chosen.withColumn("place", place).filter(F.col("place") <= F.try_element_at(quota, F.col("lang"))).drop("place")
    rows = chosen.mapInArrow(_sampled, "lang string, rank long, features binary, counts binary").collect()
    rows.sort(key=lambda r: (r.rank, r.lang, bytes(r.features), bytes(r.counts)))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    data = []
    for r in rows:
        f, n = np.frombuffer(r.features, np.int32), np.frombuffer(r.counts, np.int32)
        data.append((languages.index(r.lang), f, _values(f, n, idf)))
    aside = data[::5] if len(data) >= 25 else []
    kept = [d for i, d in enumerate(data) if i % 5] if aside else data
    weights = fit_ftrl(kept, len(languages), FEATURES)
    margins = np.array([x @ weights[f] for _, f, x in aside]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, fit_temperature(margins, np.array([y for y, _, _ in aside], int)))


def scores(model: LanguageModel, table: np.ndarray, idf: np.ndarray, cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of each language (columns) for each text of a chunk."""
    feature, row = _features(cps, bounds)
    n = len(bounds) - 1
    margin = np.zeros((n, len(model.languages)))
    if len(row):
        margin = np.stack([np.bincount(row, weights=table[:, j].take(feature), minlength=n) for j in range(len(model.languages))], 1)
        margin /= np.maximum(np.bincount(row, weights=idf.take(feature), minlength=n), 1e-9)[:, None]
    margin -= margin.max(1, keepdims=True)
    p = np.exp(margin)
    return p / p.sum(1, keepdims=True)


def _predict(shared, keep: list[str]):
    @textkernel.tidied
    def run(batches):
        model = shared.value
        table = (model.weights * model.idf[:, None] * (SCALE / model.temperature)).astype(np.float32) if model else None
        idf = model.idf.astype(np.float32) if model else None
        names = np.array([*model.languages, UNKNOWN], object) if model else None
        for batch in batches:
            for a, b, cps, bounds in textkernel.chunks(textkernel.texts_of(batch)):
                n = b - a
                columns = {c: batch.column(c).slice(a, n) for c in keep}
                if model is None:
                    yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array([UNKNOWN] * n), "score": pa.array(np.zeros(n))})
                    continue
                p = scores(model, table, idf, cps, bounds)
                best = p.argmax(1)
                ok = _has_letter(cps, bounds)
                score = np.where(ok, p[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(names[np.where(ok, best, len(model.languages))], pa.string()), "score": pa.array(score)})

    return run


def predict(documents: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row with lang_pred and score, from its whole text alone.

    The text is the column ``text`` or else that field of a column ``row``. A null or
    empty text, or one without a letter, is ``und`` with score 0, and so is every text if
    nothing was learned. Repeated rows each keep a row; an empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    read = list(dict.fromkeys([*keep, *(["text"] if "text" in documents.columns else [])]))
    schema = StructType([*(documents.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return documents.select(*read).mapInArrow(_predict(shared, keep), schema)


def identify_languages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score per document row.

    Documents whose crc32 of doc_id (as text) leaves 2 when divided by 4 are held out:
    nothing is learned from them. A null doc_id is not held out. lang, source and
    doc_id are no inputs of a prediction. Repeated rows each keep a row; columns beyond
    doc_id, text and lang are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    training = documents.filter(~held).select("text", "lang", F.col("doc_id").cast("string").alias("key"))
    return predict(documents.select("doc_id", "text", held.alias("held_out")), train(training, sample), ["doc_id", "held_out"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify_languages`` of all of ``documents``; odd rows as stated there."""
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
