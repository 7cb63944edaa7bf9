"""Language identification by multilingual mixture inference.

Each document's bytes are taken as a draw from a mixture of language models over hashed byte 3-grams.
Expectation-maximisation estimates the mixture's proportions; the set of languages is the one with the
best penalised likelihood: the logarithm of the likelihood less half the logarithm of the number of
n-grams, and the cost of naming a language, for each language after the first.

Edge cases: a null text, an empty one and one without any letter are "und" with score 0. Equally good
languages go to the alphabetically first. Without any labelled row everything is "und".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import arrow_schema, as_batch, keep_rows, map_text, text_slices

BUCKETS = 1 << 16
ORDER = 3
#: Labelled documents per language that the models are fitted on, in the mean; drawn by a hash of doc_id.
TRAINING_DOCUMENTS = 2000
ROUNDS = 12
UNDETERMINED = "und"

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed n-gram) of every n-gram, in order: lower case, letters only, words apart."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " if t else b"" for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    b = _KEEP[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw), dtype=np.uint32), lens)
    if not len(b):
        return doc, np.zeros(0, np.uint16)
    keep = np.ones(len(b), bool)
    # Double spaces collapse, but not the space that begins a text with the one that ends the text before.
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (doc[1:] != doc[:-1])
    b, doc = b[keep].astype(np.uint32), doc[keep]
    n = max(len(b) - ORDER + 1, 0)
    code = np.zeros(n, np.uint32)
    for j in range(ORDER):
        code = (code << np.uint32(8)) | b[j : n + j]
    code = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    inside = doc[:n] == doc[ORDER - 1 :]
    return doc[:n][inside], code[inside]


@dataclass(frozen=True)
class Model:
    """languages in order, and their n-gram probabilities as an array (BUCKETS, languages)."""

    languages: list[str]
    probability: np.ndarray


def train(labelled: DataFrame, per_language: int = TRAINING_DOCUMENTS) -> Model:
    """Fits a model to rows (doc_id, text, lang) with a non-null lang and text.

    The labelled rows are thinned to per_language documents of each language in the mean, by a hash, and
    counted where they lie; BUCKETS numbers per language reach the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < share * float(1 << 30)).select("text", "lang")
    schema = arrow_schema("lang string, code int, n long")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for s in text_slices(b):
                langs = np.array(s.column("lang").to_pylist(), object)
                doc, code = ngrams(s.column("text").to_pylist())
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + np.bincount(code[(langs == lang)[doc]], minlength=BUCKETS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield as_batch(schema, {"lang": [lang] * len(at), "code": at, "n": c[at]})

    table = drawn.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    for i, lang in enumerate(languages):
        part = table[table["lang"] == lang]
        counts[part["code"].to_numpy(), i] = part["n"].to_numpy()
    counts += 0.05
    return Model(languages, (counts / counts.sum(axis=0)).astype(np.float32))


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and the log-likelihood. A share of 0 stays 0."""
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        mixed = p * np.repeat(share, sizes, axis=0)
        mixed *= (n / mixed.sum(axis=1))[:, None]
        share = np.add.reduceat(mixed, starts, axis=0) / total
    like = np.einsum("ij,ij->i", p, np.repeat(share, sizes, axis=0))
    return share, np.add.reduceat(np.log(np.maximum(like, 1e-30)) * n, starts)


def infer(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by language, whether determined) for each text."""
    k = len(model.languages)
    shares, known = np.zeros((len(texts), k), np.float32), np.zeros(len(texts), bool)
    if not k:
        return shares, known
    doc, code = ngrams(texts)
    key = np.sort((doc.astype(np.uint64) << np.uint64(16)) | code)
    if not len(key):
        return shares, known
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first]
    doc, code = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64)
    # A slice of text may hold one very long document; its distinct n-grams are BUCKETS at most.
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ids, sizes = doc[starts], np.diff(np.append(starts, len(doc)))
    p = model.probability[code]
    total = np.add.reduceat(n, starts)
    single = np.add.reduceat(np.log(p) * n[:, None], starts, axis=0)
    best = single.argmax(axis=1)
    rows = np.arange(len(ids))
    chosen = np.zeros((len(ids), k), np.float32)
    chosen[rows, best] = 1
    score = single[rows, best].astype(np.float64)
    if k > 1:
        full, _ = _em(p, n, starts, sizes, np.full((len(ids), k), 1 / k, np.float32), ROUNDS)
        order = np.argsort(-full, axis=1, kind="stable")
        penalty = 0.5 * np.log(np.maximum(total, 2)) + np.log(k)
        for size in range(2, k + 1):
            try_ = np.flatnonzero(full[rows, order[:, size - 1]] > 0.02)
            if not len(try_):
                break
            mask = np.zeros((len(ids), k), np.float32)
            np.put_along_axis(mask, order[:, :size], 1, axis=1)
            take = np.isin(np.repeat(rows, sizes), try_)
            sub_sizes = sizes[try_]
            sub_starts = np.concatenate([[0], np.cumsum(sub_sizes)[:-1]])
            init = full[try_] * mask[try_]
            share, like = _em(p[take], n[take], sub_starts, sub_sizes, init / init.sum(axis=1, keepdims=True), ROUNDS)
            like = like - penalty[try_] * (size - 1)
            better = like > score[try_]
            score[try_[better]], chosen[try_[better]] = like[better], share[better]
    for i, d in enumerate(ids):
        if has_letter(texts[d]):
            shares[d], known[d] = chosen[i], True
    return shares, known


RESULT = "lang_pred string, score double, languages array<string>, shares array<double>"


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns of keep, lang_pred, score (the proportion of lang_pred), and the selected
    languages with their proportions, largest first."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * 4 bytes a language
    src = docs.select(*keep, "text")
    head = src.drop("text").schema
    names = np.array([*model.languages], object)

    def run(s: pa.RecordBatch) -> dict:
        share, known = infer(held.value, s.column("text").to_pylist())
        top = share.argmax(axis=1) if len(names) else np.zeros(len(share), int)
        out = {f.name: s.column(f.name) for f in head}
        out["lang_pred"] = [names[t] if ok else UNDETERMINED for t, ok in zip(top, known, strict=True)]
        out["score"] = [float(min(1.0, share[i, t])) if ok else 0.0 for i, (t, ok) in enumerate(zip(top, known, strict=True))]
        picked = [[j for j in np.argsort(-x, kind="stable") if x[j] > 0] if ok else [] for x, ok in zip(share, known, strict=True)]
        out["languages"] = [[names[j] for j in js] for js in picked]
        out["shares"] = [[float(share[i, j]) for j in js] for i, js in enumerate(picked)]
        return out

    return map_text(src, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in head), RESULT]), run)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_stage(docs: DataFrame) -> DataFrame:
    """Documents with a language; the undetermined go. All columns stay."""
    model = train(docs.where(~held_out()))
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: infer(held.value, texts)[1])
