"""Language ID by Bayesian evidence fusion.

The posterior of a text's language multiplies four pieces of evidence: the likelihood of its byte trigrams, the
declared language, the address suffix, and a prior from its host. Host priors are smoothed hierarchically: a host's
soft counts are drawn towards its domain's, those towards its suffix's, those towards the whole collection's. How far a
declaration or a suffix is to be trusted is itself counted: both are grouped sums of the text-only posteriors. A
row's own vote is taken out of every count before the count speaks about the row.

A last class, written ``und``, has uniform trigrams; a text for which it wins is in none of the known languages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import fits_broadcast, settle
from .common import FOLDED, bounded_batches, flat, frugal, slices

#: Rows of every label that the fit reads.
SAMPLE = 4000
#: Columns of the likelihood table that are looked up at once, so that memory does not grow with the languages.
COLUMNS = 8
BINS = 1 << 16
#: Share of a trigram's probability that is uniform, so that no rare trigram decides alone.
FLOOR = 0.01
#: Three trigrams share each byte, so each counts a third.
TEMPER = 1 / 3
STRENGTH = 10.0
UNKNOWN_PRIOR = 0.01
UNKNOWN = "und"
#: Text that is looked up at once; it takes some 120 times its bytes of memory on the way.
SLICE_BYTES = 1 << 17

#: Bytes that carry language: letters and all of UTF-8 beyond ASCII; the rest counts as a space.
_LETTER = FOLDED.copy()
_LETTER[:0x80][~np.isin(np.arange(0x80), [*range(0x41, 0x5B), *range(0x61, 0x7B)])] = 0x20


def trigrams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the trigram at every byte (``BINS`` where there is none) and where texts begin."""
    data, begins = flat(texts)
    data = _LETTER[data].astype(np.uint32)
    bins = np.full(len(data), BINS, np.int64)
    if len(data) > 2:
        joined = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        bins[:-2] = np.where(joined == 0x202020, BINS, (joined * np.uint32(2654435761)) >> np.uint32(16))
    for back in (1, 2):  # the last two bytes of a text begin no trigram
        bins[np.maximum(begins[1:] - back, begins[:-1])] = BINS
    return bins, begins


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch.column("text")), SLICE_BYTES):
            bins, begins = trigrams(part.column("text"))
            for lang, a, b in zip(part.column("lang").to_pylist(), begins[:-1].tolist(), begins[1:].tolist()):
                counts[lang] = counts.get(lang, 0) + np.bincount(bins[a:b], minlength=BINS + 1)
                docs[lang] = docs.get(lang, 0) + 1
    yield pa.RecordBatch.from_arrays([
        pa.array(list(counts), pa.string()), pa.array([docs[k] for k in counts], pa.int64()),
        pa.array([counts[k].astype("<i8").tobytes() for k in counts], pa.binary()),
    ], ["lang", "docs", "counts"])


def _sample(rows: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of the ``sample`` smallest marks of every label; equal rows are one mark.

    Marks are spread evenly, so a bound on them leaves some multiple of the sample whatever the size of the label. It is
    widened for the labels that repeated rows leave short.
    """
    spark = rows.sparkSession
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    last, share, bounds = (1 << 63) - 1, dict.fromkeys(count, 4), {}
    while share:
        upto = {k: min(last, (sample * times << 64) // count[k] - (1 << 63)) for k, times in share.items()}
        table = F.broadcast(spark.createDataFrame(list(upto.items()), "lang string, upto long"))
        marks = rows.join(table, "lang").filter("mark <= upto").select("lang", "mark").distinct()
        ranked = marks.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).filter(F.col("at") <= sample)
        found = {r["lang"]: r for r in ranked.groupBy("lang").agg(F.max("mark").alias("bound"), F.count(F.lit(1)).alias("n")).collect()}
        for k in list(share):
            if upto[k] == last or k in found and found[k]["n"] == sample:
                bounds[k] = found[k]["bound"]
                del share[k]
            else:
                share[k] *= 16
    if not bounds:
        return rows.select("lang", "text").limit(0)
    table = F.broadcast(spark.createDataFrame(list(bounds.items()), "lang string, bound long"))
    return rows.join(table, "lang").filter("mark <= bound").groupBy("lang", "mark").agg(F.min("text").alias("text")).select("lang", "text")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, languages: int | None = None) -> dict[str, np.ndarray]:
    """Log likelihoods of trigrams by language, from the ``sample`` rows of smallest hash of every label.

    Every label is a class, however few rows it has, unless ``languages`` asks for the most frequent ones alone. The
    sample bounds the rows of a label; the driver holds 512 kB a label.
    """
    rows = labelled.filter((F.trim(F.col(lang)) != "") & (F.trim(F.col(text)) != "")).select(
        F.lower(F.trim(F.col(lang))).alias("lang"), F.xxhash64(F.col(id_col), F.col(lang), F.col(text)).alias("mark"), F.col(text).alias("text"))
    if languages is not None:
        most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
        rows = rows.join(F.broadcast(most), "lang", "left_semi")
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for row in _sample(rows, sample).repartition(4).mapInArrow(frugal(_count), "lang string, docs long, counts binary").toLocalIterator():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["counts"], "<i8")[:BINS]
        docs[row["lang"]] = docs.get(row["lang"], 0) + row["docs"]
    model = {}
    for name in sorted(docs, key=lambda k: (-docs[k], k)):
        p = (total[name] + 0.05) / (total[name].sum() + 0.05 * BINS)
        model[name] = np.log((1 - FLOOR) * p + FLOOR / BINS)
    return model


def _score(model: dict[str, np.ndarray], text: str, declared: str | None, markup: bool):
    names = list(model)
    table = np.zeros((BINS + 1, len(names) + 2), np.float32)
    for k, name in enumerate(names):
        table[:BINS, k] = TEMPER * model[name]
    table[:BINS, -2] = TEMPER * np.log(1 / BINS)
    table[:BINS, -1] = 1
    blocks = [np.ascontiguousarray(table[:, k: k + COLUMNS]) for k in range(0, table.shape[1], COLUMNS)]
    tags = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.I | re.S)
    said = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            for part in slices(batch, pc.binary_length(rows.field(text)), SLICE_BYTES):
                row = part.column("row")
                texts, says = row.field(text), pa.array([None] * len(row), pa.string())
                if markup:
                    pages = pc.fill_null(texts, "").to_pylist()
                    texts = pa.array([html.unescape(tags.sub(" ", p)) for p in pages], pa.string())
                    says = pa.array([m[1].lower() if (m := said.search(p)) else None for p in pages], pa.string())
                elif declared:
                    says = pc.utf8_lower(row.field(declared).cast(pa.string()))
                bins, begins = trigrams(texts)
                sums = np.hstack([np.add.reduceat(t[bins], begins[:-1], axis=0, dtype=np.float64) for t in blocks]) if len(bins) else np.zeros((0, table.shape[1]))
                grams = sums[:, -1].astype(np.int64)
                votes = _softmax(sums[:, :-1] + np.log(_flat_prior(len(names)))) * (grams > 0)[:, None]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("code"), part.column("host"), says, pa.array(grams), _lists(sums[:, :-1]),
                    *[pa.array(votes[:, k]) for k in range(len(names) + 1)],
                ], ["id", "code", "host", "declared", "grams", "ll", *[f"r{k}" for k in range(len(names) + 1)]])

    return run


def _flat_prior(languages: int) -> np.ndarray:
    return np.array([(1 - UNKNOWN_PRIOR) / languages] * languages + [UNKNOWN_PRIOR])


def _softmax(logs: np.ndarray) -> np.ndarray:
    exps = np.exp(logs - logs.max(axis=1, keepdims=True))
    return exps / exps.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _fuse(names: list[str], whole: np.ndarray, strength: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = len(names)
        for batch in batches:
            own, logs, *counts = (
                pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False).reshape(-1, wide) for c in ("votes", "ll", "suffix", "domain", "host", "declared_votes"))
            said = batch.column("declared").is_valid().to_numpy(zero_copy_only=False)
            # a row's own vote is taken out of every count before the count speaks about the row
            suffix, domain, host, declared = (np.maximum(c - own, 0.0) for c in counts)
            prior = (whole + strength * _flat_prior(wide - 1)) / (whole.sum() + strength)
            for level in (suffix, domain, host):
                prior = (level + strength * prior) / (level.sum(axis=1, keepdims=True) + strength)
            # P(declared | language): the share of the language's votes that came with this declaration
            trust = np.where(said[:, None], np.log((declared + 1.0) / (whole + strength)), 0.0)
            chance = _softmax(logs + np.log(prior) + trust)
            best = chance.argmax(axis=1)
            rejected = (best == wide - 1) | (batch.column("grams").to_numpy() == 0)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("code"), pa.array([names[k] for k in best], pa.string()), pa.array(chance[np.arange(len(best)), best]),
                batch.column("declared"), batch.column("grams"), pa.array(rejected),
            ], ["id", "code", "lang", "probability", "declared", "grams", "rejected"])

    return run


def _with(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(F.broadcast(table) if fits_broadcast(table) else table, key, "left")


def language_id(rows: DataFrame, model: dict[str, np.ndarray], text: str = "text", id_col: str = "doc_id", host: Column | None = None,
                declared: str | None = None, markup: bool = False, strength: float = STRENGTH) -> DataFrame:
    """(id, code, lang, probability, declared, grams, rejected), one row per row of ``rows``.

    ``text`` is read whole; with ``markup`` it is HTML, of which the visible text counts and whose html element may
    declare a language, else ``declared`` names a column that does. ``host`` gives a host name: its last label is the
    suffix, its last two the domain. ``code`` is the hash of id and text. A row is rejected when its text has no
    trigram of letters or when ``und`` is the most probable class.

    Defined results: very long texts are read whole;
    null and empty texts have no trigrams and are rejected; a missing declaration, host or suffix is
    no evidence; ties go to the language named first by the model; repeated rows are voters of their own; an empty
    table gives an empty table; with an empty model lang is null and nothing is rejected; other columns are not read.
    """
    bounded_batches(rows.sparkSession)
    names = [*model, UNKNOWN]
    place = F.lower(host.cast("string")) if host is not None else F.lit(None).cast("string")
    needed = list(dict.fromkeys([id_col, text, *([declared] if declared and not markup else [])]))
    given = rows.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text)).alias("code"), place.alias("host"),
        F.struct(*[F.col(c) for c in needed]).alias("row"))
    id_type = given.schema["id"].dataType.simpleString()
    if not model:
        return given.select("id", "code", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                            F.lit(None).cast("string").alias("declared"), F.lit(0).cast("long").alias("grams"), F.lit(False).alias("rejected"))
    many = range(len(names))
    kind = f"id {id_type}, code long, host string, declared string, grams long, ll array<double>, " + ", ".join(f"r{k} double" for k in many)
    scored = settle(given.mapInArrow(frugal(_score(model, text, declared, markup)), kind).withColumns({
        "domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract("host", r"\.([^.]+)$", 1)}))
    sums = [F.sum(f"r{k}") for k in many]
    whole = np.array([x or 0.0 for x in scored.agg(*sums).first()])
    out = scored.withColumn("votes", F.array(*[F.col(f"r{k}") for k in many])).drop(*[f"r{k}" for k in many])
    none = F.array(*[F.lit(0.0) for _ in many])
    for key in ("host", "domain", "suffix", "declared"):
        counted = settle(scored.filter(F.col(key) != "").groupBy(key).agg(F.array(*sums).alias(f"of_{key}")))
        out = _with(out, counted, key).withColumn(f"of_{key}", F.coalesce(f"of_{key}", none))
    out = out.select("id", "code", "declared", "grams", "ll", "votes", F.col("of_suffix").alias("suffix"), F.col("of_domain").alias("domain"),
                     F.col("of_host").alias("host"), F.col("of_declared").alias("declared_votes"))
    return out.mapInArrow(_fuse(names, whole, strength), f"id {id_type}, code long, lang string, probability double, declared string, grams long, rejected boolean")
