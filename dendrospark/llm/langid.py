"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, with word
borders) of a language by rank (Cavnar and Trenkle 1994).  A text's own ranking
is compared to each profile by the out-of-place distance: the sum of the
differences in rank, where an n-gram that the profile lacks counts as its whole
length.  The smallest distance names the language.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, fold, release_memory, table, whole_text

UNKNOWN = "und"
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """All n-grams of a text's words, packed 21 bits to a letter; a border is a
    space.  Other characters part words."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    c = np.concatenate(([SPACE], np.where(_letters()[c], c, SPACE), [SPACE]))
    c = c[np.concatenate(([True], (c[1:] != SPACE) | (c[:-1] != SPACE)))]
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != SPACE]
    return np.concatenate((c[c != SPACE], two if len(c) > 1 else two[:0], three))


def ranking(text: str, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first; ties by the
    packed n-gram."""
    g, n = np.unique(grams(text), return_counts=True)
    if len(g) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        g, n = g[n >= least], n[n >= least]
    return g[np.lexsort((g, -n))[:size]]


class Profiles(NamedTuple):
    """n-grams of all profiles, sorted, and their ranks by language; the last
    row is that of an n-gram of no profile."""
    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


def profiles_of(rows: list[tuple[str, int, int]], size: int) -> Profiles:
    """From ``(language, n-gram, rank)`` rows."""
    languages = sorted({r[0] for r in rows})
    known = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
    ranks = np.full((len(known) + 1, len(languages)), size, dtype=np.int64)
    at = {x: i for i, x in enumerate(languages)}
    for language, gram, rank in rows:
        ranks[np.searchsorted(known, gram), at[language]] = rank
    return Profiles(languages, known, ranks, size)


def classify(text: str, p: Profiles) -> tuple[str, float]:
    """Language and score: 1 less the out-of-place distance as a share of the
    largest that is possible.  No letter, or no profile: unknown, 0."""
    top = ranking(text, p.size)
    if not len(top) or not p.languages:
        return UNKNOWN, 0.0
    at = np.searchsorted(p.grams, top)
    at[(at == len(p.grams)) | (p.grams[np.minimum(at, len(p.grams) - 1)] != top)] = len(p.grams)
    r = p.ranks[at]
    own = np.arange(len(top))[:, None]
    away = np.where(r < p.size, np.abs(r - own), p.size).sum(axis=0)
    best = int(np.argmin(away))
    return p.languages[best], float(1 - away[best] / (p.size * len(top)))


def _marked(docs: DataFrame) -> DataFrame:
    """``lang, text`` of all documents that have both."""
    return docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")


def learn(docs: DataFrame, size: int = 300) -> Profiles:
    """Profiles of the languages in ``lang``, from the n-grams of all documents
    of each.  Only the profiles, ``size`` rows a language, reach the driver.
    Rows without a language or a text teach nothing."""

    def run(batches):
        found: dict[str, list] = {}

        def merged(language):
            g, n = (np.concatenate(x) for x in zip(*found[language]))
            u, at = np.unique(g, return_inverse=True)
            return u, np.bincount(at, weights=n).astype(np.int64)

        release_memory()
        for part in (x for b in batches for x in byte_slices(b, "text", 1 << 20)):
            for language, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                parts = found.setdefault(language, [])
                parts.append(np.unique(grams(text), return_counts=True))
                if len(parts) > 200:
                    found[language] = [merged(language)]
        for language in found:
            g, n = merged(language)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(g)), pa.array(g), pa.array(n)],
                                             ["lang", "gram", "n"])

    totals = _marked(docs).mapInArrow(run, "lang STRING, gram LONG, n LONG").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return profiles_of([(r["lang"], r["gram"], r["rank"]) for r in top.select("lang", "gram", "rank").collect()], size)


def floors(docs: DataFrame, profiles: Profiles) -> dict[str, float]:
    """Of each language, the score that its own texts stay above: as far below
    the median as four standard deviations, where the distance from the median
    to the lowest hundredth is 2.326 of them; a few rows with a wrong mark do
    not move it.  From all documents that were learned, where mark and
    judgement agree; a language with none has no entry.  Scores count to six
    decimals, so no aggregate holds more than a million of them."""
    agreed = identify(_marked(docs), profiles).where("lang = lang_pred")
    counts = agreed.groupBy("lang", F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("lang").agg(F.percentile("score", [0.01, 0.5], F.col("n")).alias("q")).collect()
    return {r["lang"]: r["q"][1] - (r["q"][1] - r["q"][0]) * 4 / 2.326 for r in rows}


def identify(docs: DataFrame, profiles: Profiles, keep_from: float | dict[str, float] | None = None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, judged from
    ``text`` alone; columns of ``docs`` by these names are replaced.

    Null, empty or letterless text: ``und``, score 0.  With ``keep_from``, only
    rows of a known language and at least that score (that of the language, if
    it is a dict; a language without one keeps no row) are returned, with the
    columns of ``docs`` alone.  Repeated rows and null ids are judged like
    others; an empty table gives an empty result.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    filtering = keep_from is not None
    own = [f for f in docs.schema.fields if filtering or f.name not in ("lang_pred", "score")]
    least = keep_from if isinstance(keep_from, dict) else dict.fromkeys(profiles.languages, keep_from)
    schema = StructType(own if filtering else [*own, StructField("lang_pred", StringType()),
                                               StructField("score", DoubleType())])

    def run(batches):
        release_memory()
        for b in (x for whole in batches for x in byte_slices(whole, "text", 1 << 20)):
            found = [classify(t or "", profiles) for t in b.column("text").to_pylist()]
            if filtering:
                yield b.filter(pa.array([s >= least.get(x, np.inf) for x, s in found], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(f.name) for f in own], pa.array([x for x, _ in found], pa.string()),
                     pa.array([s for _, s in found], pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir):
    """Language of every whole text; learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold("doc_id", 4) == 2)
    profiles = learn(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select(
        "doc_id", "held_out", "lang_pred", "score")
