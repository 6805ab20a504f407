"""Fill-in-the-middle: documents cut at two unit boundaries and reordered, so
that a left-to-right model learns to fill a gap.

A unit is a run of blanks and the word behind it (or the blanks that end the
text).  Each batch is one ``pyarrow.compute`` pipeline over whole columns: texts
are split into list arrays, the lists are flattened with their parents, each
unit gets its ordinal and from that its role (prefix, middle, suffix), the units
of a role are filtered and put into lists again, and the lists are joined into
pieces.  Where to cut and which form to use follow from SHA-256 of a seed and
the document's id, which Spark computes before.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import byte_slices, table, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: No UTF-8 text holds this byte.
MARK = b"\xff"


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers from SHA-256 of ``seed:doc_id`` (null id:
    nothing behind the colon)."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _mod(x, m):
    return pc.subtract(x, pc.multiply(pc.divide(x, m), m))


def _arrange(texts: pa.Array, h: list[pa.Array], rate: int, spm: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of a column of texts."""
    rows = len(texts)
    raw = texts.cast(pa.large_binary())
    units = pc.split_pattern(pc.replace_substring_regex(raw, pattern=UNIT, replacement=b"\\0" + MARK), pattern=MARK)
    # a mark ends every unit, so each list has one empty entry behind its units
    n = pc.subtract(pc.list_value_length(units).cast(pa.int64()), 1)
    values, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(values))), pc.take(units.offsets.cast(pa.int64()), parent))
    cuts = [_mod(x, pc.add(n, 1)) for x in h[:2]]
    first, second = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)

    def from_(bound):
        return pc.greater_equal(ordinal, pc.take(bound, parent))

    def piece(role):
        kept = np.bincount(pc.filter(parent, role).to_numpy(), minlength=rows)
        offsets = pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.filter(values, role)), pa.scalar(b"", raw.type))

    late, behind = from_(first), from_(second)
    prefix = piece(pc.invert(late))
    middle = piece(pc.and_not(late, behind))
    suffix = piece(pc.and_not(behind, from_(n)))
    marked = pc.match_substring_regex(raw, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
    plain = pc.or_(pc.or_(pc.equal(n, 0), marked), pc.greater_equal(_mod(h[2], pa.scalar(100, pa.int64())), rate))
    use_spm = pc.less(_mod(h[3], pa.scalar(100, pa.int64())), spm)
    p, s, m, none = (pa.scalar(x.encode(), raw.type) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    reordered = pc.if_else(use_spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
                           pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none))
    form = pc.if_else(plain, "plain", pc.if_else(use_spm, "spm", "psm"))
    nothing = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, nothing, pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64()))
             for x in (prefix, middle)]
    return n, form, *chars, pc.if_else(plain, raw, reordered).cast(pa.large_string()).cast(pa.string())


NEW = StructType([StructField("n", LongType()), StructField("form", StringType()),
                  StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()),
                  StructField("output", StringType())])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """All columns of ``docs`` with ``n`` (units), ``form``, ``prefix_chars``,
    ``middle_chars`` (code points) and ``output``; such columns of ``docs`` are
    replaced.  ``rate`` percent of the documents are reordered, ``spm`` percent
    of these with the suffix first.

    Null text counts as empty; empty texts and texts that hold one of the three
    marks stay as they are (``plain``, lengths null).  A null ``doc_id`` draws as
    an empty id; repeated rows come out alike, as often as they are there.  Texts
    are taken whole; batches are cut into slices of some 8 MB of text, a longer
    text is a slice of its own.  An empty table gives an empty result.
    """
    own = [f for f in docs.schema.fields if f.name not in NEW.names]
    schema = StructType([StructField("row", StructType(own)), *NEW.fields])
    rows = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in own]).alias("row"), whole_text().alias("text"),
                       *[x.alias(f"h{i}") for i, x in enumerate(draws(F.col("doc_id"), seed))])

    def run(batches):
        for b in batches:
            for part in byte_slices(b, "text"):
                made = _arrange(part.column("text"), [part.column(f"h{i}") for i in range(4)], rate, spm)
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], schema.names)

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("row")[f.name].alias(f.name) for f in own], *NEW.names)


def restored(output: Column, form: Column) -> Column:
    """The exact text before the reordering.  A reordered text holds each mark
    once: the marks begin with ``<``, end with ``>`` and hold neither elsewhere,
    so no mark arises where pieces meet."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    return (F.when(form == "psm", F.concat(parts[0], parts[2], parts[1]))
            .when(form == "spm", F.concat(parts[1], parts[2], parts[0])).otherwise(output))


def op11_fill_in_middle(spark, sf_dir):
    """Every whole document, half of them reordered, with digests of the output
    and of the text rebuilt from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs, 42, 50, 80)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h
  FROM d
),
c AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
         greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
p AS (
  SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
