"""Fill-in-the-middle: texts cut in three at two units drawn from the row's id, and put together in another order.

A text is matched twice by a lazy iterator over its units (code points, unless another pattern is given).  The first pass
counts them; the second advances a new iterator to the smaller and then to the larger rank and takes the ends of those two
matches.  No array of units, matches or offsets is ever made: beside the text itself a task holds two numbers.

Defined results: null text reads as empty; an empty text, or one that contains a mark, stays plain; a null doc_id draws as
the empty string does; rows that repeat are rows of their own; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, load, narrowed

BATCH_BYTES = 8 << 20
SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"


@dataclass(frozen=True)
class Plan:
    """How texts are cut: the pattern of a unit, the marks, the seed of the draws, and shares in percent."""

    unit: str = r"(?s)."
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1"
    changed: int = 90
    suffix_first: int = 20

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self):
        """Marks must be found where they were put, whatever text stands beside them."""
        for a in self.marks:
            for b in self.marks:
                if not a or (a != b and a in b) or any(a[:k] == b[-k:] for k in range(1, len(a)) if (a, k) != (b, len(b))):
                    raise ValueError(f"marks that are empty or overlap cannot be told apart: {a!r}, {b!r}")
        if len(set(self.marks)) < 3:
            raise ValueError("three different marks are needed")


def draws(seed: str, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the sha256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def n_units(text: str, unit: re.Pattern) -> int:
    """First pass: matches are counted and forgotten one by one."""
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def unit_ends(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the first-th and the second-th unit end (first <= second; rank 0 ends at 0)."""
    found = unit.finditer(text)
    a = next(islice(found, first - 1, None)).end() if first else 0
    b = next(islice(found, second - first - 1, None)).end() if second > first else a
    return a, b


def transformed(text: str, doc_id: int | None, plan: Plan, unit: re.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, units of the prefix, units of the middle, output) of one text."""
    n = n_units(text, unit)
    h = draws(plan.seed, doc_id)
    if not text or any(m in text for m in plan.marks) or h[2] % 100 >= plan.changed:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = unit_ends(text, unit, first, second)
    p, m, s = f"{plan.prefix}{text[:a]}", f"{plan.middle}{text[a:b]}", f"{plan.suffix}{text[b:]}"
    form = "spm" if h[3] % 100 < plan.suffix_first else "psm"
    return n, form, first, second - first, (s + p + m if form == "spm" else p + s + m)


def _run(plan: Plan):
    def run(batches):
        unit = re.compile(plan.unit)
        for batch in byte_rows(BATCH_BYTES, batches):
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            rows = [transformed(t.as_py() or "", d.as_py(), plan, unit) for d, t in zip(ids, texts)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, output of every row; one pass without a shuffle."""
    texts = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_run(plan), SCHEMA)


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that an output of that form was made from."""
    part = lambda x, mark, k: F.split_part(x, F.lit(mark), F.lit(k))
    head, middle = part(output, plan.middle, 1), part(output, plan.middle, 2)
    psm = F.concat(part(part(head, plan.suffix, 1), plan.prefix, 2), middle, part(head, plan.suffix, 2))
    spm = F.concat(part(head, plan.prefix, 2), middle, part(part(head, plan.prefix, 1), plan.suffix, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document."""
    made = fill_in_middle(load(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS x, greatest(a, b) AS y, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
