"""Fill-in-the-middle: texts cut in three at units and put together again around sentinels.

A unit is a run of A-Z and a-z or any other single code point. Counting a text
walks its bytes once, in blocks, and leaves a sparse index: byte and code-point
offsets of every EVERY-th unit. A cut is then found by binary search in the
index and a short rescan from the checkpoint before it, so no list of units is
ever held, whatever the length of the text.

Edge cases: a null text counts as empty, and an empty text stays plain; so does
a text that holds a sentinel itself, as it couldn't be put together again. A
null id is drawn for as the empty text. Repeated rows are cut alike, since the
draws depend on the id only; cuts that fall together leave an empty middle.
An empty table gives no rows, and other columns of the input are carried along
unless their name is one of the results'.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_batches, read

#: Units between two checkpoints, and bytes that counting looks at together.
EVERY, BLOCK = 256, 1 << 20
#: Bytes that a rescan looks at first; it doubles them until it has passed the cut.
STEP = 1 << 10

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True

MADE = ("n_units", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Plan:
    """Sentinels, the share of texts that are cut (in hundredths), the share of those in suffix-first form, and the seed of the draws."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut: int = 90
    suffix_first: int = 20
    seed: int = 1


def unit_starts(data: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """(where units begin, where code points begin) as masks over bytes of UTF-8; after_letter: whether a letter stands before them."""
    letter = _LETTER[data]
    points = (data & 0xC0) != 0x80
    before = np.empty_like(letter)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    return points & ~(letter & before), points


class Checkpoints:
    """Number of units and code points of a text, and the offsets of every `every`-th unit."""

    def __init__(self, data: bytes, every: int = EVERY):
        self.data, self.every = data, every
        self.bytes, self.points = [], []
        self.n_units = self.n_points = 0
        x = np.frombuffer(data, np.uint8)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            units, points = unit_starts(part, at > 0 and bool(_LETTER[x[at - 1]]))
            begins = np.flatnonzero(units)
            chosen = begins[-self.n_units % every :: every]
            if len(chosen):
                self.bytes += (chosen + at).tolist()
                self.points += (np.cumsum(points, dtype=np.int64)[chosen] - 1 + self.n_points).tolist()
            self.n_units += len(begins)
            self.n_points += int(np.count_nonzero(points))

    def find(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit begins; the unit behind the last one begins at the end."""
        if unit >= self.n_units:
            return len(self.data), self.n_points
        k = bisect.bisect_right(range(0, self.n_units, self.every), unit) - 1
        at, points, left, size = self.bytes[k], self.points[k], unit - k * self.every, STEP
        after_letter = False  # a checkpoint begins a unit, whatever stands before it
        while at < len(self.data):
            part = np.frombuffer(self.data, np.uint8, min(size, len(self.data) - at), at)
            units, firsts = unit_starts(part, after_letter)
            begins = np.flatnonzero(units)
            if len(begins) > left:
                return at + int(begins[left]), points + int(np.count_nonzero(firsts[: begins[left]]))
            left -= len(begins)
            points += int(np.count_nonzero(firsts))
            after_letter = bool(_LETTER[part[-1]])
            at, size = at + len(part), 2 * size
        return at, points


def _draws(doc_id, seed: int) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(doc_id, data: bytes, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    index = Checkpoints(data)
    h1, h2, h3, h4 = _draws(doc_id, plan.seed)
    p, s, m = plan.prefix.encode(), plan.suffix.encode(), plan.middle.encode()
    if not data or p in data or s in data or m in data or h3 % 100 >= plan.cut:
        return index.n_units, "plain", None, None, data
    first, second = sorted((h1 % (index.n_units + 1), h2 % (index.n_units + 1)))
    (a, a_points), (b, b_points) = index.find(first), index.find(second)
    head, between, tail = data[:a], data[a:b], data[b:]
    if h4 % 100 < plan.suffix_first:
        return index.n_units, "spm", a_points, b_points - a_points, b"".join((s, tail, p, head, m, between))
    return index.n_units, "psm", a_points, b_points - a_points, b"".join((p, head, s, tail, m, between))


def transform(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds MADE: the number of units, the form (plain, psm or spm), the code points of prefix and middle (null if plain), and the output text.

    The text itself goes, as the output holds it; restore() brings it back.
    """
    docs = docs.drop(*[c for c in MADE if c not in (key, text)])
    carried = [f for f in docs.schema.fields if f.name != text]
    made = [StructField("n_units", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = b[text].cast(pa.large_binary())
            rows = [transformed(k, x or b"", plan) for k, x in zip(b[key].to_pylist(), texts.to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * len(made)
            output = pa.array(columns[4], pa.large_binary()).cast(pa.large_string())
            yield {f.name: b[f.name] for f in carried} | dict(zip([f.name for f in made], [*columns[:4], output]))

    return map_batches(docs.withColumn(text, F.col(text).cast("string")), run, StructType(carried + made))


def restore(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Adds `text`, rebuilt from the output and its form alone."""
    quoted = "|".join(map(re.escape, (plan.prefix, plan.suffix, plan.middle)))
    parts = F.split("output", quoted, -1)
    part = lambda i: F.get(parts, F.lit(i))
    joined = F.when(F.col("form") == "psm", F.concat(part(1), part(3), part(2))).when(F.col("form") == "spm", F.concat(part(2), part(3), part(1)))
    return rows.withColumn("text", joined.otherwise(F.col("output")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(transform(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') us, cast('0x' || substr(h, 1, 8) as bigint) h1, cast('0x' || substr(h, 9, 8) as bigint) h2,
  cast('0x' || substr(h, 17, 8) as bigint) h3, cast('0x' || substr(h, 25, 8) as bigint) h4 from d),
c as (select doc_id, t, us, len(us) n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from u),
p as (select *, array_to_string(list_slice(us, 1, a), '') p, array_to_string(list_slice(us, a + 1, b), '') m, array_to_string(list_slice(us, b + 1, n), '') s from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(p) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256
from p
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": OP11_SQL}
