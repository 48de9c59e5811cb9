"""Fill-in-middle: cut texts at line ends into prefix, middle and suffix, and put the middle last.

One fullmatch of (unit)* keeps every repetition of its group, so the group's ends are at once the number of lines and all offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices

#: Marks of prefix, suffix and middle; a line with its end, or the last one without; the hash's prefix.
MARKS = ("<P>", "<S>", "<M>")
LINE = r"[^\n]*+\n|[^\n]++"
SEED = 7
#: Percent of documents that are transformed, and of those the share in suffix-prefix-middle order.
RATE, SPM = 100, 50
CUT = "n long, prefix_chars long, middle_chars long"


def cuts(text: str, first: int, second: int, units: regex.Pattern) -> tuple[int, int, int]:
    """The number of units and the offsets after `first % (n + 1)` and `second % (n + 1)` of them, in order."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


def words_of(key: Column, seed: int) -> list[Column]:
    """Four unsigned numbers from the digest of seed and key; a null key is the empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED, marks: tuple[str, str, str] = MARKS, unit: str = LINE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row, from its whole text.

    The text stays in its task: Python gets slices of at most a few MB and returns three numbers a row, the output is
    composed of substrings by Spark; nothing is shuffled. plain rows are those with an empty (or null) text, with a mark in it, or beyond the
    rate; they come out as they are, with their n and null lengths. A cut may leave any part empty. A null doc_id is
    drawn like the empty string; repeated rows come out each; an empty table gives no rows; extra columns are ignored.
    `unit` is a pattern without groups that matches any non-empty text from left to right.
    """
    h1, h2, h3, h4 = words_of(F.col("doc_id"), seed)
    pattern = f"({unit})*+"

    @F.arrow_udf("struct<n long, a long, b long>")
    def cut(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        units, found = regex.compile(pattern), [np.zeros((0, 3), "i8")]
        for part in in_slices([pa.RecordBatch.from_arrays([text, first, second], ["t", "a", "b"])]):
            found.append(np.array([cuts(*row, units) for row in zip(*(part[c].to_pylist() for c in "tab"), strict=True)], "i8"))
        return pa.StructArray.from_arrays(list(map(pa.array, np.concatenate(found).T)), ["n", "a", "b"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    rows = rows.select("doc_id", "text", "h3", "h4", cut("text", "h1", "h2").alias("c"))
    marked = F.greatest(*[F.contains("text", F.lit(m)) for m in marks])
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    p, s, m = (F.lit(x) for x in marks)
    prefix, middle = F.substring("text", F.lit(1), F.col("c.a")), F.substring("text", F.col("c.a") + 1, F.col("c.b") - F.col("c.a"))
    suffix = F.substring("text", F.col("c.b") + 1, F.char_length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut_at = {"prefix_chars": F.col("c.a"), "middle_chars": F.col("c.b") - F.col("c.a")}
    return rows.withColumn("form", form).select("doc_id", F.col("c.n").alias("n"), "form", *[F.when(F.col("form") != "plain", v).alias(k) for k, v in cut_at.items()], output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from output and form alone: no part holds a mark, so each is found where it stands."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
