"""A made-up corpus of source files, for benchmarks: the same size and seed give the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension, line of code, line comment, documentation comment.
KINDS = [("rs", "let x = {};", "// note {}", "/// doc {}"), ("py", "x = {}", "# note {}", '"""doc {}"""'), ("js", "const x = {};", "// note {}", "/** doc {} */"), ("go", "x := {}", "// note {}", "// doc {}"), ("c", "int x = {};", "// note {}", "/** doc {} */")]
LEAST_LINES, MOST_LINES = 5, 400
BLANK, COMMENT, DOC = 12, 28, 36  # of a hundred lines: up to here blank, comment, documentation; the rest is code


def generate(spark: SparkSession, files: int, seed: int = 1337) -> DataFrame:
    """``path, content, size, expected_total, expected_code`` of ``files`` files."""
    base = spark.range(files).withColumn("lines", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(MOST_LINES - LEAST_LINES)) + LEAST_LINES).cast("int"))
    kind = (F.col("id") % len(KINDS) + 1).cast("int")
    part = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in KINDS)), kind)
    draw = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(100))

    def line(i):
        chosen = F.when(draw(i) < COMMENT, part(2)).when(draw(i) < DOC, part(3)).otherwise(part(1))
        return F.when(draw(i) < BLANK, F.lit("")).otherwise(F.replace(chosen, F.lit("{}"), i.cast("string")))

    numbers = F.sequence(F.lit(1), F.col("lines"))
    content = F.concat(F.array_join(F.transform(numbers, line), "\n"), F.lit("\n"))
    code = F.size(F.filter(numbers, lambda i: draw(i) >= DOC)).cast("long")
    path = F.concat(F.lit("pkg"), (F.col("id") % 50).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit("."), part(0))
    made = base.select(path.alias("path"), content.alias("content"), F.col("lines").cast("long").alias("expected_total"), code.alias("expected_code"))
    return made.withColumn("size", F.octet_length("content").cast("long"))
