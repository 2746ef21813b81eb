from pyspark.sql import functions as F

from sieveline.functions import text


def test_a_marker_far_up_the_block_suppresses(spark):
    rows = []
    for gap in (0, 9, 10, 11, 40, 300):
        rows += [(gap, "blank", ["// smell:ignore", *[""] * gap, "void m() {"], True), (gap, "comment", ["/* smell:ignore(GodClass)", *["* more"] * gap, "void m() {"], True), (gap, "other", ["// smell:ignore", "int x;", *[""] * gap, "void m() {"], False)]
    frame = spark.createDataFrame(rows, "gap int, kind string, l array<string>, want boolean")
    got = frame.select("gap", "kind", "want", text.suppressed(F.col("l"), F.size("l"), F.lit("GodClass")).alias("got")).collect()
    assert [(r.gap, r.kind) for r in got if r.got != r.want] == []
