"""Refined ranges over a stream against the batch result."""

import random

from cadenza.operators.coverage import newest
from cadenza.streaming.revisions import _greatest, compacted, refined_ranges, revision_log

SCHEMA = "session string, start double, end double, revision int, text string"


def test_late_and_replayed_batches_leave_the_newest(spark, tmp_path):
    rng = random.Random(5)
    spans = spark.createDataFrame([(s, 3.0 * k, 3.0 * k + 3, rng.randrange(3)) for s in "ab" for k in range(12)], "session string, start double, end double, revision int")
    rows = []
    for i in range(160):
        k, n = rng.randrange(12), rng.choice([1, 1, 2])
        rows.append((rng.choice("abx"), 3.0 * k + rng.choice([0.0, 0.01, 0.05]), 3.0 * (k + n), rng.randrange(6), f"t{rng.randrange(3)}"))
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(4):
        spark.createDataFrame(rows[40 * part : 40 * part + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table, offsets = str(tmp_path / "table"), tmp_path / "offsets"

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        revision_log(stream, table).trigger(availableNow=True).option("checkpointLocation", str(offsets)).start().awaitTermination(120)

    def key(found):
        return sorted((r.session, r.start, r.end, r.revision) for r in found.collect())

    run()
    want = key(newest(df, spans))
    assert want and key(refined_ranges(spark, table, spans)) == want
    # the last batch's commit is lost, so it runs again
    commits = sorted((p for p in (offsets / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    rows_before = spark.read.parquet(table).count()
    run()
    assert spark.read.parquet(table).count() == rows_before and key(refined_ranges(spark, table, spans)) == want
    # a late range of an older revision changes nothing, a newer one does
    session, start, end, revision = want[0]
    spark.createDataFrame([(session, start, end, revision - 1, "late"), (session, start, end, revision + 1, "new")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    want[0] = (session, start, end, revision + 1)
    assert key(refined_ranges(spark, table, spans)) == want
    compacted(spark, table, str(tmp_path / "compact"))
    assert key(refined_ranges(spark, str(tmp_path / "compact"), spans)) == want


def test_of_equal_revisions_one_row_is_left_whatever_the_order(spark, tmp_path):
    rows = [("a", 0.0, 3.0, 2, "x"), ("a", 0.0, 3.0, 2, "y"), ("a", 0.0, 3.0, 1, "z"), (None, 0.0, 3.0, 1, None)]
    for order in (rows, rows[::-1]):
        path = str(tmp_path / str(order[0][4]))
        spark.createDataFrame(order, SCHEMA).write.parquet(path)
        assert sorted(_greatest(spark.read.parquet(path)).collect(), key=repr) == sorted([("a", 0.0, 3.0, 2, "y"), (None, 0.0, 3.0, 1, None)], key=repr)
