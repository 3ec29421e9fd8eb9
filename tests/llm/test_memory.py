"""What Python workers hold between tasks."""

import pyarrow as pa
import pytest

from tracewise.llm import decontamination, neardup, quality, shared


def _held_by_workers(batches):
    from tracewise.llm import shared as own

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(t.nbytes for t in own._powers.values())] * b.num_rows)], names=["n"])


@pytest.mark.parametrize("name", ["quality", "neardup", "decontamination"])
def test_idle_workers_hold_no_tables(spark, sf, name):
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.repartition(4)
    if name == "quality":
        quality.scored(docs, quality.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))).write.format("noop").mode("overwrite").save()
    elif name == "neardup":
        neardup.described(docs, 5).write.format("noop").mode("overwrite").save()
    else:
        decontamination.find(docs, benchmark, clean=True).write.format("noop").mode("overwrite").save()
    assert {r["n"] for r in spark.range(0, 64, 1, 8).mapInArrow(_held_by_workers, "n long").collect()} == {0}


def test_memory_is_given_back_also_when_a_step_fails_or_is_left():
    def step(batches):
        for b in batches:
            shared._power_tables(10)
            yield b

    run = shared.giving_back(step)
    assert list(run(iter([1, 2]))) == [1, 2] and not shared._powers
    left = run(iter([1, 2]))
    next(left)
    assert shared._powers
    left.close()
    assert not shared._powers
    with pytest.raises(ZeroDivisionError):
        list(run(1 // 0 for _ in range(1)))
    assert not shared._powers
