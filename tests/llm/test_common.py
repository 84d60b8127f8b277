"""Helpers of the training-data operators."""

import weakref

import pyarrow as pa

from tideline.llm import common
from tideline.llm.common import appended


def test_a_text_travels_once_and_its_bytes_are_whole(spark):
    """The text column is read as it is: no second column with its bytes is sent to the workers."""
    docs = spark.createDataFrame([(1, "aé中", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, own int")
    got = appended(docs, lambda: lambda texts: [pa.array([x.hex() for x in texts])], "h string", 4)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "aé中", 7, "aé中".encode().hex()), (2, None, 8, ""), (3, "", 9, "")]
    assert "cast(coalesce(text" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_memory_is_given_back_after_the_data_of_a_task_is_gone(monkeypatch):
    """A kept worker counts against its executor, so nothing of a task may be held when the memory is given back."""
    seen = []

    class Held:
        pass

    def task(batches):
        own = Held()
        alive.append(weakref.ref(own))
        yield from batches

    alive = []
    monkeypatch.setattr(common, "returned", lambda: seen.append(alive[-1]() if alive else None))
    assert list(common.freeing(task)(iter([1, 2]))) == [1, 2]
    assert len(alive) == 1 and seen == [None]
    assert common.freeing_groups(lambda group: group)(3) == 3 and len(seen) == 2
