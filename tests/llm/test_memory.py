"""What Python workers keep: nothing of another operator, and no memory that is free."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

from feedloom.llm import phrases, simhash

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module

FREED = """
import re, pyarrow as pa
from feedloom.llm import common

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

def used(batch):
    pieces = [bytearray(100_000) for _ in range(1500)]
    return bytearray(100_000)  # lies above the pieces, so that the allocator keeps what they held

batches, pins = [pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"])] * 2, []
before = held()
for batch in common.sliced(batches, "text", 1 << 20):
    pins.append(used(batch))
print(held() - before)
"""


def test_memory_goes_back_after_each_batch():
    run = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, check=True)
    assert int(run.stdout) < 50


def occupied(batches, run):
    """run, in a worker that holds something of another operator."""
    from feedloom.llm import common

    common._RESIDENT[:] = ["another", "operator's"]
    yield from run(batches)
    if common._RESIDENT[0]:
        raise AssertionError("what another operator keeps is still there")


def occupied_group(run):
    def one(table):
        from feedloom.llm import common

        common._RESIDENT[:] = ["another", "operator's"]
        out = run(table)
        if common._RESIDENT[0]:
            raise AssertionError("what another operator keeps is still there")
        return out

    return one


def occupied_groups(run):
    def both(left, right):
        return occupied_group(lambda _: run(left, right))(None)

    return both


@pytest.fixture
def docs(spark):
    text = " ".join(f"w{i}" for i in range(40))
    return spark.createDataFrame([(i, text + f" end{i}") for i in range(8)], "doc_id long, text string")


def test_near_dedup_drops_what_others_keep(spark, docs, monkeypatch):
    kind = type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: plain(self, lambda batches: occupied(batches, f), *a, **k))
    assert {r.doc_id for r in simhash.near_duplicate_groups(docs).collect()} == set(range(1, 8))
    assert {r.component_id for r in simhash.near_duplicate_components(docs, radius=3).collect()} <= set(range(8))


def test_substring_dedup_drops_what_others_keep(spark, docs, monkeypatch):
    group, cogroup = PandasGroupedOpsMixin.applyInArrow, PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", lambda self, f, schema: group(self, occupied_group(f), schema))
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: cogroup(self, occupied_groups(f), schema))
    found = {r.doc_id: r.n_removed for r in phrases.dedup_substrings(docs).collect()}
    assert found == {0: 0} | dict.fromkeys(range(1, 8), 40)
