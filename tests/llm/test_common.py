import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from heronflow.llm import common


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_a_worker_gives_memory_back_after_a_task(spark):
    """A worker that waits for its next task once kept all that it had freed."""

    def run(batches):
        for batch in batches:
            blocks = [np.ones(1_000) for _ in range(20_000)]  # 160 MB, in pieces that malloc keeps
            last = [blocks[k] for k in range(0, len(blocks), 200)]
            del blocks
            yield batch
            del last

    def held(batches):
        for batch in batches:
            kb = re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
            yield pa.record_batch([pa.array([int(kb[0]) / 1024])], names=["mb"])

    one = spark.range(1).coalesce(1)
    before = one.mapInArrow(held, "mb double").first()["mb"]
    one.mapInArrow(common.releasing(run), "id bigint").collect()
    assert one.mapInArrow(held, "mb double").first()["mb"] < before + 60
