"""A stream of images that is stopped, goes on, and answers every different image once."""

import json
import os

import numpy as np

from linemetry import streaming
from linemetry.operators import segment
from test_analysis import line

DARK = segment.Segmenter("dark", "test", True, lambda tile: 1 - tile / 255, tile=128, overlap=32, threshold=0.5)


def drop(spark, folder, images):
    rows = [(i, *g.shape, bytearray(np.rint(255 * (1 - g)).astype(np.uint8).tobytes())) for i, g in images.items()]
    spark.createDataFrame(rows, streaming.IMAGE).coalesce(1).write.mode("append").parquet(folder)


def answers(spark, sink):
    rows = spark.read.parquet(sink).collect()
    return sorted(r.image_id for r in rows), {r.image_id: json.loads(r.body) for r in rows}


def test_each_image_is_answered_once(spark, tmp_path):
    folder, sink, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    flat, slanted, fork = line(60, 90, (30, 10), (30, 80), 5), line(70, 70, (10, 10), (60, 60), 4), np.maximum(line(90, 120, (30, 10), (30, 110), 5), line(90, 120, (30, 60), (80, 60), 5))
    drop(spark, folder, {1: flat, 2: slanted, 3: flat, 4: np.zeros((20, 20))})  # 3 is 1 again, 4 is too small

    def run():
        query = streaming.measured(streaming.arriving(spark, folder), DARK, sink, checkpoint)
        query.awaitTermination(300)
        assert query.exception() is None
        return answers(spark, sink)

    ids, first = run()
    assert len(ids) == 2 and 2 in ids and ids[0] in (1, 3)
    assert first[2]["summary"]["instance_count"] == 1 and abs(first[2]["summary"]["total_length_px"] - 71) < 6 and first[2]["scale"]["note"] == "no scale"
    assert len(first[2]["instances"]["items"][0]["paths"]["items"]) == 1
    drop(spark, folder, {5: slanted, 6: fork})  # 5 is 2 again
    ids, second = run()
    assert ids == sorted([*first, 6]) and len(second[6]["instances"]["items"][0]["paths"]["items"]) == 3
    # the last batch was written, but its end wasn't noted: it is made again, and replaces what it left
    commits = f"{tmp_path}/state/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    assert run() == (ids, second)
