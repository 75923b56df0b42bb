"""Growing logs, endless corpora, indexed shards and the annealer in event order."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import corpus as P
from lexloom.operators import metrics as M
from lexloom.sources import byte_lines as BL
from lexloom.sources import metrics as SME
from lexloom.sources import shards as SH
from lexloom.streaming import line_sources as LS
from lexloom.streaming.live import anneal_stream, follow_metrics, metric_stream


@pytest.mark.parametrize("most", [1, 3, 7, 1000])
def test_spans_have_each_line_once(tmp_path, most):
    path = tmp_path / "f"
    for body in ("", "a", "a\n", "\n\n", "ab\r\ncd\n\nefgh", "é\n" * 20, "x" * 50 + "\ny"):
        path.write_bytes(body.encode())
        n = len(body.encode())
        got = [x for s in BL.spans(str(path), 0, n, most) for x in BL.read_span(s, s.begin == 0)]
        want, at = [], 0
        for line in body.encode().split(b"\n"):
            if at < n:
                want.append((at, line.rstrip(b"\r").decode()))
            at += len(line) + 1
        assert got == want
        assert BL.end_of_lines(str(path), 0, n) == body.encode().rfind(b"\n") + 1


def test_growing_log_is_read_once_a_byte(spark, tmp_path, monkeypatch):
    log, cp, seen = tmp_path / "log.jsonl", str(tmp_path / "cp"), []
    follow = lambda: follow_metrics(spark, str(log), ["loss"], cp, lambda df, n: seen.append([(r.step, r.loss) for r in df.orderBy("at").collect()])).awaitTermination()
    follow()
    assert seen == []
    log.write_text('{"step": 1, "loss": 2.5}\n{"step": 2, "lo')
    follow()
    follow()
    assert seen == [[(1, 2.5)]]
    with open(log, "a") as f:
        f.write('ss": 1.0}\n\n{"step": 3}\n{"st')
    follow()
    assert seen == [[(1, 2.5)], [(2, 1.0), (3, None)]]
    with open(log, "a") as f:
        f.write('ep": 4, "mix": "m"}\n')
    follow()
    batch = sorted(r.step for r in SME.read_metrics(spark, str(log), ["loss"]).filter("step is not null").collect())
    assert sorted(s for b in seen for s, _ in b) == batch == [1, 2, 3, 4]
    offsets = [json.loads(x.read_text().splitlines()[-1]) for x in sorted((tmp_path / "cp" / "offsets").iterdir(), key=lambda x: x.name) if x.name.isdigit()]
    places = [o.get(str(log), 0) for o in offsets]
    assert places == sorted(places) and places[-1] == log.stat().st_size
    with open(log, "a") as f:
        f.write("{broken\n")
    with pytest.raises(Exception, match="broken line"):
        follow()


def test_log_folder_and_shrunken_file(spark, tmp_path):
    folder, cp, seen = tmp_path / "logs", str(tmp_path / "cp"), []
    folder.mkdir()
    (folder / "_hidden").write_text("{}\n")
    (folder / "a").write_text('{"step": 1}\n' * 40)
    (folder / "b").write_text('{"step": 2}\n')
    stream = metric_stream(spark, str(folder), [])
    run = lambda: stream.writeStream.foreachBatch(lambda df, n: seen.extend((r.file[-1], r.step) for r in df.collect())).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    run()
    (folder / "b").open("a").write('{"step": 3}\n')
    (folder / "c").write_text('{"step": 4}\n')
    run()
    assert sorted(seen) == [("a", 1)] * 40 + [("b", 2), ("b", 3), ("c", 4)]
    (folder / "a").write_text('{"step": 1}\n')
    with pytest.raises(Exception, match="480"):
        run()


def corpus(tmp_path):
    rng, files = random.Random(6), []
    for i in range(4):
        path = tmp_path / f"c{i}.txt"
        lines = [rng.choice(["", "  ", "word " * rng.randint(1, 9) + str(j)]) for j in range(rng.randint(5, 40))]
        path.write_text("\n".join(lines) + rng.choice(["", "\n"]))
        files.append(path)
    with gzip.open(tmp_path / "d.txt.gz", "wt") as f:
        f.write("packed one\n\npacked two\n")
    return [str(p) for p in files] + [str(tmp_path / "d.txt.gz")]


def test_endless_corpus_equals_cycled_examples(spark, tmp_path):
    files, got, sizes = corpus(tmp_path), [], []
    cp = str(tmp_path / "cp")

    def run():
        def each(df, n):
            rows = [(r.epoch, r.path_ord, r.path_no, r.text) for r in df.orderBy("epoch", "path_ord", "at").collect()]
            sizes.append(len(rows))
            got.extend(rows)

        stream = LS.endless_lines(spark, files, seed=5, batch_bytes=700, passes=3, task_bytes=90)  # a run is a batch
        stream.writeStream.foreachBatch(each).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()

    known = -1
    while len(got) > known:  # every run starts anew from the checkpoint, mostly in the middle of a file
        known = len(got)
        run()
    lines = []
    for i, f in enumerate(files):
        text = gzip.open(f, "rt").read() if f.endswith(".gz") else open(f).read()
        lines += [(i, j, x) for j, x in enumerate(text.split("\n"))]
    batch = P.cycle_examples(spark.createDataFrame(lines, "path_no int, line_no int, text string"), 3, P.path_orders(files, 3, 5))
    want = [(r.epoch, r.path_ord, r.text) for r in batch.orderBy("example_no").collect()]
    assert [(e, o, t) for e, o, _, t in got] == want and len(sizes) >= 4
    orders = P.path_orders(files, 3, 5)
    assert all(orders[e][o] == p for e, o, p, _ in got)


def test_failed_batch_comes_again_and_positions_are_checked(spark, tmp_path):
    files, cp, got, fail = corpus(tmp_path), str(tmp_path / "cp"), [], [True]

    def each(df, n):
        rows = [(r.epoch, r.path_ord, r.at) for r in df.collect()]
        if len(got) > 20 and fail.pop() if fail else False:
            raise RuntimeError("lost")
        got.extend(rows)

    def run(**options):
        stream = LS.endless_lines(spark, files, **({"seed": 1, "batch_bytes": 600, "passes": 2} | options))
        stream.writeStream.foreachBatch(each).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()

    lost = 0
    known = -1
    while len(got) > known or not lost:
        known = len(got)
        try:
            run()
        except Exception:
            lost, known = lost + 1, -1
    assert lost == 1 and len(got) == len(set(got))
    whole = sum(1 for f in files for x in (gzip.open(f, "rt") if f.endswith(".gz") else open(f)) if x.strip())
    assert len(got) == 2 * whole
    with pytest.raises(Exception, match="other files or of another order"):
        run(seed=2)
    empty = tmp_path / "blank"
    empty.write_text(" \n\n")
    with pytest.raises(Exception, match="holds no example"):
        LS.endless_lines(spark, [str(empty)]).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()


def test_indexed_shards(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "shards")
    texts = spark.range(500).select(F.concat(F.lit("tëxt "), F.col("id"), F.repeat(F.lit("\n"), (F.col("id") % 3).cast("int"))).alias("t")).unionByName(spark.createDataFrame([("",)], "t string")).repartition(4)
    texts.write.parquet(str(tmp_path / "p"))
    SH.write_shards(texts, path, "t")
    rows = SH.read_shards(spark, path)
    read = {r.record: r.text for r in rows.collect()}
    assert sorted(read) == list(range(501)) and sorted(read.values()) == sorted(r.t for r in spark.read.parquet(str(tmp_path / "p")).collect())
    assert {r.record: r.text for r in SH.read_shards(spark, path, task_bytes=100).collect()} == read and SH.read_shards(spark, path, task_bytes=100).rdd.getNumPartitions() > 20
    listed = json.loads((tmp_path / "shards" / "shards.json").read_text())
    base = listed[0]["records"]
    for shard in listed[2:]:  # a range within the second shard opens no other one
        (tmp_path / "shards" / f"{shard['name']}.rec").rename(tmp_path / "shards" / f"{shard['name']}.away")
    some = rows.filter((F.col("record") >= base + 3) & (F.col("record") < base + 6))
    assert some.rdd.getNumPartitions() == 1 and {r.record: r.text for r in some.collect()} == {i: read[i] for i in range(base + 3, base + 6)}
    assert [r.record for r in rows.filter(F.col("record").isin(1, base, 900) & (F.col("record") > 0)).orderBy("record").collect()] == [1, base]
    assert [r.record for r in rows.filter((F.col("record") <= 1) & (F.col("text") != "none")).orderBy("record").collect()] == [0, 1]
    with pytest.raises(Exception):
        rows.collect()
    for shard in listed[2:]:
        (tmp_path / "shards" / f"{shard['name']}.away").rename(tmp_path / "shards" / f"{shard['name']}.rec")
    SH.write_shards(texts.limit(3), path, "t")
    assert SH.read_shards(spark, path).count() == 504
    with pytest.raises(Exception, match="no text"):
        SH.write_shards(spark.createDataFrame([("a",), (None,)], "t string"), path, "t")
    SH.write_shards(texts.limit(2), path, "t", mode="overwrite")
    assert sorted(r.record for r in SH.read_shards(spark, path).collect()) == [0, 1]


def test_annealer_in_event_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(run, step, rng.choice([0.01, 0.04, 0.2, None, float("nan")])) for run in ("a", "b") for step in range(40)]
    came = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 6))  # out of order by six steps at most
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "run_id string, step long, loss double, at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    at = lambda step: F.timestamp_seconds(F.lit(1_700_000_000) + step * 60)

    def feed(part, name):
        frame = spark.createDataFrame(part, "run_id string, step long, loss double").withColumn("at", at(F.col("step")))
        frame.coalesce(1).write.mode("append").parquet(str(folder))

    run = lambda: anneal_stream(stream, 9, 0.05, 5, "7 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    for i in range(0, 80, 27):
        feed(came[i : i + 27], i)
        run()
    feed([("z", 10_000, 0.0)], "end")
    run()
    run()
    got = {(r.run_id, r.step): r.progress for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = M.anneal(spark.createDataFrame(rows, "run_id string, step long, loss double"), "loss", 9, 0.05, 5, "step", ["run_id"])
    assert got == {(r.run_id, r.step): r.progress for r in batch.collect()}
