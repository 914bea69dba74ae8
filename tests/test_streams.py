
from tesselar.sources import sinks, tags
from tesselar.streaming import reviews

SF = "/root/testdata/sf0.001"


def events(spark):
    from tesselar.plans.fixtures import load

    return load(spark, SF, "review_events")


def run(query_df, name, mode):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_history_rules():
    assert reviews.history(["recover"] * 40) == (30, 0)
    assert reviews.history(["open_gap"]) == (1, 0)
    assert reviews.history(["recover", "open_gap", "select"]) == (2, 0)
    assert reviews.history(["recover", "open_gap", "delete", "select"]) == (2, 0)


def test_stream_equals_batch(spark, tmp_path):
    batch = events(spark)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run(reviews.history_stream(stream), "depths", "update")
    want = {(r.session_id, r.undo, r.redo) for r in reviews.replay_history(batch).collect()}
    assert {tuple(r) for r in spark.table("depths").collect()} == want
    run(reviews.funnel_stream(stream, late="3650 days"), "funnel", "complete")
    assert spark.table("funnel").selectExpr("sum(n)").first()[0] == batch.count()
    assert reviews.deduplicated(stream).isStreaming and reviews.reviewer_sessions(stream).isStreaming


def test_tag_files_round_trip(spark, tmp_path):
    text = "\n".join(["0", "SECTION", "2", "TABLES", "0", "LAYER", "2", "WALL", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", "0", "LINE", "8", "WALL", "10", "0", "20", "0", "11", "5", "21", "0", "0", "ARC", "8", "WALL", "10", "0", "20", "0", "40", "10", "50", "0", "51", "90", "0", "LWPOLYLINE", "8", "WALL", "70", "1", "10", "0", "20", "0", "10", "1", "20", "0", "10", "1", "20", "1", "0", "TEXT", "8", "NOTES", "0", "ENDSEC", "0", "EOF"])
    (tmp_path / "a.dxf").write_text(text)
    rows = tags.tags(tags.read_tag_files(spark, str(tmp_path)))
    found = tags.entities(rows)
    assert sorted(r.type for r in found.collect()) == ["ARC", "LINE", "LWPOLYLINE", "TEXT"]
    assert [r.name for r in tags.layers(rows).collect()] == ["WALL"]
    count = tags.segments(found).groupBy("record").count().toPandas()["count"].sort_values().tolist()
    assert count == [1, 3, 64]
    assert tags.drawing_catalog(spark, str(tmp_path)).count() == 1
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.dxf"))
    assert sinks.delivery_manifest(files).first().category == "drawing"


def test_tag_files_in_ranges(spark, tmp_path):
    """Ranges of some hundred bytes begin in records, between a code and its value and at a section's name; the tags are those of the whole texts."""
    import random

    rng = random.Random(3)
    for name in ("a", "b", "c"):
        body = ["  0", "SECTION", "  2", "TABLES", "  0", "LAYER", "  2", "WALL", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
        for k in range(rng.randint(0, 120)):
            body += ["0", rng.choice(["LINE", "TEXT"]), " 8", rng.choice(["WALL", "0", "2"]), "10", str(k), "20", "0", "1", rng.choice(["", "SECTION", " 2 ", "ü" * 9]), "11", "5", "21", "-7.5", "-1", "x"]
            body += ["0", "ENDSEC", "0", "SECTION", "2", f"S{k}"] if rng.random() < 0.02 else []
        (tmp_path / f"{name}.dxf").write_text(("\r\n" if name == "b" else "\n").join([*body, "0", "ENDSEC", "0", "EOF"]) + ("\n" if name == "a" else ""))
    (tmp_path / "empty.dxf").write_text("")
    whole = tags.tags(tags.read_tag_files(spark, str(tmp_path)))
    order = lambda df: sorted((r.drawing.rsplit("/", 1)[1], r.pos, r.code, r.value, r.section) for r in df.collect())
    groups = lambda df: sorted(sorted(x) for x in df.groupBy("drawing", "record").agg({"pos": "collect_list"}).toPandas().iloc[:, 2].map(list))
    want, want_groups = order(whole), groups(whole)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("97b", "300b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = tags.read_tags(spark, str(tmp_path))
            assert order(got) == want and groups(got) == want_groups
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tag_files_in_sheets(spark, tmp_path):
    rings = spark.range(50).selectExpr("id % 2 as drawing", "array(named_struct('x', id, 'y', 0), named_struct('x', id + 1, 'y', 0), named_struct('x', id, 'y', 3)) as ring")
    sinks.write_tag_files(sinks.ring_tags(rings), str(tmp_path / "t"), rings.selectExpr("drawing", "'L' as layer"), sheet=9)
    rows = tags.read_tags(spark, str(tmp_path / "t"), "*.txt").cache()
    found = tags.entities(rows)
    assert rows.select("drawing").distinct().count() >= 4
    assert sorted((r.vertices[0].x, r.vertices[1].x, r.closed) for r in found.collect()) == [(float(k), float(k + 1), True) for k in range(50)]
    assert {r.name for r in tags.layers(rows).collect()} == {"L"}


def test_versions(spark, tmp_path):
    log = sinks.Log(spark, f"file://{tmp_path}/v")
    schema = "project string, polygons long"
    save = lambda *rows: log.save(spark.createDataFrame(list(rows), schema))
    kind = spark.createDataFrame([], schema).schema
    assert log.read(kind).count() == 0 and log.latest(kind, "project").count() == 0
    assert [save(("p", 5)), save(("p", 7), ("q", 2)), save(("q", 4), ("q", 6))] == [1, 2, 3]
    assert sorted(map(tuple, log.versions(kind, "project").collect())) == [("p", 5, 1), ("p", 7, 2), ("q", 2, 1), ("q", 4, 2), ("q", 6, 2)]
    assert sorted(map(tuple, log.latest(kind, "project").collect())) == [("p", 7), ("q", 4), ("q", 6)]


def test_writers_at_once(spark, tmp_path):
    """Eight writers get eight numbers; one that fails after its data, or before it, leaves nothing to be read."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/v"
    kind = spark.createDataFrame([], "project string, polygons long").schema

    def write(k):
        log = sinks.Log(spark, path)
        if k == 5:
            log._create = lambda *_: 1 / 0
        return log.save(spark.createDataFrame([("p", k)], kind))

    with ThreadPoolExecutor(9) as pool:
        jobs = [pool.submit(write, k) for k in range(9)]
    numbers = [j.result() for k, j in enumerate(jobs) if k != 5]
    assert jobs[5].exception() and sorted(numbers) == list(range(1, 9))
    got = sinks.Log(spark, path).versions(kind, "project").collect()
    assert sorted((r.version, r.polygons) for r in got) == sorted(zip(numbers, (k for k in range(9) if k != 5), strict=True))
    assert not [f for f in (tmp_path / "v" / "log").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_files_that_arrive(spark, tmp_path):
    """Two runs from one checkpoint, in batches of two files, keep what a batch read of all files gives; a batch that is run again changes nothing."""
    from pyspark.sql import types as K

    from tesselar.streaming import arrivals as A

    def drawing(name, n):
        lines = [x for k in range(n) for x in ("0", "LINE", "8", "W", "10", str(k), "20", "0", "11", str(k + 1), "21", "5")]
        (tmp_path / "in" / name).write_text("\n".join(["0", "SECTION", "2", "ENTITIES", *lines, "0", "ENDSEC", "0", "EOF"]))

    def run():
        A.ingest(A.files_stream(spark, f"{tmp_path}/in", 2), f"file://{tmp_path}/out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        log = lambda n, s: sorted(tuple(r)[:-1] for r in sinks.Log(spark, f"file://{tmp_path}/out/{n}").read(K._parse_datatype_string(s)).collect())
        return log("segments", A.SEGMENTS), log("checks", A.CHECKED)

    (tmp_path / "in").mkdir()
    for name, n in (("a.dxf", 3), ("b.dxf", 1), ("c.exe", 2)):
        drawing(name, n)
    first = run()
    assert len(first[0]) == 4 and len(first[1]) == 3
    for name, n in (("d.dxf", 5), ("e.dxf", 0)):
        drawing(name, n)
    segments, checks = run()
    assert len(segments) == 9 and len(checks) == 5 and set(first[0]) <= set(segments)
    want = tags.segments(tags.entities(tags.read_tags(spark, str(tmp_path / "in"))))
    assert sorted(s[1:] for s in segments) == sorted((r.layer, r.x1, r.y1, r.x2, r.y2) for r in want.collect())
    assert {p.rsplit("/", 1)[1]: c for p, _, c in checks}["c.exe"] == "suffix" and sum(c == "ok" for _, _, c in checks) >= 3
    assert run() == (segments, checks)
    log = sinks.Log(spark, f"file://{tmp_path}/out/checks")
    assert not log.save_as(1, spark.createDataFrame([], A.CHECKED)) and len(log._numbers()) >= 3
