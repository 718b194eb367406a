"""Sources and sinks on small files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.sources import files, images, tables
from quillspan.streaming import arrivals


def test_genome_traces_keep_their_order(spark, tmp_path):
    rng = random.Random(1)
    lines, want = ["z\tx\ty\tcoord\ta\tb\tc\tgenes\tstates\tlamina"], []
    for i in range(3 * 2 * 5):
        z = None if rng.random() < 0.2 else rng.random()
        lines.append("\t".join(["nan" if z is None else str(z), "1.5", "2.5", f"chr{i % 5}:{i}-{i + 10}", "", "", "", "G1,G2" if i % 2 else "", "on,off" if i % 2 else "", str(i)]))
        want.append((i // 10, i // 5 % 2, i % 5, z, f"chr{i % 5}", i, i + 10, ["G1", "G2"] if i % 2 else None, float(i)))
    (tmp_path / "g.tsv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = tables.read_genome_traces(spark, str(tmp_path / "g.tsv"), 5, ["lamina"])
        rows = got.select("cell", "copy", "locus", "z", "chr", "start", "end", "genes", "lamina").collect()
        assert got.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, rows), key=lambda r: r[:3]) == want


def test_annotations(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,chr,start,end\n3,chr2,10,20\n4,chr2,x,30\n")
    assert [tuple(r) for r in tables.read_annotation(spark, str(tmp_path / "r.csv"), "regions").orderBy("id").collect()] == [(3, "chr2", 10, 20), (4, "chr2", None, 30)]
    (tmp_path / "c.txt").write_text("chr\tstart\tend\tfold\tmidpoint\nchr1\t1\t5\t2.5\t3\n")
    assert tuple(tables.read_annotation(spark, str(tmp_path / "c.txt"), "chip", "\t").first()) == ("chr1", 1, 5, 2.5, 3.0)
    (tmp_path / "g.csv").write_text("id,name,chr,start,end,TSS_position,midpoint\n1,a,chr1,1,9,2,5\n")
    r = tables.read_annotation(spark, str(tmp_path / "g.csv"), "genes").first()
    assert (r.id, r.name, r.TSS_position, r.midpoint) == (1, "a", 2, 5.0)
    (tmp_path / "t.csv").write_text("a, 2\n\n3,x\n")
    assert [tuple(r) for r in tables.read_typed(spark, str(tmp_path / "t.csv")).orderBy("row", "column").collect()] == [(0, 0, "a", None), (0, 1, "2", 2.0), (2, 0, "3", 3.0), (2, 1, "x", None)]


def test_encoding_and_codebooks(spark, tmp_path):
    (tmp_path / "e.csv").write_text("hyb,750,750,647,647\nnum_hyb,2\nnum_reg,2\nnum_color,2\nH1,1,,,\nH2,2,3,,\nH3,4,5,6,7\nH4,,8,9,10\n")
    got = {(r.color, r.group, r.hyb, r.name, r.region): r.code for r in tables.read_encoding(spark, str(tmp_path / "e.csv")).collect()}
    assert len(got) == 12 and got["750", 0, 0, "H1", 0] == 1 and got["750", 0, 0, "H1", 1] == -1 and got["647", 1, 1, "H4", 1] == 10 and ("647", 0, 0, "H1", 0) not in got
    (tmp_path / "k.csv").write_text("name,a,b,code\nx__1,0,0,17--3\n")
    assert tuple(tables.read_codebook(spark, str(tmp_path / "k.csv")).first()) == ("x_1", 3, 17)
    names = spark.createDataFrame([("p_ChrTAD5__q_iP0__r_iR11__",), ("other",)], "n string")
    assert [tuple(r) for r in tables.codebook_of_names(names, "n").collect()] == [("5", "P1", "R12")]


def test_folders_arrays_and_alignments(spark, tmp_path):
    for n in ("b_10.txt", "a_9.txt", "c.txt", "d_1.dat"):
        (tmp_path / n).write_text("xx")
    assert [(r.name, r.number, r.bytes) for r in tables.list_files(spark, str(tmp_path), "*.txt").collect()] == [("a_9.txt", 9, 2), ("b_10.txt", 10, 2), ("c.txt", None, 2)]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.int16).reshape(2, 3))
    got = tables.read_arrays(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.place, r.shape, r.value) for r in got] == [(i, [2, 3], float(i)) for i in range(6)]
    hsp = lambda s, n: f"<Hsp><Hsp_score>{s}</Hsp_score><Hsp_align-len>{n}</Hsp_align-len></Hsp>"
    (tmp_path / "b.xml").write_text(f"<BlastOutput><BlastOutput_iterations><Iteration><Iteration_query-def>q1</Iteration_query-def><Iteration_hits><Hit><Hit_def>h</Hit_def><Hit_hsps>{hsp(40, 42)}{hsp(20, 25)}</Hit_hsps></Hit><Hit><Hit_def>g</Hit_def><Hit_hsps>{hsp(18, 9)}</Hit_hsps></Hit></Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>")
    pairs = tables.read_alignments(spark, str(tmp_path / "b.xml"))
    assert sorted((r.hit, r.score, r.length) for r in pairs.collect()) == [("g", 18, 9), ("h", 20, 25), ("h", 40, 42)]
    assert tuple(tables.alignment_counts(pairs).first()) == ("q1", 1, 2)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "AC"), (2, "b", "GT")], "k long, n string, s string")
    files.write_fasta(rows, str(tmp_path / "f"), "n", "s")
    assert sorted((r.name, r.sequence) for r in files.read_fasta(spark, f"file://{tmp_path}/f").collect()) == [("a", "AC"), ("b", "GT")]
    files.combine_fasta(spark, [f"file://{tmp_path}/f", f"file://{tmp_path}/f"], str(tmp_path / "g"))
    assert files.read_fasta(spark, f"file://{tmp_path}/g").count() == 4
    tables.write_report(rows, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    tables.write_shards(rows, str(tmp_path / "s"), "k")
    tables.write_shards(rows.filter("k = 2").withColumnRenamed("s", "s2").selectExpr("k", "n", "'TT' as s"), str(tmp_path / "s"), "k")
    assert sorted((r.k, r.s) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, "AC"), (2, "TT")]


def test_stacks(spark, tmp_path):
    rng = np.random.default_rng(3)
    frames = [rng.integers(0, 65536, (4, 6)).astype(np.uint16) for _ in range(7)]
    images.write_stack(str(tmp_path / "a.dax"), frames)
    back = lambda **o: {r.frame: np.frombuffer(r.pixels, "<u2").reshape(r.height, r.width) for r in images.read_stack(spark, str(tmp_path / "a.dax"), **o).collect()}
    whole = back()
    assert list(whole) == list(range(7)) and all((whole[i] == x).all() for i, x in enumerate(frames))
    part = back(frames="1:6:2", rows="1:4:2", columns="2:5")
    assert list(part) == [1, 3, 5] and all((part[i] == frames[i][1:4:2, 2:5]).all() for i in part)
    assert images.read_stack(spark, str(tmp_path)).count() == 7
    (tmp_path / "b.dax").write_bytes(frames[0].astype(">u2").tobytes())
    (tmp_path / "b.inf").write_text("frame dimensions = 4 x 6\ndata type = 16 bit integers (binary, big endian)\n")
    assert (np.frombuffer(images.read_stack(spark, str(tmp_path / "b.dax")).first().pixels, "<u2").reshape(4, 6) == frames[0]).all()
    assert images.stretched(np.array([[1.0, 3.0]]), 8).tolist() == [[0, 255]]


def test_small_readers(spark, tmp_path):
    (tmp_path / "w.wig").write_text("#c\nchr1 1 5 7\n")
    assert tuple(files.read_intervals(spark, str(tmp_path / "w.wig"), "wig").first()) == ("chr1", 1, 5, 7.0)
    (tmp_path / "r.txt").write_text("Region\tx\nchr1:1,000-2,000\t1\n")
    r = files.read_regions(spark, str(tmp_path / "r.txt")).first()
    assert (r.chr, r.start, r.end, r.mid) == ("chr1", 1000, 2000, 1500)
    (tmp_path / "c.csv").write_text("hyb,750,405\nH0R0,,DAPI\nH1,u1,\n")
    assert files.shows(files.read_color_usage(spark, str(tmp_path / "c.csv")), "dapi").first().hyb == "H0R0"
    numbered = files.numbered(spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "g long, v long"), ["g"], ["v"])
    assert sorted(map(tuple, numbered.collect())) == [(1, 3, 1), (1, 5, 2), (2, 4, 1)]
    assert files.written(numbered).count() == 3


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows.write.parquet(str(tmp_path / "in" / "one"))
    stream = lambda: arrivals.arriving(spark, str(tmp_path / "in" / "*"), "k long, v string")
    arrivals.keep_up(stream(), str(tmp_path / "out"), ["k"], str(tmp_path / "state"), ["v"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    spark.createDataFrame([(2, "c"), (3, "d"), (3, "e"), (3, None)], "k long, v string").repartition(4).write.parquet(str(tmp_path / "in" / "two"))
    arrivals.keep_up(stream(), str(tmp_path / "out"), ["k"], str(tmp_path / "state"), ["v"])
    assert sorted(map(tuple, arrivals.kept(spark, str(tmp_path / "out"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, arrivals.kept(spark, str(tmp_path / "out"), ["k"], False).collect())) == [(1, "a"), (2, "b"), (3, "e")]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # only what is new was written


def test_late_rows_are_not_counted(spark, tmp_path):
    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:10:00"
    schema = "ts string, k string, v long"
    stream = lambda: arrivals.rates(arrivals.arriving(spark, str(tmp_path / "in" / "*"), schema), "ts", ["k"], F.col("v") > 5, "1 hour", "2 hours")
    work = lambda: {(str(r.begin)[8:13], r.k): (r.n, r.rate) for r in arrivals.finish(stream(), str(tmp_path / "out"), str(tmp_path / "state"), ["begin", "k"]).collect()}
    spark.createDataFrame([(at(1, 0), "a", 9), (at(3, 10), "a", 1), (at(3, 10), "a", 7), (at(3, 12), "b", 1)], schema).write.parquet(str(tmp_path / "in" / "one"))
    first = work()
    assert first == {("01 00", "a"): (1, 1.0), ("03 10", "a"): (2, 0.5), ("03 12", "b"): (1, 0.0)}
    spark.createDataFrame([(at(1, 0), "a", 1), (at(3, 11), "a", 9), (at(3, 12), "b", 9), (at(3, 13), "b", 9)], schema).write.parquet(str(tmp_path / "in" / "two"))
    assert work() == {**first, ("03 11", "a"): (1, 1.0), ("03 12", "b"): (2, 0.5), ("03 13", "b"): (1, 1.0)}  # the row two days late is not there
    assert work() == {**first, ("03 11", "a"): (1, 1.0), ("03 12", "b"): (2, 0.5), ("03 13", "b"): (1, 1.0)}


def test_stacks_are_written_by_tasks(spark, tmp_path):
    rng = np.random.default_rng(5)
    stacks = {n: [rng.integers(0, 65536, (5, 7)).astype(np.uint16) for _ in range(k)] for n, k in (("a", 6), ("b", 3), ("c", 1))}
    rows = [(n, i, 5, 7, bytearray(x.astype("<u2").tobytes())) for n, xs in stacks.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "name string, frame long, height int, width int, pixels binary").repartition(4)
    done = images.write_stacks(df, str(tmp_path / "out"))
    assert sorted(map(tuple, done.collect())) == [("a", 6), ("b", 3), ("c", 1)]
    for n, xs in stacks.items():
        back = {r.frame: np.frombuffer(r.pixels, "<u2").reshape(r.height, r.width) for r in images.read_stack(spark, str(tmp_path / "out" / f"{n}.dax")).collect()}
        assert len(back) == len(xs) and all((back[i] == x).all() for i, x in enumerate(xs))
    images.write_stacks(df, str(tmp_path / "eight"), bits=8)
    for n, xs in stacks.items():
        back = images.read_stack(spark, str(tmp_path / "eight" / f"{n}.dax")).orderBy("frame").collect()
        low, high = min(x.min() for x in xs), max(x.max() for x in xs)
        for r, x in zip(back, xs, strict=True):
            assert (np.frombuffer(r.pixels, "<u2").reshape(5, 7) == ((x.astype(float) - low) / (high - low) * 255).astype(np.uint8)).all()
    flat = spark.createDataFrame([("z", 0, 1, 2, bytearray(np.array([7, 7], "<u2").tobytes()))], df.schema)
    images.write_stacks(flat, str(tmp_path / "flat"), bits=16)
    assert np.frombuffer(images.read_stack(spark, str(tmp_path / "flat")).first().pixels, "<u2").tolist() == [0, 0]
    with pytest.raises(Exception, match="one size"):
        images.write_stacks(df.unionByName(df.filter("name = 'a'").limit(1).selectExpr("name", "frame + 9 as frame", "1 as height", "1 as width", "pixels")), str(tmp_path / "bad"))
