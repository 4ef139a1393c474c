import itertools
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from treeline.__main__ import main
from treeline.functions import random as sequences
from treeline.functions import scalars
from treeline.operators.forest import minimum_spanning_forest
from treeline.plans.shared import shared_dir
from treeline.sources import edges as files
from treeline.sources import run_logs
from treeline.streaming.incremental import latest_forest, maintain_forest

EDGE = "src long, dst long, weight double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_text_formats(spark, tmp_path):
    dimacs, plain, old = tmp_path / "a.gr", tmp_path / "b.txt", tmp_path / "c.txt"
    dimacs.write_text("c hello\n\np sp 4 9\na 1 2 3\na 2 2 1\na 2 4 1.72248e-5\nnonsense\n")
    plain.write_text("#sp 4 3\n1 2\n3 4 -2.5\n")
    old.write_text("4\n1 2 7\n2 1 5\n")
    assert rows(files.read_edges(spark, str(dimacs))) == [(0, 1, 3.0), (1, 3, 1.72248e-5)]
    assert files.parse_header(spark.read.text(str(dimacs))) == (4, 9)
    assert rows(files.read_edges(spark, str(plain), one_based=False)) == [(1, 2, 0.0), (3, 4, -2.5)]
    assert files.parse_header(spark.read.text(str(plain))) == (4, 3)
    assert rows(files.read_edges(spark, str(old), undirected=True)) == [(0, 1, 5.0)]
    assert files.parse_header(spark.read.text(str(old))) == (4, None) and files.parse_header(spark.createDataFrame([("1 2",)], "value string")) is None
    lists = {r.vertex: [tuple(n) for n in r.neighbours] for r in files.read_adjacency(spark, str(plain), undirected=True).collect()}
    assert lists == {0: [(1, 0.0)], 1: [(0, 0.0)], 2: [(3, -2.5)], 3: [(2, -2.5)]}
    assert rows(files.read_text_with_id(spark, str(dimacs)).select("edge_id", "src", "dst")) == [(0, 0, 1), (1, 1, 3)]


def kept_by_hand(lines):
    out = []
    for line in lines:
        if not out or out[-1][1:3] != (line[2], line[1]):
            out.append(line)
    return [line[0] for line in out]


@pytest.mark.parametrize("block", [2, 3, 7, 1 << 20])
def test_mirrored_lines_collapse(spark, block):
    rng = random.Random(block)
    lines = [(0, 1, 2), (1, 2, 1), (2, 1, 2), (3, 4, 5), (4, 5, 6), (5, 6, 5), (6, 6, 5), (8, 5, 6), (9, 5, 6), (30, 6, 5), (31, 7, 7), (32, 7, 7)]
    lines += [(40 + 3 * n, rng.randint(1, 2), rng.randint(1, 3)) for n in range(80)]
    df = spark.createDataFrame(lines, "line long, src long, dst long")
    assert [r[0] for r in rows(files.collapse_mirrored(df, block=block))] == kept_by_hand(lines)


def test_dump_round_trip(spark, tmp_path):
    edges = pd.DataFrame({"src": [0, 4_000_000_000, *range(20)], "dst": [1, 2, *range(20)], "weight": [0.5, 0.1, *range(20)]})
    (tmp_path / "g.dump").write_bytes(files.dump_bytes(edges, 5))
    found = rows(files.read_edges(spark, str(tmp_path / "g.dump")))
    assert (0, 1, 0.5) in found and len(found) == 22 and abs(found[-1][2] - 0.1) < 1e-7
    assert rows(files.read_dump(spark, str(tmp_path / "g.dump"), rows=3)) == found
    with pytest.raises(ValueError):
        files.read_edges(spark, str(tmp_path / "g.dump"), undirected=True)
    files.write_edges(spark.createDataFrame(found, EDGE).repartition(3), str(tmp_path / "parts.dump"))
    assert rows(files.read_edges(spark, str(tmp_path / "parts.dump"))) == found
    (tmp_path / "none.dump").write_bytes(files.dump_bytes(edges[:0], 5))
    assert files.read_dump(spark, str(tmp_path / "none.dump")).count() == 0


def test_text_and_parquet_sinks(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2.5), (3, 4, -1.0)], EDGE)
    files.write_edges(edges, str(tmp_path / "out.gr"))
    files.write_edges(edges, str(tmp_path / "out.parquet"))
    assert rows(files.read_edges(spark, str(tmp_path / "out.gr"))) == rows(files.read_edges(spark, str(tmp_path / "out.parquet"))) == rows(edges)
    assert files.edge_report(edges.withColumn("pos", F.lit(7))).orderBy("value").first()[0] == "Edge 7: (0,1) [2.50]"


def test_run_log(spark):
    lines = [("x nthreads:4 seconds:0.25 batch#3 msf_edges:9 cycles_main:5 cycles_helper:7 cycles_ht#1:4 cycles_ht#0:3 cycles_skipped:6",), ("nthreads:1 seconds:2 batch#1",), ("noise",)]
    found = run_logs.parse_runs(spark.createDataFrame(lines, "value string")).orderBy("nthreads").collect()
    assert found[1].asDict() == {"nthreads": 4, "batch": 3, "msf_edges": 9, "cycles_main": 5, "cycles_helper": 7, "cycles_skipped": 6, "seconds": 0.25, "cycles_by_helper": [3, 4]}
    assert found[0].cycles_main is None and found[0].cycles_by_helper == [] and len(found) == 2


def test_scalars(spark):
    spans = [(3, 5), (11, 11), (20, 24), (90, 93)]
    text = " ".join(",".join(f"{a}-{b}" if a < b else str(a) for a, b in spans[n : n + 2]) for n in (0, 2))
    one = spark.createDataFrame([(text, 1, "dir/x.y.dump", "f,0000000f")], "s string, n long, p string, m string")
    got = one.select(scalars.number_list(F.col("s")), scalars.next_power_of_two(F.col("n")), scalars.stem(F.col("p")), scalars.extension(F.col("p")), scalars.mask_bits(F.col("m"))).first()
    assert got[0] == [n for a, b in spans for n in range(a, b + 1)]
    assert tuple(got[1:]) == (1, "x.y", "dump", 8)
    powers = spark.range(1, 70).select("id", scalars.next_power_of_two(F.col("id"))).collect()
    assert all(p == next(2**k for k in range(10) if 2**k >= n) for n, p in powers)


def test_random_sequences():
    assert len(set(itertools.islice(sequences.shift_register(1), 1000))) == 1000
    # the generator's first number for the words of the paper
    found = list(itertools.islice(sequences.xorshift(), 1000))
    assert found[0] == 3701687786 and len(set(found)) == 1000 and max(found) < 2**32


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("1 2 3\n2 3 1\n1 3 2\n4 5 1\n")
    main(["forest", str(tmp_path / "g.txt"), "--print", "--stats", "2", "--oracle", "--iterations", "2"], spark)
    said = capsys.readouterr().out
    assert said.count("msf_edges:3 weight:4.0") == 2 and "Edge 0: (1,2) [1.00]" in said and "n_msf:3 total_weight:4.0 skipped:1" in said
    main(["profile", str(tmp_path / "g.txt")], spark)
    assert "n_edges:4 n_loops:0" in capsys.readouterr().out
    main(["search", str(tmp_path / "g.txt")], spark)
    assert "vertex:1 level:2 parent:2 path_max:2.0" in capsys.readouterr().out
    main(["convert", str(tmp_path / "g.txt"), str(tmp_path / "g.dump")], spark)
    assert files.read_edges(spark, str(tmp_path / "g.dump")).count() == 4
    assert not [p for p in os.listdir(f"{shared_dir(spark).removeprefix('file:')}/treeline/{spark.sparkContext.applicationId}") if p.startswith("owned")]


def test_runs_as_csv(spark, tmp_path):
    runs = run_logs.parse_runs(spark.createDataFrame([("nthreads:2 seconds:1.5 batch#0 cycles_ht#1:4 cycles_ht#0:3",)], "value string"))
    run_logs.write_runs(runs, str(tmp_path / "runs"))
    assert spark.read.option("header", True).csv(str(tmp_path / "runs")).first().cycles_by_helper == "3 4"


def test_forest_over_a_stream(spark, tmp_path):
    edges = [(0, 1, 3.0), (1, 2, 1.0), (0, 2, 2.0), (3, 4, 1.0), (2, 3, 9.0), (0, 3, 4.0)]
    for n in range(3):
        spark.createDataFrame(edges[2 * n : 2 * n + 2], EDGE).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(EDGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = maintain_forest(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    found = latest_forest(spark, str(tmp_path / "out"))
    assert rows(found) == rows(minimum_spanning_forest(spark.createDataFrame(edges, EDGE)))
