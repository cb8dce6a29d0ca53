import gzip
import importlib
import json
import random
import sys

import pytest

from corpusloom.operators import corpus, runs
from corpusloom.sources import storage, tables
from corpusloom.streaming import logs


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"text": "one"}\n\n{"text": ""}\n{"other": 1}\n')
    assert [r.text for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl.gz")).collect()] == ["one"]
    (tmp_path / "lines.txt").write_text("　a \n\n b\n")
    assert [(r.seq, r.text) for r in tables.read_lines(spark, str(tmp_path / "lines.txt")).orderBy("seq").collect()] == [(0, "a"), (1, "b")]
    local = tmp_path / "local"
    local.mkdir()
    (local / "z.tsv").write_text("q\ta\tb\nalone\nx\t \n  y \t z  z\n")
    (local / "b.jsonl").write_text(json.dumps({"user": "u", "assistant": "v"}) + "\n\n" + json.dumps({"user": "second", "assistant": "w"}) + "\n" + json.dumps({"user": "half"}) + "\n")
    (local / "a.tsv").write_text("first\tf\n")
    (local / "other.txt").write_text("no\tpair\n")
    assert [(r.q, r.a) for r in tables.read_local_pairs(spark, str(local)).orderBy("seq").collect()] == [("first", "f"), ("u", "v"), ("second", "w"), ("q", "a b"), ("y", "z z")]
    (tmp_path / "log.csv").write_text("step,elapsed_sec,tokens,lr,train_loss,val_loss,tok_per_sec\n# note\n1,0.1,5,0.1,2.0,,7\n1,0.2,5,0.1,,3.0,\n")
    log = tables.read_run_log(spark, str(tmp_path / "log.csv"))
    assert (log.where("train_loss is not null").count(), log.where("val_loss is not null").count()) == (1, 1)
    assert tables.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert tables.file_digests(spark, str(tmp_path / "lines.txt")).first().bytes == 10
    with pytest.raises(ValueError):
        tables.resolve_sources({"a": None}, "a,b")


def test_line_order_does_not_depend_on_splits(spark, tmp_path):
    rng = random.Random(3)
    lines = {n: [f"{n} line {k} " + "x" * rng.randint(0, 300) for k in range(400)] for n in ("b.txt", "a.txt")}
    for n, own in lines.items():
        (tmp_path / n).write_text("\n\n".join(own) + "\n")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (small, "7000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [r.text for r in tables.read_lines(spark, str(tmp_path / "*.txt")).orderBy("seq").collect()]
            assert got == [x.strip() for n in ("a.txt", "b.txt") for x in lines[n]]
            listed = tables.read_lines(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")])
            assert [r.text for r in corpus.line_stream(listed, 50, 2000).orderBy("seq").collect()] == [x.strip() for x in taken([*lines["b.txt"], *lines["a.txt"]][::50], 2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)


def taken(lines, most):
    out, n = [], 0
    for x in lines:
        if n >= most:
            break
        out.append(x)
        n += len(x.strip())
    return out


def test_messages_have_stable_ids(spark, tmp_path):
    kind = "conversations array<struct<role:string,content:string>>"
    for k in range(3):
        spark.createDataFrame([([("user", f"q{k}{i}"), ("assistant", f"a{k}{i}")],) for i in range(5)] + [(None,)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    rows = tables.read_messages(spark, str(tmp_path / "m"))
    first = sorted(map(tuple, rows.collect()))
    assert len(first) == 30 and len({r[0] for r in first}) == 15
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        assert sorted(map(tuple, tables.read_messages(spark, str(tmp_path / "m")).collect())) == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_logs_are_appended_and_states_replaced(spark, tmp_path):
    path, log = str(tmp_path / "log"), "step int, elapsed_sec double, tokens long, lr double, train_loss double, val_loss double, tok_per_sec double"
    for k in range(3):
        tables.append_log(spark.createDataFrame([(k, 0.5, 10, 0.1, 2.0, None, None)], log), path)
    rows = sorted(map(tuple, tables.read_run_log(spark, path).collect()))
    assert rows == [(k, 0.5, 10, 0.1, 2.0, None, None) for k in range(3)]
    state = str(tmp_path / "state")
    for k in range(2):
        spark.createDataFrame([(k,)], "v int").write.json(f"{state}.new")
        storage.replace(spark, f"{state}.new", state)
        assert spark.read.json(state).first().v == k and not storage.path_exists(spark, f"{state}.old")
    (tmp_path / "state").rename(tmp_path / "state.old")  # as a crash between the renames leaves it
    storage.restore(spark, state)
    assert spark.read.json(state).first().v == 1


def test_spread_deals_small_scans_only(spark, tmp_path):
    from corpusloom.sources.storage import spread

    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(50).repartition(9).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "many"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 50
    joined = one.groupBy("id").count()
    assert spread(joined) is joined
    assert spread(many) is many or many.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism


def test_restarts_only_while_advancing():
    state = {"step": 0, "runs": 0}

    def run(until):
        state["runs"] += 1
        state["step"] = min(state["step"] + 10, until)
        if state["step"] < 30:
            raise OSError

    logs.run_while_advancing(lambda: run(30), lambda: state["step"])
    assert state == {"step": 30, "runs": 3}
    state.update(step=0, runs=0)
    with pytest.raises(OSError):
        logs.run_while_advancing(lambda: run(20), lambda: state["step"])
    assert state == {"step": 20, "runs": 3}


def test_writers_refuse_what_would_not_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a\nb",)], "text string")
    with pytest.raises(Exception, match="line end"):
        tables.write_lines(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="over the limit"):
        tables.write_tokens(spark.createDataFrame([(1, [70_000])], "doc_id long, tokens array<int>"), str(tmp_path / "y"))


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    schema, folder, out = "line long, run string, step long, loss double, updated_at double", tmp_path / "in", str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(folder))
    put([(0, "a", 1, 2.0, 10.0), (1, "a", 2, float("inf"), 20.0)])
    for more in ([], [(2, "a", 3, 1.5, 30.0), (3, "b", 1, 4.0, 31.0)]):
        if more:
            put(more)
        stream = spark.readStream.schema(schema).parquet(str(folder))
        logs.write_heartbeats(stream, out, str(tmp_path / "ck"), None).awaitTermination()
        states = {r.run: (r.step, r.loss) for r in spark.read.schema("run string, step long, loss double, updated_at double").json(out).collect()}
        assert states == ({"a": (3, 1.5), "b": (1, 4.0)} if more else {"a": (2, None)})
    seen = []
    logs.follow(spark, str(folder), schema, str(tmp_path / "ck2"), lambda log, n: seen.append(runs.keep_last_run(log, "run").count())).awaitTermination()
    assert seen == [4]


def test_library_works_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__

    with_it = set(__spark_entry__.queries())
    monkeypatch.setitem(sys.modules, "corpusloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    without = set(importlib.reload(__spark_entry__).queries())
    assert without and without <= with_it and not any(x.startswith("op") for x in without)
    assert set(__spark_entry__.oracle_sql()) <= without


def test_written_lines_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch):
    from corpusloom.functions import ordered
    from corpusloom.plans import queries

    monkeypatch.setattr(ordered, "BYTES_A_RANGE", 1000, raising=False)
    spark.createDataFrame([(k, f"{k:0200d}\n", "s") for k in range(100)], "doc_id long, text string, source string").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    plain = queries.tables.write_lines
    monkeypatch.setattr(queries.tables, "write_lines", lambda rows, path: (plain(rows, path), written.append(path)))
    got = queries.QUERIES["file_lines"](spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(100))
    assert len(spark.read.text(written[0]).inputFiles()) > 15  # 20,100 bytes
    assert ordered.n_ranges(10, spark, 50_000) == 50
