"""The stored index of a folder of logs."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from fightlake.functions import parse
from fightlake.operators import clock
from fightlake.sources import index, logs


def line(second, who, amount):
    return f"[20:{second // 60:02d}:{second % 60:02d}.000] [@{who}#1|(1,2,3,4)|(5/9)] [Mob {{99}}:12|(0,0,0,0)|(7/100)] [Bite {{81}}] [ApplyEffect {{1}}: Damage {{2}}] ({amount} energy {{3}})"


def put(folder, name, who, n):
    (folder / name).write_bytes("\r\n".join([line(i, who, i) for i in range(n)] + [""]).encode("cp1252"))


def written(store):
    return {p.relative_to(store).as_posix(): p.stat().st_mtime_ns for p in Path(store, "events").rglob("part-*")}


def test_only_changed_logs_are_rewritten_and_slices_read_one_log(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    put(folder, "2024_1.txt", "Ann", 50)
    put(folder, "2024_2.txt", "Ren\xe9", 80)
    (folder / "empty.txt").write_bytes(b"\n" * 30)
    files = {r.name: (r.n_lines, r.error) for r in index.refresh(spark, str(folder), store, 10).collect()}
    assert files == {"2024_1.txt": (50, None), "2024_2.txt": (80, None), "empty.txt": (0, "no line could be read")}
    first = written(store)
    index.refresh(spark, str(folder), store, 10)
    assert written(store) == first  # nothing changed
    put(folder, "2024_2.txt", "Ren\xe9", 90)
    index.refresh(spark, str(folder), store, 10)
    second = written(store)
    same = {k for k in first if k in second and first[k] == second[k]}
    assert same and all("2024_1" in k for k in same) and all("2024_2" in k for k in set(second) - same)
    whole = clock.with_clock(parse.parse_events(logs.read_logs(spark, str(folder), 10)).withColumn("raw_ms", clock.day_ms(F.col("timestamp"))))
    stored = index.read_events(spark, store)
    names = ["log_path", "line_number", "t_ms", "source", "amount"]
    assert sorted(map(tuple, stored.select(names).collect())) == sorted(map(tuple, whole.select(names).collect())) and stored.count() == 140
    some = index.read_slice(spark, store, "2024_2", 20, 24)
    assert [(r.line_number, r.source) for r in some.orderBy("line_number").collect()] == [(i, "Ren\xe9") for i in range(20, 25)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_path" in plan and "PushedFilters: [IsNotNull(line_number), GreaterThanOrEqual(line_number,20)" in plan
    os.remove(folder / "2024_1.txt")
    index.refresh(spark, str(folder), store, 10)
    assert {r.log_path for r in index.read_events(spark, store).select("log_path").distinct().collect()} == {"2024_2"}


def test_a_refresh_that_is_broken_off_is_done_again(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    put(folder, "a.txt", "Ann", 20)
    index.refresh(spark, str(folder), store, 10)
    put(folder, "a.txt", "Ann", 30)
    half = tmp_path / "store" / "files" / f"run-{'9' * 20}"
    half.mkdir()  # a list without its marker
    assert index.read_files(spark, store).first().n_lines == 20
    half.rmdir()
    assert index.refresh(spark, str(folder), store, 10).first().n_lines == 30 and index.read_events(spark, store).count() == 30
