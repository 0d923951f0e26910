import random

from fightlake.llm.line_dedup import BLANK, LineIndex, dedup_lines, key_rows


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    first = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if d is not None:
                first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, t, *rest in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, None if t is None else "\n".join(kept), *rest, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"a line of some length {i}" for i in range(40)] + ["short", "", "  ", "\t ten chars \x0b", "TEN CHARS ", "É" * 10, "é" * 10, "x" * 50000]
    rows = [(rng.randrange(1000), "\n".join(rng.choice(pool).replace("a", rng.choice("aA")) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(1, 30))), "s", 7) for _ in range(60)]
    rows += [rows[0], (5, None, "s", 1), (6, "", None, 2), (None, pool[0], "s", 3), (-4, pool[0] + "\n" + pool[0], "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __drop string, pos long")
    for batches, fanout in ((1, 2), (3, 2), (5, 3)):
        assert sorted((tuple(r) for r in dedup_lines(docs, batches, fanout).collect()), key=str) == brute(rows)


def test_runs_are_compacted_and_disjoint(spark):
    index = LineIndex(spark, 2)
    for b in range(5):
        docs = spark.createDataFrame([(b * 10 + i, f"shared line number {i % 3}\nown line of doc {b * 10 + i}") for i in range(4)], "doc_id long, text string")
        index.add(key_rows(docs))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    runs = index.runs().collect()
    assert len(runs) == 23 == len({(r.h1, r.h2) for r in runs}) and sorted(r.first_doc for r in runs)[:4] == [0, 0, 1, 1]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
