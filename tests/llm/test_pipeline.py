"""The pipeline's stages one after the other on planted documents, against the rules applied by hand."""

import random

import corpus_pipeline
from fightlake.llm import packing, repetition
from fightlake.llm.common import written


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(45)
    shared = "a line that several documents share " + text(4)
    clean = [text(rng.randint(60, 400)) + "\n" + text(30) for _ in range(40)]
    docs = {i: t for i, t in enumerate(clean)}
    near = clean[3].split(" ")
    near[20] = "edited"
    docs |= {100: clean[3], 101: clean[3].upper(), 102: " ".join(near), 103: text(50) + " " + item + " " + text(40)}
    leak = item.split()
    leak[7] = "edited"
    docs |= {104: text(80) + " " + " ".join(leak), 105: "same words again " * 60, 106: "short", 107: None, 108: shared + "\n" + text(80), 109: text(70) + "\n" + shared.upper()}
    return docs, item, shared


def test_every_stage_and_its_decisions(spark, tmp_path):
    docs, item, shared = planted()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = got.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, _ = written(stage(spark, got, str(tmp_path)), name)
        assert got.columns == columns
        kept[name] = {r.doc_id: r.text for r in got.collect()}
    good = {i for i, t in docs.items() if repetition.verdict(repetition.measure(t))[1]}
    assert set(kept["quality_rules"]) == good and {105, 106, 107} & good == set() and set(range(40)) <= good
    lines = kept["line_dedup"]
    assert set(lines) == good and lines[108].startswith(shared) and shared.upper() not in lines[109] and lines[5] == docs[5]
    assert lines[100] == ""  # all its lines are held by a smaller document
    near = set(kept["simhash_near_dedup"])
    assert near == good - {101, 102} and 3 in near
    clean = set(kept["decontamination"])
    assert clean == near - {103, 104}
    assert all(r.n_chars == len(r.text) for r in got.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, got, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == clean
    bound = packing.lower_bound(packing.np.array([r.length for r in packed]), packing.CAPACITY)
    assert bound <= len({r.sequence_id for r in packed}) <= bound + 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, packed))


def test_odd_rows_and_columns_pass_through_every_stage(spark, tmp_path):
    docs, item, shared = planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped string, label long, hash string, fp string"
    row = lambda i, t, tag: (i, t, None, None, None if t is None else len(t), tag, "mine", 7, "h", None)
    rows = [row(i, docs[i], "a") for i in (0, 1, 2)] + [row(None, docs[4], "none"), row(1, docs[1], "again"), row(1, docs[5], "other text"), row(50, None, "null"), row(51, "", "empty")]
    rows += [row(60, shared + "\n" + docs[6], "first"), row(61, shared + "\n" + docs[7], "second"), row(70, docs[8] + " " + item, "leak"), row(80, (docs[9] + " ") * 3 + " ".join(f"w{i}" for i in range(30_000)), "long")]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame(rows, schema)
    got, nothing = table, table.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, _ = written(stage(spark, got, str(tmp_path)), name)
        nothing, _ = written(stage(spark, nothing, str(tmp_path)), name)
        assert got.columns == table.columns and nothing.columns == table.columns and nothing.count() == 0
    left = got.collect()
    assert sorted(r.n_lines for r in left) == ["a", "a", "a", "again", "first", "long", "none", "other text", "second"]
    assert {(r.n_dropped, r.label, r.hash) for r in left} == {("mine", 7, "h")}
    assert {r.n_lines: r.text for r in left}["second"] == docs[7] and {r.n_lines: r.text for r in left}["none"] == docs[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, got, str(tmp_path))
    assert packed.where("piece = 0").count() == len(left) and corpus_pipeline.STAGES[-1][1](spark, nothing, str(tmp_path)).count() == 0
