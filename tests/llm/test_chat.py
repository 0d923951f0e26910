import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fightlake.llm import chat as C
from fightlake.llm.tokens import default_path

BITS = ["\\", "###", "</turn>", ": ", "### Assistant: ", " </turn>\n", "\n", " ", "é", "日本", "hello there", "", "\\### Assistant: </turn> ok", "...", "####", "x" * 30, "🙂", "a\\"]


def chats(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "assistant", None, "odd: ### role\\"]), rng.choice([None, "".join(rng.choices(BITS, k=rng.randint(0, 9)))])))
    return rows + [rows[0], rows[0], (None, 1, "assistant", "no conversation"), (7, None, "user", "no turn"), (500, 0, "assistant", "word " * 300000), (500, 1, "user", "and " * 300000), (500, 2, "assistant", " again")]


def test_escapes_and_turns_read_back():
    for seed in range(40):
        turns = [(r or "", t or "") for _, _, r, t in chats(seed, 3)[:-5]]
        assert C.parsed(C.rendered(turns)[0]) == turns


def test_mask_pieces_are_the_texts_under_any_offsets():
    tokenizer = Tokenizer.from_file(default_path())
    for seed in range(30):
        turns = [(r or "", t or "") for _, _, r, t in chats(seed, 4)[:-5]]
        text, spans = C.rendered(turns)
        offsets = np.array(tokenizer.encode(text, add_special_tokens=False).offsets).reshape(-1, 2)
        mask, pieces = C.loss_mask(offsets, spans)
        assert [text[a:b] for a, b in pieces] == [text[a:b] for a, b in spans if a < b]
        for (a, b), m in zip(offsets, mask):
            assert m == any(a < y and b > x for x, y in spans)


def test_digests_against_the_rows(spark):
    rows = chats(3)
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int")
    stretches = C.format_chats(turns)
    got = {r.conv_id: r for r in C.digests(stretches).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, (text or "").encode(), text or ""))
    assert set(got) == set(by)
    tokenizer = Tokenizer.from_file(default_path())
    for conv, held in by.items():
        turns_ = [(x[3], x[6]) for x in sorted(held)]
        learnt = "".join(t for r, t in turns_ if r == "assistant")
        whole, _ = C.rendered(turns_)
        r = got[conv]
        assert r.n_turns == len(turns_) and r.formatted_chars == len(whole) and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns_).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.n_tokens == len(tokenizer.encode(whole, add_special_tokens=False).ids)
    assert max(r.part for r in stretches.select("part").collect()) > 0
    assert C.digests(C.format_chats(turns.limit(0))).count() == 0


def test_stretches_of_one_conversation_are_encoded_apart(spark):
    rows = [(1, turn, ("user", "assistant")[turn % 2], f"turn {turn} " * 50) for turn in range(4000)] + [(2, 0, "assistant", "short")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, apart = (C.format_chats(turns, stretch_chars=n) for n in (C.STRETCH * 8, 20_000))
    sizes = [len(r.formatted) for r in apart.select("formatted").collect()]
    assert len(sizes) > 80 and max(sizes) < 22_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be put together
    try:
        assert apart.where("conv_id = 1").groupBy(F.spark_partition_id()).count().count() == 4  # tasks that have some of it
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(C.digests(apart).collect()) == sorted(C.digests(whole).collect())
    joined = [i for r in sorted(apart.where("conv_id = 1").collect(), key=lambda r: r.part) for i in r.ids]
    assert joined == whole.where("conv_id = 1").first().ids
