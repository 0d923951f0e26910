import random
import re
import zlib
from collections import Counter

import numpy as np

from fightlake.llm import spelling as S
from fightlake.llm.queries import op13_spelling_variants


def brute(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if v != w and is_near(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def texts(rng, n):
    base = ["kettle", "straße", "garden", "gardens", "gärden", "mmmmmm", "lantern", "aabbcc", "journey", "Éclair", "naïveté", "o×o÷oo"]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 40, 250])
        for _ in range(12):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aezÿß") + w[i + 1 :], w[:i] + rng.choice("mnàü") + w[i:]])] * rng.randint(1, 12)
    rng.shuffle(words)
    return [(i, rng.choice([" ", ", ", "1", "\n"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[i::n]), "x") for i in range(n)]


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = texts(rng, 300) + [(None, "kettle kettlex " * 7, "x"), (5000, None, "x"), (5001, "", "x"), (5002, "12 - !", "x"), (1, "kettle " * 400, "x"), (1, "kettle " * 400, "x")]
    rows += [(6000 + i, "q" * 30_000 + " " + "q" * 30_001, "long") for i in range(6)]
    rows += [(7000 + i, f"stepaaa{'b' * k}" + " ", "chain") for k, m in ((0, 6), (1, 40), (2, 300), (3, 2000)) for i in range(m)]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([r for r in rows if r[2] != "long"])
    found = got(op13_spelling_variants(spark, str(tmp_path)))
    assert [r for r in found if len(r[0]) < 1000] == want
    assert sorted(len(r[0]) for r in found if len(r[0]) >= 1000) == [30_000, 30_001] and all(r[4] == 1 for r in found if len(r[0]) >= 1000)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[2] != r[1] for r in want)
    assert S.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_and_rounds_lose_nothing(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.choice([6, 7, 8]))) for _ in range(3000)})
    vocabulary = spark.createDataFrame([(w, rng.randint(5, 99)) for w in words], "word string, n long")
    one = sorted(tuple(r) for r in S.near_pairs(vocabulary).collect())
    many = sorted(tuple(r) for r in S.near_pairs(vocabulary, shard_bytes=1024, round_bytes=3000).collect())
    assert one == many and len(one) == len(set(one)) > 1000 and len(list(S.Filters(Counter(map(len, words)), 1024).rounds(3000))) > 2


def test_edits_as_hashes_are_those_of_the_edited_words():
    for group in (["aabcÿz", "zzzzzz", "bananà"], ["a"]):
        seen = {w: set() for w in group}
        for i, new, rows, hashes in S.edits(S.letters_of(group)):
            for k, (r, h) in enumerate(zip(rows, hashes, strict=True)):
                w = group[r]
                edit = w[:i] + ("" if new is None else chr(new[k])) + w[i + 1 :]
                assert edit not in seen[w]
                seen[w].add(edit)
                assert h == S.word_hashes(S.letters_of([edit]))[0]
        for w, found in seen.items():
            dropped = {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 1 else set()
            greater = {w[:i] + chr(c) + w[i + 1 :] for i in range(len(w)) for c in S.LETTERS if chr(c) > w[i]}
            assert found == dropped | greater


def test_filters_have_all_words_and_few_others():
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(30_000)})
    inside, outside = words[:20_000], words[20_000:]
    filters = S.Filters({9: len(inside)}, 16_384)
    masks = {}
    for s, b, m in zip(*filters.places(9, S.word_hashes(S.letters_of(inside))), strict=True):
        masks[s, b] = masks.get((s, b), 0) | int(m)
    hit = [masks.get((s, b), 0) & int(m) == int(m) for s, b, m in zip(*filters.places(9, S.word_hashes(S.letters_of(inside + outside))), strict=True)]
    assert all(hit[: len(inside)]) and np.mean(hit[len(inside) :]) < 0.01
    assert len({s for s, _ in masks}) == len(filters.shards) == 4
