import random

from fightlake.llm import decontam as D


def edit(item, words):
    """(least distance, words to the end of the first best match) by the plain table."""
    row = list(range(len(item) + 1))
    best, end = row[-1], 0
    for at, w in enumerate(words, 1):
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != w)))
        row = new
        if row[-1] < best:
            best, end = row[-1], at
    return best, end


def mutate(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        what = rng.randrange(3)
        if what == 0:
            words[at] = f"z{rng.randrange(9)}"
        elif what == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"z{rng.randrange(9)}")
    return words


def data(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i * 5, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 12, 30, 70, 130])))) for i in range(25)]
    items += [(1000, None), (1001, " ... "), items[3], (None, "Null ID item, of seven words here")]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 250))]
        for _ in range(rng.randint(0, 2)):
            item = D.words_of(rng.choice(items)[1])
            at = rng.randint(0, len(words))
            words[at:at] = mutate(rng, item, rng.randint(0, len(item) // 4)) if item else []
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words), "x"))
    return items, docs + [(900, None, "x"), (901, "", None), docs[0], (None, "a null id item of seven words here", "x"), (902, "pad " * 60000 + (items[5][1] or ""), "y")]


def test_myers_is_the_plain_distance():
    rng = random.Random(1)
    for _ in range(400):
        item = [rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 90]))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 120))]
        assert D.myers(item, words) == edit(item, words)


def test_hits_against_brute_force(spark):
    items, rows = data(2)
    want = []
    for doc_id, text, *_ in rows:
        for item_id, item in items:
            item = D.words_of(item)
            if item:
                distance, end = edit(item, D.words_of(text))
                if distance <= int(len(item) * D.BUDGET):
                    want.append((doc_id, item_id, distance, len(item), end - 1))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (D.BLOCK_CHARS, 500):
        got = D.hits(docs, benchmark, block_chars=chars).collect()
        assert sorted(str((r.doc_id, r.item_id, r.distance, r.n_words, r.last_word)) for r in got) == sorted(map(str, want))
        clean = D.drop_contaminated(docs, benchmark, block_chars=chars)
        assert clean.columns == docs.columns
        held = {t for d, t, *_ in rows if any(w[0] == d for w in want)}
        assert sorted(str(r.text) for r in clean.collect()) == sorted(str(t) for _, t, *_ in rows if t not in held)
    assert D.hits(docs.limit(0), benchmark).count() == 0 == D.hits(docs, benchmark.limit(0)).count()
    assert D.drop_contaminated(docs, benchmark.limit(0)).count() == len(rows)


def test_item_that_repeats_a_piece():
    item = "p q r s a1 a2 a3 a4 b1 b2 b3 b4 c1 c2 c3 c4 p q r s".split()
    for at in ([1, 5, 9, 13], [5, 9, 13, 17]):
        words = [f"z{i}" if i in at else w for i, w in enumerate(item)]
        for before, after in ((0, 0), (30, 30), (30, 0)):
            text = ["x"] * before + words + ["y"] * after
            found = list(D.Matcher([(7, " ".join(item))]).find(" ".join(text)))
            assert [(f[0], f[1], f[4]) for f in found] == [(7, 4, edit(item, text)[1] - 1)]


def test_items_that_repeat_pieces_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        item = [rng.choice("abc") for _ in range(rng.choice([8, 20, 40]))]
        words = [rng.choice("xyz") for _ in range(40)] + mutate(rng, item, rng.randint(0, len(item) // 4)) + [rng.choice("abx") for _ in range(40)]
        distance, end = edit(item, words)
        found = [(f[1], f[4]) for f in D.Matcher([(1, " ".join(item))]).find(" ".join(words))]
        assert found == ([(distance, end - 1)] if distance <= int(len(item) * D.BUDGET) else [])
