import random
import re

from fightlake.llm.repetition import BASE_WINDOW, NGRAM_PERCENT, keep_good, measure, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(words), "word_chars": len("".join(words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out["line_chars"] = sum(map(len, lines))
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out |= {"n_dup_lines": len(again), "dup_line_chars": sum(map(len, again))}
    for n in NGRAM_PERCENT:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        later, many = set(), set()
        for i, g in enumerate(grams):
            if g in grams[:i]:
                later |= set(range(i, i + n))
            if grams.count(g) > 1:
                many |= set(range(i, i + n))
        out[f"dup{n}_chars"] = sum(len(words[i]) for i in later)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = len(many)
    return out


def test_measures_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 8, 60])
        text = "".join(rng.choice(["a", "bé", "c#", "%", "dd"][:k] + [f"w{i}" for i in range(k)]) + rng.choice(" \n\t   \x85") for _ in range(rng.randint(0, 120)))
        assert measure(text) == brute(text)
    assert measure(None) == measure("") == brute("")


def test_equal_hashes_do_not_count_as_equal_windows():
    import numpy as np

    from fightlake.llm.repetition import _windows

    many, later = _windows(np.array([0, 1, 2, 0, 1, 9]), 2, np.zeros(5, np.uint64), np.arange(5))
    assert many.tolist() == [0, 3] and later.tolist() == [3]


def test_query_and_filter(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean, "x"), (2, "too short", "x"), (3, ("again and again the very same words in a row " * 30), "x"), (4, None, None), (None, clean, "y"), (1, clean, "x"), (6, "line one of it all\n" * 2 + clean, "z"), (7, "one two three four five six seven " * 40000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = quality_rules(docs).collect()
    assert sorted((r.doc_id or -1, r.base_failed, r.kept) for r in got) == [(-1, False, True), (1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, True, False), (6, False, True), (7, True, False)]
    assert sorted(r.kept for r in keep_good(docs).collect()) == ["x", "x", "y", "z"]
    assert quality_rules(docs.limit(0)).count() == 0
