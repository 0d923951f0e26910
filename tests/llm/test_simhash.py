import random

import numpy as np
import xxhash

from fightlake.llm import simhash as S
from fightlake.llm.components import connected_components


def plain_fingerprint(text, size):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_as_by_hand():
    for text in ["", None, "One", "a b c", "The cat\tsat on\x0bTHE mat  again and again", "É é ÀB x y z \x85 w", "a " * 50 + "b"]:
        assert S.fingerprint(S.shingle_hashes(text, 4)) == plain_fingerprint(text, 4)


def test_permutation_and_gray_rank_round_trip():
    x = np.random.default_rng(1).integers(0, 2**64, 500, np.uint64)
    for order, width in S.block_tables(4, 2):
        assert 20 <= width <= 22
        assert (S._unpermute(S._permute(x, order), order) == x).all()
    assert (S.gray_code(S.gray_rank(x)) == x).all()
    codes = S.gray_code(np.arange(1000, dtype=np.uint64))
    assert (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()


def planted(seed, n=1500):
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        v = rng.choice(values[: n // 3])
        for _ in range(rng.randint(1, 7)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    return sorted(set(values))


def brute_links(values, radius):
    v = np.array(values, np.uint64)
    return [(i, i + 1 + int(k)) for i in range(len(v)) for k in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= radius)]


def test_join_finds_the_components_of_all_links(spark):
    for seed, radius, free in ((1, 4, 2), (2, 10, 2), (3, 4, 3)):
        values = planted(seed)
        fps = spark.createDataFrame([(S._signed(v),) for v in values], "fp long")
        number = {S._signed(v): i for i, v in enumerate(values)}
        got = [(number[r.a], number[r.b]) for r in S.hamming_links(fps, radius, free).collect()]
        assert all((values[a] ^ values[b]).bit_count() <= radius for a, b in got)
        assert roots(len(values), got) == roots(len(values), brute_links(values, radius))


def test_dense_shard_gives_a_forest_only():
    rng = random.Random(3)
    base = rng.getrandbits(44)
    values = np.array(sorted({base ^ (1 << rng.randrange(44)) ^ (1 << rng.randrange(44)) for _ in range(3000)}), np.uint64)
    a, b, d = S.shard_links(np.zeros(len(values), np.int64), values, 4)
    assert len(a) == len(values) - 1 and (d <= 4).all()


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 400))) for _ in range(60)]
    for t in texts[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "CHANGED"
        texts.append(" ".join(w))
    texts += ["", None, "\t \n", texts[0].upper(), texts[0], "one", "ONE ", "x" * 200000]
    rows = [(i * 3 + 1, t, i, -1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[0], 0, 0), (None, "nobody else", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id long")
    got = sorted((r.doc_id or 0, S.np.int64(r.fp).view(np.uint64).item(), r.component_id or 0) for r in S.near_duplicates(docs).collect())
    prints = [plain_fingerprint(r[1], 4) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    comp = roots(len(rows), links)
    least = {}
    for r, c in zip(rows, comp):
        least[c] = min(least.get(c, 1 << 60), r[0] or 1 << 60)
    want = sorted((r[0] or 0, p, least[c] % (1 << 60)) for r, p, c in zip(rows, prints, comp))
    assert got == want


def test_keep_one_keeps_one_of_each_group(spark):
    rng = random.Random(6)
    long = [f"t{rng.randrange(5000)}" for _ in range(600)]
    near = long.copy()
    near[300] = "other"
    far = [f"u{rng.randrange(5000)}" for _ in range(600)]
    rows = [(9, " ".join(long), "a"), (4, " ".join(near), "b"), (5, " ".join(far), "c"), (6, " ".join(far).upper(), "d"), (None, " ".join(far), "e"), (7, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.rep for r in kept.collect()) == ["b", "c", "e", "f"]
    assert S.keep_one(docs.limit(0)).count() == 0


def test_keep_one_judges_rows_of_one_doc_id_by_their_texts(spark):
    rng = random.Random(16)
    text = lambda: [f"t{rng.randrange(9000)}" for _ in range(300)]
    a, b, c = text(), text(), text()
    near = lambda words: " ".join(w if i != 150 else "other" for i, w in enumerate(words))
    rows = [(1, " ".join(a), "a"), (7, near(a), "near a"), (7, " ".join(b), "b"), (8, near(b), "near b"), (None, " ".join(c), "c"), (None, " ".join(c), "c again"), (9, near(c), "near c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.th for r in kept.collect()) == ["a", "b", "c", "c again", "near c"]
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(docs, 5, 10, 0.8).collect()}
    assert got == {(1, 1), (7, 1), (7, 7), (8, 7), (None, 9), (9, 9)}  # texts without a doc_id link others, too


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000 + rng.randrange(1, 40), 1000) for _ in range(80)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    for block in (1 << 20, 25):  # solved in one task, and by star steps over several
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), block).collect()}
        check_components(got)


def check_components(got):
    assert all(got[i] == 0 for i in range(1, 61)) and got[2001] == 2000
    assert {v for k, v in got.items() if 1000 < k < 2000} == {1000} and 5 in got and 0 not in got


def test_many_pairs_of_nodes_are_split_and_end():
    rng = np.random.default_rng(4)
    values = np.sort(rng.integers(0, 2**30, 6000, np.uint64))
    a, b, d = S.shard_links(np.repeat(np.arange(3), 2000), values, 3)
    assert sorted(zip(a.tolist(), b.tolist())) and len(a) > 10
    assert roots(6000, list(zip(a.tolist(), b.tolist()))) == roots(6000, [(i + 2000 * k, j + 2000 * k) for k in range(3) for i, j in brute_links(values[2000 * k : 2000 * k + 2000].tolist(), 3)])


def test_number_of_key_blocks_grows_with_the_corpus():
    assert [S.best_free(n, 4) for n in (10**5, 10**8, 10**11)] == sorted(S.best_free(n, 4) for n in (10**5, 10**8, 10**11))


def edited(rng, words, k):
    words = list(words)
    for at in rng.sample(range(len(words)), k):
        words[at] = f"e{rng.randrange(10**9)}"
    return words


def shingle_set(text):
    return set(S.shingle_hashes(text, 5).tolist())


def jaccard(x, y):
    return len(x & y) / len(x | y)


def test_dense_group_of_partly_similar_texts_against_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(3):  # groups whose fingerprints all link, of which some pairs only are similar
        group = [[f"w{rng.randrange(10**6)}" for _ in range(200)]]
        for _ in range(100):
            group.append(edited(rng, rng.choice(group[-40:]), rng.randint(2, 6)))
        texts += [" ".join(w) for w in group]
    rng.shuffle(texts)
    sets = [shingle_set(t) for t in texts]
    prints = [[S.fingerprint(S._mixed(np.array(sorted(x), np.uint64), s)) for x in sets] for s in range(S.PRINTS)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if any((p[i] ^ p[j]).bit_count() <= 10 for p in prints)]
    links = [(i, j) for i, j in near if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(links) < len(near) / 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, 5, 10, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), links)


def test_offers_leave_out_refused_links_and_joined_rows():
    rng = np.random.default_rng(7)
    values = np.sort(rng.integers(0, 2**14, 400, np.uint64))
    n, shard = len(values), np.zeros(400, np.int64)
    every = brute_links(values.tolist(), 3)
    banned = {p for p in every if rng.random() < 0.8}
    joined = [p for p in every if rng.random() < 0.001]
    label = np.array(roots(n, joined))
    for forests in (1, 4):
        a, b, _ = S.shard_links(shard, values, 3, label, np.array(sorted(i * n + j for i, j in banned)), np.arange(n), forests)
        got = list(zip(a.tolist(), b.tolist()))
        assert got and not banned & set(got) and all(label[i] != label[j] for i, j in got)
        assert roots(n, joined + got) == roots(n, joined + [p for p in every if p not in banned])


def test_pairs_just_over_the_similarity_are_found(spark):
    rng = random.Random(13)
    texts, pairs = [], []
    while len(pairs) < 150:
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(edited(rng, words, 6))]
        if 0.8 <= jaccard(shingle_set(texts[-1]), shingle_set(texts[-2])) <= 0.85:
            pairs.append((len(texts) - 2, len(texts) - 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, 5, 10, 0.8).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.92 * len(pairs)


def test_each_pair_is_accepted_in_one_table():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 4, np.uint64)
    prints = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 5), np.uint64), axis=1) for b in base]
    for radius, free in ((10, 2), (6, 3)):
        tables = S.block_tables(radius, free)
        held: dict = {}
        for s, f in enumerate(prints):
            for t, (order, width) in enumerate(tables):
                key = S._permute(f, order) >> np.uint64(64 - width)
                x, y = np.nonzero(np.triu(key[:, None] == key[None, :], 1) & (np.bitwise_count(f[:, None] ^ f[None, :]) <= radius))
                ok = S._acceptance(radius, free, np.full(40, s * len(tables) + t), prints, *[np.full(40, 100)] * 2, 0.8)(x, y)
                for pair in zip(x[ok].tolist(), y[ok].tolist()):
                    held[pair] = held.get(pair, 0) + 1
        apart = [[[(int(f[i]) ^ int(f[j])).bit_count() for f in prints] for j in range(40)] for i in range(40)]
        want = {(i, j) for i in range(40) for j in range(i + 1, 40) if min(apart[i][j]) <= radius and sum(apart[i][j]) <= S.TOGETHER}
        assert set(held) == want and set(held.values()) == {1} and len(want) > 100


def test_pairs_that_are_not_offered_are_not_similar():
    rng = random.Random(21)
    common = list(range(60))
    sets = [set(rng.sample(common, rng.randint(0, 60))) | {1000 * i + j for j in range(rng.randint(0, 12))} for i in range(120)]
    holders: dict = {}
    for x in sets:
        for e in x:
            holders[e] = holders.get(e, 0) + 1
    size, shared = [len(x) for x in sets], [sum(holders[e] > 1 for e in x) for x in sets]
    refused = 0
    for i in range(len(sets)):
        for j in range(i):
            similar = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            may = bool(S.may_be_similar(size[i], shared[i], size[j], shared[j], 0.8))
            assert may or not similar
            refused += not may
    assert refused > 1000


def test_dense_group_of_texts_with_shingles_of_their_own_against_brute_force(spark):
    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 6))) for _ in range(160)] + [" ".join(base[:20] * 3)]
    sets = [shingle_set(t) for t in texts]
    prints = [[S.fingerprint(S._mixed(np.array(sorted(x), np.uint64), s)) for x in sets] for s in range(S.PRINTS)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if any((p[i] ^ p[j]).bit_count() <= 10 for p in prints) and sum((p[i] ^ p[j]).bit_count() for p in prints) <= S.TOGETHER]
    links = [(i, j) for i, j in near if jaccard(sets[i], sets[j]) >= 0.8]
    assert 100 < len(links) < len(near) / 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, 5, 10, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), links)
