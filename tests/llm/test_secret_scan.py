import hashlib
import random
import re
from functools import lru_cache
from math import log2

import pytest

from fightlake.llm import secret_scan as S
from fightlake.llm.queries import op11_secret_scan

WORDS = {"pass": 1.0, "word": 3.0, "password": 2.0, "sun": 4.0, "les": 5.0}


@pytest.fixture(scope="module")
def guesser():
    return S.Guesser(S.lexicon())


def span_costs(v, repeats=True):
    """Every (start, end, bits) that a span of ``v`` may have, each worked out from the definitions."""
    n = len(v)
    for a in range(n):
        for b in range(a + 1, n + 1):
            part = v[a:b]
            yield a, b, sum(map(S.char_bits, part))
            for one in "il":
                plain = part.lower()
                form = "".join(dict(S.LEET, **{"1": one}).get(c, c) for c in plain)
                for f in (plain, form):
                    if f in WORDS:
                        changed = len({c for c, d in zip(plain, f, strict=True) if c != d})
                        yield a, b, WORDS[f] + S.case_bits(part) + (1 + changed if changed else 0)
            for pattern, bits in S._DATES:
                if (m := pattern.match(v, a)) and m.end() == b:
                    yield a, b, bits
            steps = [S.NEIGHBOURS.get(x, {}).get(y) for x, y in zip(part, part[1:], strict=False)]
            if len(part) >= 3 and None not in steps:
                yield a, b, S._START + S._TURN + sum(S._STRAIGHT if s == t else S._TURN for s, t in zip(steps, steps[1:], strict=False))
            for size in range(1, len(part) // 2 + 1) if repeats else ():
                unit, times = part[:size], len(part) // size
                if unit * times == part and v[b : b + size] != unit and (times > 2 or size > 1):
                    yield a, b, plain_bits(unit, False) + log2(times)


def plain_bits(v, repeats=True):
    costs = list(span_costs(v, repeats))

    @lru_cache(None)
    def best(at):
        return 0.0 if at == len(v) else min((bits + S.SEGMENT + best(b) for a, b, bits in costs if a == at), default=float("inf"))

    return best(0)


def test_guess_bits_against_all_segmentations():
    rng = random.Random(3)
    guesser = S.Guesser(WORDS)
    parts = ["pass", "P4ss", "word", "Sun", "1es", "1999", "20240131", "1/2/2001", "qwe", "rfv", "1qaz", "asdf", "aaa", "abab", "x", "Q", "7", "#", "é", "password"]
    for _ in range(250):
        v = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))[:18]
        want = plain_bits(v)
        assert guesser.bits(v) == pytest.approx(want), v
        for stop in (10.0, 25.0):
            assert (guesser.bits(v, stop) >= stop) == (want >= stop - 1e-9), v


def test_cheap_and_dear_values(guesser):
    for v in ["password", "Passw0rd!", "qwertyuiop", "1qaz2wsx", "aaaaaaaaaaaaaaaaaaaaaaa", "20240131", "changeme", "abcabcabcabcabc", "hunter2"]:
        assert guesser.bits(v) < S.STRONG, v
    for v in ["xK9$mQ2!vL7p", "tr0ub4dor&3zq", "q7Zr-81mW_0aXd"]:
        assert guesser.bits(v) >= S.STRONG, v
    assert guesser.bits("") == 0
    assert guesser.bits("Zr8#qq!Wm2x" * 40000, S.STRONG) >= S.STRONG


def base_spans(text):
    """The fixed shapes, a character at a time."""
    out = []
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    i = 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(word, i):
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "="):
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                    k = j
                    while k < len(text) and re.match(r"[A-Za-z0-9+/_.=-]", text[k]):
                        k += 1
                    if k > j:
                        end = k
                        if k - j >= 8:
                            out.append(("assign", i, k))
                break
        i = end or i + 1
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def texts():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abcd", "Zz9+/_.=-", "AKIA", "AKIAABCD1234XY", "0f" * 17, "é", "\n", "x", "is "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]


def test_base_spans_against_a_plain_scan(guesser):
    for text in texts():
        got = S.spans_of(text, guesser)
        assert [s for s in got if s[0] != "guess"] == base_spans(text), text
        assert got == sorted(got, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_contexts(guesser):
    def guessed(text):
        return [text[a:b] for k, a, b in S.spans_of(text, guesser) if k == "guess"]

    assert guessed('pwd: "xK9$mQ2!vL7p".') == ["xK9$mQ2!vL7p"]
    assert guessed("The passphrase is vQ8!zz#Lp0w, keep it.") == ["vQ8!zz#Lp0w"]
    assert guessed("postgres://bob:Zr8#qq!Wm2x@host/db") == ["Zr8#qq!Wm2x"]
    assert guessed("Authorization: Bearer x9.Q2v-77Lm_wq8Z") == ["x9.Q2v-77Lm_wq8Z"]
    assert guessed("login: changeme pwd=qwerty123 key=abc passphrase = $VAULT_PASSPHRASE auth: get_auth(user)") == []
    assert guessed("nothing here xK9$mQ2!vL7p") == []
    assert guessed("password=xK9mQ2vL7p") == []  # the shape has it already


def test_query_and_defined_cases(spark, tmp_path, guesser):
    rows = [(1, "token = 'abcdefgh12'", "a"), (1, "token = 'abcdefgh12'", "a"), (2, None, "b"), (3, "", "b"), (None, "pwd: xK9$mQ2!vL7p", "c"), (4, "x " * 300000 + "AKIAABCDEFGH1234", "d")]
    rows += [(10 + i, t, "t") for i, t in enumerate(texts()[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def line(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    want = []
    for d, t, _ in rows:
        base = base_spans(t or "")
        n = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        want.append((d, *n, hashlib.sha256(line(base).encode()).hexdigest(), line(S.spans_of(t, guesser))))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in got), key=key) == sorted(want, key=key)
    masked = {r.doc_id: r.text for r in S.redact(docs).collect()}
    assert masked[1] == "[assign]'" and masked[2] is None and masked[3] == "" and masked[None] == "pwd: [guess]" and masked[4].endswith("x [access]")
    assert S.redact(docs).columns == docs.columns and S.find_secrets(docs.limit(0)).count() == 0
