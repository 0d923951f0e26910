import hashlib
import random
import re
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from fightlake.llm import pii as P


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def plain_permuted(text, key, alphabets):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(1, P.ROUNDS + 1):
        h = digest(key, i, len(left), right)
        new = ""
        for at, c in enumerate(left):
            for a in alphabets:
                if c in a:
                    c = a[(a.index(c) + int(h[2 * (at % 32) : 2 * (at % 32) + 2], 16)) % len(a)]
                    break
            new += c
        left, right = right, new
    return left + right


def luhn(digits):
    double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in P.pseudonymise(docs).collect()}


def test_permutation_as_by_hand_and_one_to_one(spark):
    rng = random.Random(1)
    texts = ["", "7", "ab", "Abé-9.z", "04dbebab91ab85687d33eeaaf9ac699e1188f962"] + ["".join(rng.choices("0123456789", k=7)) for _ in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.permuted(F.col("t"), "k").alias("a"), P.permuted(F.col("t"), "k", P.HEX).alias("b"))
    for r in frame.collect():
        assert r.a == plain_permuted(r.t, "k", P.ALPHABETS) and r.b == plain_permuted(r.t, "k", P.HEX)
    small = spark.range(1000).select(P.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k").alias("x"), P.permuted_number(F.col("id"), (25, 40), "k").alias("y")).collect()
    assert len({r.x for r in small}) == 1000 and {r.y for r in small} == set(range(1000))


def test_each_kind_keeps_its_format_and_validity(spark):
    texts = {
        "n_email": "ask heitlich.60@mail8.example.com, now",
        "n_phone": "call +1 (974) 555-3436 now",
        "n_card": "pay 4539 1488 0343 6467 now",
        "n_iban": "to DE89 3704 0044 0532 0130 00 now",
        "n_ssn": "no 078-05-1120 now",
        "n_ip": "at 97.51.17.173. now",
        "n_date": "on 28/02/1999 now",
        "n_hex": 'token = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962" now',
    }
    got = run(spark, texts.values())
    form = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", t)))
    for i, (name, text) in enumerate(texts.items()):
        new = got[i].text
        assert new != text and getattr(got[i], name) == 1 and sum(getattr(got[i], n) for n in P.COUNTS) == 1
        if name not in ("n_ip", "n_hex"):
            assert form(new) == form(text)
    assert luhn(re.sub(r"\D", "", got[2].text))
    iban = re.sub(" ", "", got[3].text[3:-4])
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert all(0 <= int(o) <= 255 for o in got[5].text[3:-5].split("."))
    day, month, year = map(int, got[6].text[3:13].split("/"))
    assert date(1800, 1, 1) <= date(year, month, day) <= date(2199, 12, 31)
    assert re.fullmatch(r'token = "[0-9A-F]{40}" now', got[7].text)


def test_equal_values_link_and_look_alikes_stay(spark):
    card = "4845168114407329"
    texts = [f"a {card} b", f"{card}, {card}", "born 1999-02-28", "born 28.02.1999", "v 04dbebab91ab85687d33eeaaf9ac699e1188f962", "V 04DBEBAB91AB85687D33EEAAF9AC699E1188F962"]
    stay = ["card 4845168114407328", "on 2023-02-30 and 31/04/2020x", "ip 300.1.1.1 v1.2.3.4.5", "DE88 3704 0044 0532 0130 00", "666-12-1234 000-12-1234", "CC BY-NC 4.0.", "License, Version 2.0", "", "12345", "me @ home", "no digits"]
    got = run(spark, texts + stay + [None])
    new = got[0].text[2:-2]
    assert new != card and got[1].text == f"{new}, {new}" and got[1].n_card == 2
    y, m, d = got[2].text[5:].split("-")
    assert got[3].text == f"born {d}.{m}.{y}"
    assert got[4].text[2:] == got[5].text[2:].lower()
    assert [got[len(texts) + i].text for i in range(len(stay))] == stay
    assert got[len(texts) + len(stay)].text is None
    assert not any(getattr(got[len(texts) + i], n) for i in range(len(stay) + 1) for n in P.COUNTS)


def test_other_columns_long_texts_and_empty_tables(spark):
    long = "97.51.17.173 and words " * 20000
    docs = spark.createDataFrame([(None, long, "r", 5), (1, "x", None, None)], "doc_id long, text string, row string, n_ip long")
    out = P.pseudonymise(docs)
    assert out.columns == ["doc_id", "text", "row", *P.COUNTS]
    big = out.where("doc_id is null").first()
    assert big.n_ip == 20000 and big.row == "r" and "97.51.17.173" not in big.text and big.text.endswith(" and words ")
    assert P.pseudonymise(docs.limit(0)).count() == 0
    plan = P.pseudonymise(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def plain_number(n, sizes, key):
    left, right = divmod(n, sizes[1])
    for i in range(1, P.ROUNDS // 2 + 1):
        left = (left + int(digest(key, i, "l", right)[:12], 16)) % sizes[0]
        right = (right + int(digest(key, i, "r", left)[:12], 16)) % sizes[1]
    return left * sizes[1] + right


def refill(form, chars, old):
    left = iter(chars)
    return "".join(next(left) if c in old else c for c in form)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def plain(kind, m, key=P.TRIAL_KEY):
    """The pseudonym of one value, or None where it isn't valid."""
    digits = re.sub(r"\D", "", m)
    if kind == "email":
        local, _, domain = m.partition("@")
        return f"{plain_permuted(local, f'{key}/email', P.ALPHABETS)}@{domain}"
    if kind == "hex":
        new = "".join(plain_permuted(m.lower()[i : i + 64], f"{key}/hex", P.HEX) for i in range(0, len(m), 64))
        return new if m == m.lower() else new.upper()
    if kind == "card":
        if not luhn(digits):
            return None
        payload = plain_permuted(digits[:-1], f"{key}/card", P.ALPHABETS)
        return refill(m, payload + next(c for c in "0123456789" if luhn(payload + c)), "0123456789")
    if kind == "iban":
        compact = m.replace(" ", "")
        if mod97(compact[4:] + compact[:4]) != 1:
            return None
        rest = plain_permuted(compact[4:], f"{key}/iban", P.ALPHABETS)
        return m[:2] + f"{98 - mod97(rest + m[:2] + '00'):02d}" + refill(m[4:], rest, set(m) - {" "})
    if kind == "ssn":
        a, g, n = map(int, m.split("-"))
        new = plain_number(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, P.SSNS, f"{key}/ssn")
        a = new // (99 * 9999)
        return f"{a + 1 + (a >= 665):03d}-{new // 9999 % 99 + 1:02d}-{new % 9999 + 1:04d}"
    if kind == "ip":
        new = plain_permuted("".join(f"{int(o):02x}" for o in m.split(".")), f"{key}/ip", P.HEX)
        return ".".join(str(int(new[i : i + 2], 16)) for i in (0, 2, 4, 6))
    if kind == "phone":
        code = re.match(rf"(?:{P.COUNTRY}|\+\d{{1,3}})|", m)[0]
        rest = m[len(code) :]
        return code + refill(rest, plain_permuted(re.sub(r"\D", "", rest), f"{key}/phone", P.ALPHABETS), "0123456789")
    for form in ("%Y-%m-%d",) if "-" in m else ("%d.%m.%Y",) if "." in m else ("%d/%m/%Y", "%m/%d/%Y"):
        try:
            n = (datetime.strptime(m, form).date() - date(1800, 1, 1)).days
        except ValueError:
            continue
        if 0 <= n < P.DAYS[0] * P.DAYS[1]:
            return (date(1800, 1, 1) + timedelta(plain_number(n, P.DAYS, f"{key}/date"))).strftime(form)
    return None


def values(rng):
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    payload = d(rng.choice([12, 15, 18]))
    card = payload + rng.choice([d(1), next(c for c in "0123456789" if luhn(payload + c))])
    if len(card) == 16 and rng.random() < 0.5:
        card = rng.choice(" -").join(card[i : i + 4] for i in (0, 4, 8, 12))
    rest = d(rng.choice([14, 18]))
    iban = f"DE{98 - mod97(rest + 'DE00'):02d}{rest}"
    if rng.random() < 0.5:
        iban = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
    y, m, a = rng.randint(1750, 2250), rng.randint(1, 13), rng.randint(1, 31)
    return {
        "card": card,
        "iban": iban,
        "date": rng.choice([f"{y}-{m:02d}-{a:02d}", f"{a:02d}/{m:02d}/{y}", f"{m:02d}/{a:02d}/{y}", f"{a:02d}.{m:02d}.{y}"]),
        "ssn": f"{rng.choice([1, 99, 665, 667, 899])if rng.random() < 0.3 else rng.choice([7, 123, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "phone": rng.choice([f"+44 20 {d(4)} {d(4)}", f"+4420{d(8)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+353 21 {d(3)} {d(4)}"]),
        "email": f"{rng.choice(['Bob', 'bób.x', 'a+9'])}{d(2)}@mail.example.org",
        "hex": rng.choice([str.lower, str.upper])("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64, 65, 200])))),
    }


def test_whole_documents_against_a_plain_version(spark):
    rng = random.Random(5)
    texts, want = [], []
    for _ in range(60):
        text = new = "start "
        for kind, value in sorted(values(rng).items(), key=lambda _: rng.random()):
            text += f"the {kind} {value} , "
            new += f"the {kind} {plain(kind, value) or value} , "
        texts.append(text)
        want.append(new)
    got = run(spark, texts)
    for i, text in enumerate(want):
        assert got[i].text == text
    assert sum(got[i].n_date for i in got) < 60 and sum(got[i].n_card for i in got) < 60


def test_one_number_in_several_notations_stays_linked(spark):
    notations = ["+44 20 7123 4567", "+442071234567", "+44-20-7123-4567"], ["(212) 555-0199", "212-555-0199", "212.555.0199", "+1 212 555 0199", "+1 (212) 555-0199"]
    for same in notations:
        got = run(spark, [f"call {n} now" for n in same])
        assert len({re.sub(r"\D", "", re.sub(r"\+(44|1 )", "", got[i].text)) for i in got}) == 1
        assert all(got[i].n_phone == 1 and got[i].text != f"call {n} now" for i, n in enumerate(same))
        assert all(got[i].text[5:].startswith(n[:3]) for i, n in enumerate(same) if n.startswith("+44"))


def test_long_runs_and_domains_end(spark):
    stay = ["g" * 1_000_000, "1-" * 400_000, "me@" + "w" * 500_000, "Q" * 1_000_000 + "@", "+1" * 300_000, "1.2." * 200_000, "(" * 1_000_000]
    stay += ["x@a" + ".a" * 400_000 + ".com z"]  # no domain has over 126 labels
    texts = ["x@a" + ".a" * 100 + ".com z", *(run * 100_000 for run in ("4", "0a")), *stay]
    got = run(spark, texts)
    assert got[0].n_email == 1 and got[0].text.endswith(".a.com z") and len(got[0].text) == len(texts[0])
    for i in (1, 2):
        assert got[i].n_hex == 1 and got[i].text == plain("hex", texts[i])
    assert [got[3 + i].text for i in range(len(stay))] == stay
