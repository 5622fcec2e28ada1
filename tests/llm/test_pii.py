import hashlib
import inspect
import random

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from papertrail.llm import pii
from papertrail.llm.pii import replace_private
from papertrail.llm.queries import op10_pii_surrogates
from tests.llm.conftest import ROWS, SF


def replaced(spark, *texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["n_entities"], r["kinds"]) for r in replace_private(df, key=key).orderBy("doc_id").collect()]


# ---- the operator once more, text by text, in plain Python

def compiled(pattern):
    return regex.compile(pattern.replace(r"\k<", "(?P=").replace("(?P=s>", "(?P=s)").replace("(?P=t>", "(?P=t)").replace("(?P=u>", "(?P=u)").replace(r"\d", "[0-9]"))


KINDS = {k: compiled(p) for k, p in {**pii.KINDS, "WORD": pii.WORD}.items()}
PHONE, PERSON, TITLE, NAME = map(compiled, (pii._PHONE, pii.PERSON, f"{pii._TITLE}$", f"{pii._NAME}$"))


def luhn(s):
    digits = [int(c) for c in s][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def checked(s):
    c = "".join(x for x in s if x.isalnum())
    if regex.fullmatch("[2-6][0-9]{12,18}", c) and luhn(c):
        return "CARD", c
    if regex.fullmatch("[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", c) and mod97(c[4:] + c[:4]) == 1:
        return "IBAN", c
    return None


def phones(part):
    out, at = [], 0
    for m in PHONE.finditer(part):
        out += [(None, None, part[at : m.start()]), ("PHONE", regex.sub("[^0-9]", "", m[0]), m[0])]
        at = m.end()
    return [*out, (None, None, part[at:])]


def units(m):
    kind = next((k for k, p in KINDS.items() if p.fullmatch(m)), None)
    if kind in ("CARD", "IBAN", "DIGITS"):
        if checked(m):
            return [(*checked(m), m)]
        groups = regex.findall("[0-9A-Z]+[ -]?", m)
        for i in range(len(groups)):
            for j in range(len(groups), i, -1):
                s = regex.sub("[ -]$", "", "".join(groups[i:j]))
                if len(s) >= 13 and checked(s):
                    at = m.index(s)
                    return [*phones(m[:at]), (*checked(s), s), *phones(m[at + len(s) :])]
        return phones(m)
    if kind == "PERSON":
        words = m.split(" ")
        names = [i for i, w in enumerate(words) if NAME.match(w) and not TITLE.match(w)]
        n = next(i for i, w in enumerate(words) if not TITLE.match(w))
        titles = [w.rstrip(".") for w in words[:n]]
        given = next((g for g, own in (("GIVEN_F", pii.FEMALE), ("GIVEN_M", pii.MALE)) if set(titles) & set(own.split("|"))), "GIVEN_N")
        out = []
        for i, w in enumerate(words):
            out += [(None, None, " ")] * (i > 0)
            out.append((("SURNAME" if i == names[-1] else given), w.lower(), w) if i in names else (None, None, w))
        return out
    return [(kind, m.lower() if kind in ("EMAIL", "IP", "SECRET", "WORD") else regex.sub(r"[^\p{L}\p{N}]", "", m), m)]


def permuted(v, sizes, tweak, key):
    v, half = list(v), len(v) // 2
    for r in [*range(1, pii.ROUNDS + 1), 0, *range(-pii.ROUNDS, 0)]:
        if r == 0:
            v[0] = (v[0] + 1) % sizes[0]
            continue
        mine, source = (range(half), v[half:]) if r % 2 else (range(half, len(v)), v[:half])
        h = hashlib.sha256("\x1f".join([key, tweak, str(abs(r)), ",".join(map(str, source))]).encode()).hexdigest().encode()
        for i in mine:
            draw = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(h, 42))
            draw = draw - (1 << 64) if draw >> 63 else draw
            v[i] = (v[i] + (1 if r > 0 else -1) * (draw % sizes[i])) % sizes[i]
    return v


def enciphered(kind, canon, key):
    def cell(c, free):
        if kind == "IP":
            first, size = (100, 156) if len(c) == 3 else (0, 10) if len(c) == 1 or c[0] == "0" else (10, 90)
            return c, first, size, int(c) - first
        if kind == "SECRET":
            return c, 0, 16, int(c, 16)
        found = next(((a, n) for a, n in pii.RANGES if free and a <= ord(c) < a + n), None)
        return (c, *found, ord(c) - found[0]) if found else (c, 0, 1, 0)

    n = len(canon)
    span = {"EMAIL": (0, canon.rfind(".") - 1), "CARD": (1, n - 2), "IBAN": (4, n - 1), "PHONE": (max(0, n - 10), n - 1)}.get(kind, (0, n - 1))
    cells = [cell(c, span[0] <= i <= span[1]) for i, c in enumerate(canon.split(".") if kind == "IP" else canon)]
    free = [c for c in cells if c[2] > 1]
    tweak = f"{kind} " + " ".join(c[0] if c[2] == 1 else f"{c[1]}+{c[2]}" for c in cells)
    new = iter(permuted([c[3] for c in free], [c[2] for c in free], tweak, key))
    out = []
    for c, first, size, _ in cells:
        x = next(new) if size > 1 else 0
        out.append(c if size == 1 else (f"{first + x:0{len(c)}}" if kind == "IP" else f"{x:x}" if kind == "SECRET" else chr(first + x)))
    s = (".".join if kind == "IP" else "".join)(out)
    if kind == "CARD":
        return next(s[:-1] + d for d in "0123456789" if luhn(s[:-1] + d))
    if kind == "IBAN":
        return next(s[:2] + f"{d:02}" + s[4:] for d in range(2, 99) if mod97(s[4:] + s[:2] + f"{d:02}") == 1)
    return s


def written(kind, surface, s):
    if kind in ("EMAIL", "IP", "SECRET") or kind in pii.ENDINGS:
        return s.upper() if surface.upper() == surface != surface.lower() else s.title() if kind in pii.ENDINGS else s
    own = iter(s)
    return "".join(next(own) if c.isalnum() else c for c in surface)


def slow_name(kind, canon, turn, length, key):
    script = 1 if regex.search(r"\p{IsCyrillic}", canon) else 2 if regex.search(r"\p{IsGreek}", canon) else 0
    h = hashlib.sha256("\x1f".join([key, kind, canon, str(turn)]).encode()).hexdigest()
    return "".join(list(pii.SYLLABLES.values())[script][int(c, 16)] for c in h[:length]) + pii.ENDINGS[kind][script]


def slow_names(names, key):
    kind_of = {n: min((k for k, c in names if c == n[1] and k in ("GIVEN_F", "GIVEN_M")), default="GIVEN_N") if n[0] == "GIVEN_N" else n[0] for n in names}
    left = {n for n in names if kind_of[n] == n[0]}
    length = next(n for n in range(3, 64) if 16**n >= 64 * len(left))
    given, turn = {}, 0
    while left:
        draws = {}
        for k, c in sorted(left):
            draws.setdefault((k, slow_name(k, c, turn, min(length + turn // 2, 60), key)), c)
        for (k, s), c in draws.items():
            if (k, s) not in names and (k, s) not in {(k2, s2) for (k2, _), s2 in given.items()}:
                given[k, c] = s
        left, turn = left - given.keys(), turn + 1
    return {(k, c): given[kind_of[k, c], c] for k, c in names}


def slow_replace(texts, key):
    titled, anyone = regex.compile(pii._TITLED), compiled(pii._ANY)
    anyone_of_persons = compiled(pii._ANY_OF_PERSONS)
    people = [{u[:2] for m in PERSON.finditer(t) for u in units(m[0]) if u[0]} if t and titled.search(t) else set() for t in texts]
    given = slow_names(set().union(*people), key)
    out = []
    for t, own in zip(texts, people):
        if t is None:
            out.append((None, 0, []))
            continue
        any_kind = {}
        for k, c in sorted(own, key=lambda n: (n[0], given[n])):
            if not regex.search(pii._EDGE + c + pii._STOP, t):
                any_kind.setdefault(c, (k, given[k, c]))
        text, at, kinds = "", 0, []
        for m in (anyone_of_persons if titled.search(t) else anyone).finditer(t):
            text += t[at : m.start()]
            for k, canon, surface in units(m[0]):
                s = given.get((k, canon)) if k in pii.ENDINGS else None
                if k == "WORD":
                    k, s = any_kind.get(canon, (None, None))
                if k and k not in pii.ENDINGS:
                    s = enciphered(k, canon, key)
                text += written(k, surface, s) if k else surface
                kinds += [k] if k else []
            at = m.end()
        out.append((text + t[at:], len(kinds), sorted(set(kinds))))
    return out


def made_texts():
    rng = random.Random(10)
    pieces = ["4111 1111 1111 1111 123", "4111111111111111 12/27", "5 4111111111111111", "030 1234 5678 0171 234 5678", "4845-1681-1440-7329", "3782 822463 10005", "9807915762804490", "+1 (377) 555-0271", "+13775550271", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034 USED", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 01", "version 1.2.3.4", "1.2.3.4", "10.200.0.77", "010.07.1.1", "078-05-1120", "a.B-9@mail7.example.com", "Ünï.c0de@bücher.example.org", "почта@пример.рф", "邮件@例子.公司.cn", "4 5 6 7 8 9 1 2 3 4 5 6 7 8", "12.345.678", "2019 2020 2021", "04DBEBAB91AB85687D33EEAAF9AC699E1188F962", "0" * 33]
    people = ["Mr. John Smith", "Dr. Alice Brown", "Mrs. Alice Jones", "Smith", "SMITH's", "Brown", "brown", "Herr Karl SAID", "Г-жа Анна Иванова", "Иванова", "Señora María José García López", "García", "Prof. Dr. A. B. van der Berg-Müller", "Mr. O'Neill", "Sir John F. Kennedy and", "Kennedy", "Mr. Νίκος Παππάς", "Mr. smith", "Dr. No", "Will", "Mr. Will Power will", "MR. SMITH"]
    texts = [" ".join(rng.choice(pieces + people) + rng.choice(["", ",", ".", " x", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    return texts + pieces + people + ["", None]


def test_equals_a_plain_rewrite_of_every_document(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    key = inspect.getsource(op10_pii_surrogates).split('"papertrail.pii.key", "')[1].split('"')[0]
    got = {r["doc_id"]: (r["text"], r["n_entities"], r["kinds"]) for r in op10_pii_surrogates(spark, SF).collect()}
    want = dict(zip(rows, slow_replace(list(rows.values()), key), strict=True))
    assert got == want and sum(n for _, n, _ in want.values()) > 5


def test_equals_a_plain_rewrite_of_made_documents(spark):
    texts = made_texts()
    for a, b in zip(replaced(spark, *texts), slow_replace(texts, "k"), strict=True):
        assert a == b


# ---- what the surrogates must be like

def test_same_entity_same_surrogate_in_every_writing(spark):
    (a, n, kinds), (b, _, _) = replaced(spark, "a.B-9@mail7.example.com, 4845168114407329; +1 (377) 555-0271", "A.b-9@MAIL7.example.com 4845-1681-1440-7329 +13775550271")
    assert n == 3 and kinds == ["CARD", "EMAIL", "PHONE"]
    mail, card, phone = regex.match(r"(\S+@\S+), (\d{16}); (\+1 \(\d{3}\) \d{3}-\d{4})$", a).groups()
    assert mail.endswith(".com") and "mail7" not in mail and luhn(card) and card[0] == "4" and card != "4845168114407329"
    assert b == f"{mail} {'-'.join(card[i : i + 4] for i in range(0, 16, 4))} {regex.sub(r'[^+0-9]', '', phone)}"


def test_a_crowded_format_never_runs_out(spark):
    """Every one of the 10,000 addresses of a format has a surrogate of its own, and none keeps its value."""
    ips = [f"{i // 1000}.{i // 100 % 10}.{i // 10 % 10}.{i % 10}" for i in range(10_000)]
    one, again, other = (replaced(spark, *ips, key=k) for k in ("k", "k", "other"))
    new = [t for t, _, _ in one]
    assert one == again and one != other and sorted(new) == sorted(ips) and not any(a == b for a, b in zip(ips, new, strict=True))


@pytest.mark.parametrize("sizes", [[7], [3, 4], [10, 2, 5], [2, 2, 2, 2]])
def test_permutation(spark, sizes):
    from itertools import product

    from pyspark.sql import functions as F

    every = [list(v) for v in product(*map(range, sizes))]
    df = spark.createDataFrame([(v,) for v in every], "v array<int>")
    got = [r["p"] for r in df.select(pii.permuted(F.col("v"), F.lit(sizes), F.lit("t"), "key").alias("p")).collect()]
    assert sorted(got) == every and all(a != b for a, b in zip(every, got, strict=True))


def test_checksums_hold(spark):
    (t, n, kinds), (u, _, _) = replaced(spark, "DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32", "DE89370400440532013000")
    a, b = regex.findall(r"[A-Z]{2}\d\d(?: [0-9A-Z]{4})+ \d\d", t)
    for s, country in ((a, "DE"), (b, "GB")):
        s = s.replace(" ", "")
        assert s[:2] == country and mod97(s[4:] + s[:4]) == 1
    assert n == 2 and kinds == ["IBAN"] and u == a.replace(" ", "") and b[5:9].isalpha()


def test_neighbours_of_cards_and_phones(spark):
    texts = ["4111 1111 1111 1111 123", "4111111111111111 12/27", "5 4111111111111111", "030 1234 5678 0171 234 5678"]
    got = replaced(spark, *texts)
    assert [(n, k) for _, n, k in got] == [(1, ["CARD"])] * 3 + [(2, ["PHONE"])]
    card = got[1][0].split(" ")[0]
    assert luhn(card) and got[0][0] == " ".join(card[i : i + 4] for i in range(0, 16, 4)) + " 123" and got[2][0] == f"5 {card}" and got[1][0].endswith(" 12/27")


def test_names(spark):
    (t, n, kinds), = replaced(spark, "Mrs. Anna Schmidt met Mr. Schmidt; Г-жа Анна Иванова. Herr Karl SAID")
    m = regex.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+); Г-жа ([а-яА-Я]+) ([а-яА-Я]+)\. Herr (\w+) SAID$", t)
    assert m and m[2] == m[3] and m[1].endswith("na") and m[4].endswith("на") and m[2].istitle() and n == 6
    assert kinds == ["GIVEN_F", "SURNAME"]


def test_later_mentions(spark):
    (t, n, _), (u, _, _) = replaced(spark, "Mr. John Smith met Dr. Alice Brown. Smith left; later John Smith called. Contact Jane Doe.", "Mrs. Alice Will has a brown will. Will and Brown: Brown")
    m = regex.match(r"Mr\. (\w+) (\w+) met Dr\. (\w+) (\w+)\. (\w+) left; later (\w+) (\w+) called\. Contact Jane Doe\.$", t)
    assert m and m[2] == m[5] == m[7] and m[1] == m[6] and n == 7 and not {"John", "Smith", "Alice", "Brown"} & set(m.groups())
    alice, will = regex.match(r"Mrs\. (\w+) (\w+) has a brown will\. Will and Brown: Brown$", u).groups()
    assert alice == m[3] and alice.endswith("na") and will != "Will"
    (t, n, _), = replaced(spark, "Señora María José García López dijo que López")
    assert n == 5 and not regex.search("María|José|García|López", t)


def test_distinct_names_stay_distinct(spark):
    letters = "abcdefghij"
    names = [f"X{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in "ab"]
    got = [t for t, _, _ in replaced(spark, *(f"Mr. {n}" for n in names))]
    assert len(set(got)) == len(names) and not set(got) & {f"Mr. {n}" for n in names}


def test_what_is_none(spark):
    texts = ["9807915762804490", "4845168114407328", "1.2.3.4.5", "999.1.1.1", "v1.2.3.4", "version 1.2.3.4", "call 12345", "token x", "a@b", "Mr. smith", "12345678901234567890", "DE89370400440532013001", "12.345.678", "2019 2020 2021"]
    assert [(t, n) for t, n, _ in replaced(spark, *texts)] == [(t, 0) for t in texts]


def test_secrets_keep_their_case(spark):
    (t, n, kinds), = replaced(spark, 'token = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962" 04dbebab91ab85687d33eeaaf9ac699e1188f962')
    a, b = regex.findall(r"[0-9A-Fa-f]{40}", t)
    assert a.lower() == b and a == a.upper() and n == 2 and kinds == ["SECRET"]


def test_odd_tables(spark, odd, none):
    got = sorted((str(r["doc_id"]), r["text"] or "", r["n_entities"]) for r in replace_private(odd, key="k").collect())
    assert got == sorted((str(r[0]), r[1] or "", 0) for r in ROWS)
    assert replace_private(none, key="k").count() == 0
    with pytest.raises(ValueError):
        replace_private(odd, key="")
    clash = spark.createDataFrame([("1", "Mr. Smith a@b.de", 1, 2, 3)], "doc_id string, text string, row int, _m int, kinds int")
    assert replace_private(clash, key="k").first()["n_entities"] == 2


def test_no_python_workers(docs):
    plan = replace_private(docs, key="k")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


MEGABYTE = 1 << 20
REPEATS = ["x@{}com|a.", "x@{}|a-", "Mr. {}|Aa ", "Mr. {}|A. ", "Mr. Smith {}|A. ", "{}Smith|Mr ", "Mr. {}|van ", "Mr. {}|Aa-Bb ", "Mr. {}|AaBb", "{}|1 ", "{}|12-", "{}|DE44 5001 ", "{}|ab1", "{}|A1B2 ", "+49{}| 30", "{}|1.2.", "Mr. Aa {}|AA-"]


def test_no_text_is_too_long(spark):
    """A megabyte of each pattern's own repeats, in one text and in one job."""
    texts = []
    for row in REPEATS:
        frame, part = row.split("|")
        texts.append(frame.replace("{}", part * (MEGABYTE // len(part))))
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in replace_private(df, key="k").select("doc_id", F.length("text").alias("n"), "kinds").collect()}
    assert len(got) == len(texts)
    assert got[0]["kinds"] == ["EMAIL"] and got[0]["n"] == len(texts[0])
    assert set(got[2]["kinds"]) == {"GIVEN_M", "SURNAME"}


def test_a_name_in_an_address_is_no_common_word(spark):
    text = "Dr. Alice Brown wrote to alice.brown@x.org. BROWN agreed."
    other = "Dr. Alice Brown wears a brown coat. BROWN agreed."
    rows = replace_private(spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string"), key="k").orderBy("doc_id").collect()
    assert "BROWN" not in rows[0]["text"] and "Brown" not in rows[0]["text"] and "brown" not in rows[0]["text"]
    assert "BROWN" in rows[1]["text"] and "brown coat" in rows[1]["text"] and "Brown" not in rows[1]["text"]
    assert rows[0]["text"].split()[2].upper() == rows[0]["text"].split()[6]  # the mention has the person's surrogate
