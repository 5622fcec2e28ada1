"""Personal data replaced by surrogates, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import stored

# How each kind of entity is written.
_EDGE, _STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}.-])", r"(?![\p{L}\p{N}]|[.-]\d)"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_VERSION = r"(?<![Vv]ersion )(?<![Rr]elease )(?<![Bb]uild )(?<![Vv]er\. )"
_THOUSANDS, _YEARS = r"(?!\d{2,3}([ .])\d{3}\1\d{3}(?!\d|[ .-]\d))", r"(?!(?:1[89]|20)\d\d[ .-](?:1[89]|20)\d\d[ .-])"
_PHONE = rf"{_BEFORE}(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]\d{{3,4}}{_AFTER}|{_BEFORE}\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,4}}{_AFTER}"
#: In order of preference; the first that matches at a place wins. Each may be tried on a match alone.
NUMBERS = {
    "SECRET": rf"{_EDGE}(?=[A-Fa-f]*\d)[0-9A-Fa-f]{{32,128}}{_STOP}",
    "IBAN": rf"{_EDGE}[A-Z]{{2}}\d{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?{_STOP}",
    "CARD": rf"{_BEFORE}(?:\d{{13,19}}|\d{{4}}(?<s>[ -])\d{{4}}\k<s>\d{{4}}\k<s>\d{{1,4}}(?:\k<s>\d{{1,3}})?|\d{{4}}(?<t>[ -])\d{{6}}\k<t>\d{{4,5}}){_AFTER}",
    "IP": rf"{_BEFORE}{_VERSION}{_OCTET}(?:\.{_OCTET}){{3}}{_AFTER}",
    "SSN": rf"{_BEFORE}\d{{3}}-\d{{2}}-\d{{4}}{_AFTER}",
    "PHONE": rf"{_THOUSANDS.replace('([ .])', '(?<u>[ .])').replace(chr(92) + '1', chr(92) + 'k<u>')}{_YEARS}(?:{_PHONE})",
    "DIGITS": rf"{_BEFORE}\d(?:[ -]?\d){{12,18}}{_AFTER}",
}
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*+@{_LABEL}(?:\.{_LABEL})++"
FEMALE = "Mrs|Ms|Miss|Madam|Lady|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Signora|Signorina|Г-жа|Госпожа"
MALE = "Mr|Sir|Lord|Herrn|Herr|Monsieur|Señor|Sr|Don|Signor|Г-н|Господин"
EITHER = "Dr|Prof|Doctor|Doktor|Professor|Доктор|Профессор"
_TITLE = rf"(?:{FEMALE}|{MALE}|{EITHER})\.?"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)*+(?:-\p{Lu}\p{Ll}++)*+(?![\p{L}\p{N}])"
_INITIAL = r"\p{Lu}\."
_PARTICLE = "van|von|de|del|della|di|da|la|le|der|den|el|bin|al|dos|du|ter|zu|y"
#: Repeats of unknown number are possessive, since others take a step of the stack each: no text may be too long. Of a run of
#: titles the last eight count.
PERSON = rf"{_EDGE}(?=[A-ZГПД])(?:{_TITLE} ){{1,8}}(?:{_INITIAL} )*+(?:(?:{_PARTICLE}) ){{0,3}}{_NAME}(?: (?:(?:(?:{_PARTICLE}) ){{0,3}}{_NAME}|{_INITIAL}))*+"
#: Words that may be a further mention of a person.
WORD = rf"{_EDGE}(?=\p{{Lu}})(?:{_NAME}|\p{{Lu}}{{2,}}+(?:-\p{{Lu}}++)*+{_STOP})"
KINDS = {"EMAIL": EMAIL, **NUMBERS, "PERSON": PERSON}
_ANY = "|".join(f"(?:{p})" for p in ("EMAIL", *NUMBERS) for p in [KINDS[p]])
_ANY_OF_PERSONS = "|".join(f"(?:{p})" for p in (_ANY, PERSON, WORD))
#: Texts without any of these hold no entity; telling so costs little.
_POSSIBLE, _TITLED = "[@0-9]", rf"(?=[A-ZГПД]){_EDGE}{_TITLE} \p{{Lu}}"
#: Given names end alike for each gender; all names are built from these syllables, in the script of the original.
SYLLABLES = {
    "Latin": "ba de fi go ka le mi no pe ra se ti vo wa ju ho".split(),
    "Cyrillic": "ба де фи го ка ле ми но пе ра се ти во ла ху зо".split(),
    "Greek": "βα δε φι γο κα λε μι νο πε ρα σε τι βο λα ζου θο".split(),
}
ENDINGS = {"GIVEN_F": ("na", "на", "να"), "GIVEN_M": ("rin", "рин", "ριν"), "GIVEN_N": ("len", "лен", "λεν"), "SURNAME": ("ler", "лер", "λερ")}
#: Letters and digits by code point: the first of a range and how many it has. A character is replaced within its range.
RANGES = [(48, 10), (97, 26), (65, 26), (0xE0, 23), (0xF8, 8), (0x100, 128), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x621, 26), (0x904, 54), (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172)]
#: Rounds of the cipher in each direction.
ROUNDS = 8



def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, wherever f uses it."""
    return F.transform(F.array(value), f)[0]


def _unit(kind: Column | str | None, canon: Column, surface: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind).cast("string")
    return F.struct(kind.alias("kind"), canon.alias("canon"), surface.alias("surface"))


def _as_is(surface: Column) -> Column:
    return _unit(None, F.lit(None).cast("string"), surface)


def _luhn_sum(digits: Column) -> Column:
    own = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _bound(c.cast("int"), lambda n: F.when(i % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)))
    return F.aggregate(own, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits satisfies the card numbers' checksum."""
    return _luhn_sum(digits) % 10 == 0


def mod97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and capital letters, a letter being two digits from A = 10."""
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(s, ""), digit), F.lit(0), lambda a, n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97)


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def _is_card(canon: Column) -> Column:
    return canon.rlike(r"^[2-6]\d{12,18}$") & luhn(canon)


def _is_iban(canon: Column) -> Column:
    return canon.rlike(r"^[A-Z]{2}\d{2}[0-9A-Z]{11,30}$") & (mod97(F.concat(F.substring(canon, 5, 30), F.substring(canon, 1, 4))) == 1)


def _checked(m: Column) -> Column:
    """Units of a match that needs a checksum: itself if it has it, else the first and longest run of its groups that has
    it, and telephone numbers in what is left."""
    one = lambda s: _bound(_plain(s), lambda c: F.when(_is_card(c), _unit("CARD", c, s)).when(_is_iban(c), _unit("IBAN", c, s)))

    def phones(part: Column) -> Column:
        pairs = F.zip_with(F.split(part, _PHONE, -1), F.regexp_extract_all(part, F.lit(_PHONE), F.lit(0)), lambda b, p: F.when(p.isNull(), F.array(_as_is(b))).otherwise(F.array(_as_is(b), _unit("PHONE", _plain(p), p))))
        return F.flatten(pairs)

    def inner(groups: Column) -> Column:
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.transform(F.sequence(F.size(groups) - i + 1, F.lit(1)), lambda n: F.regexp_replace(F.array_join(F.slice(groups, i, n), ""), "[ -]$", ""))))
        return F.get(F.filter(F.transform(F.filter(runs, lambda r: F.length(r) >= 13), one), lambda u: u.isNotNull()), F.lit(0))

    def around(u: Column) -> Column:
        at = F.position(u["surface"], m)
        return F.when(u.isNull(), phones(m)).otherwise(F.concat(phones(F.substring(m, F.lit(1), at - 1)), F.array(u), phones(F.substring(m, at + F.length(u["surface"]), F.length(m)))))

    groups = F.regexp_extract_all(m, F.lit("[0-9A-Z]+[ -]?"), F.lit(0))
    return _bound(one(m), lambda u: F.when(u.isNotNull(), F.array(u)).otherwise(_bound(_bound(groups, inner), around)))


def _person(m: Column) -> Column:
    """Units of a titled person: a name for each word that is one, the last being the surname; all else as it is."""
    words = F.split(m, " ")
    is_name = lambda w: w.rlike(rf"^{_NAME}$") & ~w.rlike(rf"^{_TITLE}$")
    titled = lambda which: m.rlike(rf"^(?:{_TITLE} ){{0,8}}(?:{which})\.? ")
    given = F.when(titled(FEMALE), F.lit("GIVEN_F")).when(titled(MALE), F.lit("GIVEN_M")).otherwise(F.lit("GIVEN_N"))
    named = F.transform(words, is_name)

    def units(p: Column) -> Column:
        own = lambda w, i: F.when(~p["named"][i], _as_is(w)).otherwise(_unit(F.when(i < p["surname"], p["given"]).otherwise(F.lit("SURNAME")), F.lower(w), w))
        return F.flatten(F.transform(words, lambda w, i: F.when(i == 0, F.array(own(w, i))).otherwise(F.array(_as_is(F.lit(" ")), own(w, i)))))

    surname = lambda n: F.size(n) - F.array_position(F.reverse(n), F.lit(True)).cast("int")  # noqa: E731  the last name's place
    return _bound(_bound(named, lambda n: F.struct(n.alias("named"), surname(n).alias("surname"), given.alias("given"))), units)


def _units(m: Column, persons: bool) -> Column:
    """What a match falls into: units (kind, canon, surface), kind being null for what stays as it is."""
    kind: Column | None = None
    for name, pattern in {**KINDS, "WORD": WORD}.items():
        if persons or name not in ("PERSON", "WORD"):
            here = m.rlike(rf"^(?:{pattern})$")
            kind = F.when(here, F.lit(name)) if kind is None else kind.when(here, F.lit(name))
    simple = lambda k: _unit(k, F.when(k.isin("EMAIL", "IP", "SECRET", "WORD"), F.lower(m)).otherwise(_plain(m)), m)
    parts = lambda k: F.when(k.isin("CARD", "IBAN", "DIGITS"), _checked(m)).when(k.isNull(), F.array(_as_is(m)))
    return _bound(kind, lambda k: (parts(k).when(k == "PERSON", _person(m)) if persons else parts(k)).otherwise(F.array(simple(k))))


def _cells(kind: Column, canon: Column) -> Column:
    """An entity's places, each with what it holds and the range (first, size) it may hold; size 1 stays as it is."""
    cell = lambda text, first, size, value: F.struct(text.alias("text"), first.cast("int").alias("first"), size.cast("int").alias("size"), value.cast("int").alias("value"))
    fixed = lambda c: cell(c, F.lit(0), F.lit(1), F.lit(0))

    def by_range(c: Column) -> Column:
        return _bound(F.ascii(c), lambda cp: F.coalesce(*(F.when(cp.between(a, a + n - 1), cell(c, F.lit(a), F.lit(n), cp - a)) for a, n in RANGES), fixed(c)))

    def octet(c: Column) -> Column:
        first = F.when(F.length(c) == 3, 100).when((F.length(c) == 2) & ~c.startswith("0"), 10).otherwise(0)
        size = F.when(F.length(c) == 3, 156).when(F.length(c) == 1, 10).when(c.startswith("0"), 10).otherwise(90)
        return cell(c, first, size, c.cast("int") - first)

    chars = F.split(canon, "")
    last = F.length(canon) - 1
    top = F.length(canon) - F.instr(F.reverse(canon), ".")  # of e-mails: where the last dot is
    open_ = (
        F.when(kind == "EMAIL", F.struct(F.lit(0).alias("a"), (top - 1).alias("b")))
        .when(kind == "CARD", F.struct(F.lit(1).alias("a"), (last - 1).alias("b")))
        .when(kind == "IBAN", F.struct(F.lit(4).alias("a"), last.alias("b")))
        .when(kind == "PHONE", F.struct(F.greatest(F.lit(0), last - 9).alias("a"), last.alias("b")))  # digits in front of ten stay
        .otherwise(F.struct(F.lit(0).alias("a"), last.alias("b")))
    )
    hexed = lambda c: cell(c, F.lit(0), F.lit(16), F.conv(c, 16, 10))
    letters = _bound(open_, lambda o: F.transform(chars, lambda c, i: F.when(i.between(o["a"], o["b"]), by_range(c)).otherwise(fixed(c))))
    return F.when(kind == "IP", F.transform(F.split(canon, r"\."), octet)).when(kind == "SECRET", F.transform(chars, hexed)).otherwise(letters)


def permuted(values: Column, sizes: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the tuples (v0, v1, ...) with 0 <= vi < size i, under which no tuple stays as it is.

    A Feistel network: in each round the places of one half move by numbers drawn from a keyed hash of the other half.
    Tuples go through the network, then one step on at the first place, then back: a cycle conjugated by a permutation
    has no fixed points. Since it maps the whole range of a format onto itself, it never runs out of values.
    """

    def run(c: Column) -> Column:
        def step(v: Column, r: Column) -> Column:
            odd = F.abs(r) % 2
            source = F.when(odd == 1, F.slice(v, c["half"] + 1, c["n"])).otherwise(F.slice(v, 1, c["half"]))
            hashed = F.sha2(F.concat_ws("\x1f", F.lit(key), c["tweak"], F.abs(r).cast("string"), F.array_join(source.cast("array<string>"), ",")), 256)
            mine = lambda i: (i < c["half"]) == (odd == 1)
            moved = lambda h: F.transform(v, lambda x, i: F.when(mine(i), F.pmod(x + F.signum(r).cast("int") * F.pmod(F.xxhash64(h, i), c["sizes"][i]), c["sizes"][i]).cast("int")).otherwise(x))
            onward = F.transform(v, lambda x, i: F.when(i == 0, F.pmod(x + 1, c["sizes"][0])).otherwise(x))
            return F.when(r == 0, onward).otherwise(_bound(hashed, moved))

        return F.aggregate(F.lit([*range(1, ROUNDS + 1), 0, *range(-ROUNDS, 0)]), c["values"], step)

    # what each place needs is worked out once for all places
    both = F.struct(values.alias("values"), sizes.alias("sizes"), tweak.alias("tweak"))
    halved = lambda b: F.struct(b["values"].alias("values"), b["sizes"].alias("sizes"), b["tweak"].alias("tweak"), F.size(b["values"]).alias("n"), F.floor(F.size(b["values"]) / 2).cast("int").alias("half"))
    return _bound(_bound(both, halved), run)


def enciphered(kind: Column, canon: Column, key: str) -> Column:
    """The canonical surrogate of an entity that is not a name: same kind, format, script and checksums, another value.

    Different entities of a format have different surrogates by construction. Letters outside of RANGES stay.
    """

    def spelled(cells: Column) -> Column:
        free = F.filter(cells, lambda c: c["size"] > 1)
        values, sizes = F.transform(free, lambda c: c["value"]), F.transform(free, lambda c: c["size"])
        pattern = F.array_join(F.transform(cells, lambda c: F.when(c["size"] == 1, c["text"]).otherwise(F.concat(c["first"].cast("string"), F.lit("+"), c["size"].cast("string")))), " ")
        new = F.when(F.size(free) == 0, values).otherwise(permuted(values, sizes, F.concat_ws(" ", kind, pattern), key))
        char = lambda cp: F.when(cp < 128, F.char(cp)).otherwise(F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE"))
        shown = lambda c, x: F.when(kind == "IP", F.when((F.length(c["text"]) == 2) & c["text"].startswith("0"), F.lpad(x.cast("string"), 2, "0")).otherwise((c["first"] + x).cast("string"))).when(kind == "SECRET", F.lower(F.hex(x))).otherwise(char(c["first"] + x))
        placed = F.transform(cells, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
        moved = lambda v: F.zip_with(F.filter(placed, lambda p: p["c"]["size"] > 1), v, lambda p, x: F.struct(p["i"].alias("i"), shown(p["c"], x).alias("text")))
        stays = F.transform(F.filter(placed, lambda p: p["c"]["size"] == 1), lambda p: F.struct(p["i"].alias("i"), p["c"]["text"].alias("text")))
        joined = F.transform(F.array_sort(F.concat(stays, _bound(new, moved))), lambda p: p["text"])
        return F.when(kind == "IP", F.array_join(joined, ".")).otherwise(F.array_join(joined, ""))

    def checked(s: Column) -> Column:
        body = F.substring(s, F.lit(1), F.length(s) - 1)
        card = F.concat(body, F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))
        rest = F.substring(s, 5, 30)
        iban = F.concat(F.substring(s, 1, 2), F.lpad((F.lit(98) - mod97(F.concat(rest, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), rest)
        return F.when(kind == "CARD", card).when(kind == "IBAN", iban).otherwise(s)

    return _bound(_bound(_cells(kind, canon), spelled), checked)


def name_surrogates(names: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct names (kind, canon): no two of a kind share one, none is a name of the corpus.

    Rounds with collision checks: each name without a surrogate draws one from its own keyed hash and the round's number.
    Of those that draw the same, the one with the smallest canon gets it; a draw that is already given, or that occurs in
    the corpus, is void. Names are long enough for the number of names, and longer from round to round, so that free
    ones never run out. A given name behind a title that fits either gender takes the surrogate that the same name has
    behind others, if there is any. What a round decides is written to the shared folder.
    """
    sexed = names.filter(F.col("kind").isin("GIVEN_F", "GIVEN_M")).groupBy("canon").agg(F.min("kind").alias("as"))
    known = stored(names.join(sexed, "canon", "left").withColumn("as", F.when(F.col("kind") == "GIVEN_N", F.coalesce("as", "kind")).otherwise(F.col("kind"))), "names")
    left = known.filter("kind = as").select("kind", "canon")
    real = names.select("kind", F.col("canon").alias("surrogate"))
    count = left.count()
    length = next(n for n in range(3, 64) if 16**n >= 64 * count)
    given: DataFrame | None = None
    turn = 0
    while given is None or left.limit(1).count():
        draws = left.withColumn("surrogate", _name(F.col("kind"), F.col("canon"), turn, min(length + turn // 2, 60), key))
        first = draws.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(real, ["kind", "surrogate"], "left_anti")
        if given is not None:
            first = first.join(given, ["kind", "surrogate"], "left_anti")
        first = stored(first.select("kind", "canon", "surrogate"), "given")
        given = first if given is None else given.unionByName(first)
        left = stored(left.join(first, ["kind", "canon"], "left_anti"), "left")
        turn += 1
    return known.join(given.withColumnRenamed("kind", "as"), ["as", "canon"]).select("kind", "canon", "surrogate")


def _name(kind: Column, canon: Column, turn: int, length: int, key: str) -> Column:
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(turn))), 256)
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), 1).when(canon.rlike(r"\p{IsGreek}"), 2).otherwise(0)
    syllables = F.element_at(F.lit([list(x) for x in SYLLABLES.values()]), script + 1)
    digits = lambda h: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))
    stem = F.array_join(F.transform(_bound(h, digits), lambda d: F.element_at(syllables, d + 1)), "")
    ending = F.coalesce(*(F.when(kind == k, F.element_at(F.lit(list(own)), script + 1)) for k, own in ENDINGS.items()))
    return F.concat(stem, ending)


def _formatted(kind: Column, surface: Column, surrogate: Column) -> Column:
    """A surrogate in the writing of the surface: its characters in turn where the surface has letters or digits."""
    between = F.split(surface, r"[\p{L}\p{N}]", -1)  # one more than it has letters and digits
    spelled = F.array_join(F.zip_with(between, F.slice(F.split(surrogate, ""), 1, F.size(between) - 1), lambda b, c: F.concat(b, F.coalesce(c, F.lit("")))), "")
    shouted = (F.upper(surface) == surface) & (F.lower(surface) != surface)
    whole = F.when(shouted, F.upper(surrogate)).when(kind.isin(*ENDINGS), F.initcap(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("EMAIL", "IP", "SECRET", *ENDINGS), whole).otherwise(spelled)


def _replaced(rows: DataFrame, pattern: str, possible: Column, key: str, names: Column | None) -> DataFrame:
    """rows with their entities replaced: one search of each text, and one more of those that hold an entity."""
    found = rows.withColumn("_m", F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    units = found.withColumn("_u", F.transform("_m", lambda m: _units(m, names is not None)))

    def fresh(u: Column) -> Column:
        """(kind, text): what a unit becomes; kind is null where it stays as it is."""
        keep = F.struct(F.lit(None).cast("string").alias("kind"), u["surface"].alias("text"))
        new = lambda k, s: F.struct(k.alias("kind"), _formatted(k, u["surface"], s).alias("text"))
        coded = _bound(enciphered(u["kind"], u["canon"], key), lambda s: new(u["kind"], s))
        if names is None:
            return F.when(u["kind"].isNull(), keep).otherwise(coded)
        named = F.try_element_at(names, F.concat(F.when(u["kind"] == "WORD", F.lit("")).otherwise(u["kind"]), F.lit("|"), u["canon"]))
        return F.when(u["kind"].isNull(), keep).when(u["kind"].isin("WORD", *ENDINGS), _bound(named, lambda x: F.when(x.isNull(), keep).otherwise(new(x["kind"], x["surrogate"])))).otherwise(coded)

    done = units.withColumn("_n", F.transform("_u", lambda us: F.transform(us, fresh)))
    kinds = F.filter(F.transform(F.flatten("_n"), lambda x: x["kind"]), lambda k: k.isNotNull())
    counted = done.withColumn("_k", kinds)
    pieces = F.transform("_n", lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), ""))
    whole = F.array_join(F.zip_with(F.split("text", pattern, -1), pieces, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return counted.select("id", F.when(F.size("_k") > 0, whole).otherwise(F.col("text")).alias("text"), F.size("_k").cast("long").alias("n_entities"), F.array_sort(F.array_distinct("_k")).alias("kinds"))


def replace_private(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities, kinds) for every row of docs: entities in its text are replaced by surrogates.

    Found: e-mail addresses, secrets (32 to 128 hex digits, one of them a decimal one), IBANs and card numbers with a
    right checksum (whole matches, else the longest run of their groups that has one), IPv4 addresses, social security
    and telephone numbers, names behind a title, and further mentions of these names in the same text, but for words
    that the text also has in lower case. Everything else stays; numbers that fail their check are no entities.

    The same entity gets the same surrogate in every text and writing (coreference), different ones get different ones
    (distinctness). All but names go through a keyed permutation of their format (`permuted`), in place: numbers keep
    their format, cards and IBANs their checksum, first digit or country, addresses their top-level domain, phone
    numbers their country code. In a format that the corpus crowds, a surrogate may be another entity of the corpus.
    Names get surrogates with collision checks (`name_surrogates`), which keep gender and script.

    Texts without a title are one pass without a shuffle. Texts with one are written once to the shared folder; of
    these, only names are joined, and each text gets its own names. Null texts stay null with 0 entities; repeated rows
    are treated each; a null id stays null; other columns are not read, whatever their names; an empty table gives no
    rows.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    titled = F.coalesce(F.col("text").rlike(_TITLED), F.lit(False))
    possible = F.coalesce(F.col("text").rlike(_POSSIBLE), F.lit(False))
    others = _replaced(rows.filter(~titled), _ANY, possible, key, None)
    persons = stored(rows.filter(titled).withColumn("row", F.monotonically_increasing_id()), "persons")
    if persons.limit(1).count() == 0:
        return others.withColumnsRenamed({"id": id_col, "text": text_col})
    people = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(PERSON), F.lit(0)), _person))
    spots = persons.select("row", F.regexp_replace("text", _ANY, " ").alias("text"), F.explode(F.array_distinct(F.filter(people, lambda u: u["kind"].isNotNull()))).alias("u"))
    common = F.rlike("text", F.concat(F.lit(_EDGE), F.col("u.canon"), F.lit(_STOP)))
    spots = stored(spots.select("row", "u.kind", "u.canon", (~common).alias("mentioned")).distinct(), "spots")
    given = name_surrogates(spots.select("kind", "canon").distinct(), key)
    value = F.struct("kind", "surrogate")
    told = spots.join(given, ["kind", "canon"]).groupBy("row", "canon").agg(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "canon").alias("k"), value.alias("v"))).alias("own"), F.min(F.when(F.col("mentioned"), value)).alias("any"))
    entry = F.when(F.col("any").isNull(), F.col("own")).otherwise(F.array_append("own", F.struct(F.concat(F.lit("|"), "canon").alias("k"), F.col("any").alias("v"))))
    per_row = told.groupBy("row").agg(F.map_from_entries(F.flatten(F.collect_list(entry))).alias("names"))
    named = _replaced(persons.join(per_row, "row", "left"), _ANY_OF_PERSONS, F.lit(True), key, F.col("names"))
    return others.unionByName(named).withColumnsRenamed({"id": id_col, "text": text_col})
