"""Personal data replaced by keyed surrogates of the same type, as DataFrame functions.

Each mention is split into components: an address, a number, or the given name and surname that
follow a title. A component's surrogate depends on the key, its kind and its normalised value
alone, so that one entity has one surrogate in the whole corpus, also when only its surname is
mentioned, or its number is written in another format. A name that a title introduces is
also replaced where its words return in that text without one. Kinds carry gender and script; the
surrogate is drawn in that script and gender and shown in the format of the mention. A title such as
"Dr." states no gender: the one that other titles of the corpus give the person, or else the given
name, is taken if it is the only one. A number without its country is that of the one country which
its text, or else the corpus, gives it.

Distinct components are few and narrow. Their surrogates are checked against each other and
against all originals; those that clash are drawn again, and the check is repeated until none do.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import check_columns, let, whole_text, written

#: Draws in the format of the kind, from spaces that grow with the draw where the format allows it.
#: What still clashes gets a free value by rank, and an opaque surrogate only where none is left.
DRAWS = 12

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MALE = r"Mr|Herr|Monsieur|Señor|Sr|Г-н|г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|г-жа"
_NEUTRAL = r"Dr|Prof"
#: Hyphens and apostrophes stand between letters; a possessive s is not part of the name.
_NAME_WORD = r"\p{Lu}(?:(?!['’]s(?!\p{L}))['’-]?\p{L}){1,40}"

_EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@"
    r"(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
)
_IP = rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
#: Eight groups, or fewer around a double colon, with a digit among them.
_IP6 = (
    r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?!(?:[0-9A-Fa-f]*:){8})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])"
)
#: 15 to 34 characters, the last group of four cut where the number ends.
_IBAN = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){7} ?[A-Z0-9]{1,2}"
    r"|(?: ?[A-Z0-9]{4}){3,6} ?[A-Z0-9]{1,3}|(?: ?[A-Z0-9]{4}){3,7}|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})"
    r"(?![A-Za-z0-9])"
)
_SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_CARD = (
    r"(?<![0-9A-Za-z+])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?:[ -][0-9]{1,3})?"
    r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
)
_PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])"
    r"[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9A-Za-z])"
)
_NAME = (
    rf"(?<!\p{{L}})(?:{_FEMALE}|{_MALE}|{_NEUTRAL})\.? {_NAME_WORD}(?: {_NAME_WORD})?(?!\p{{L}})"
)
#: A word that may repeat a name found after a title.
_WORD = rf"(?<![\p{{L}}\p{{N}}]){_NAME_WORD}(?!\p{{L}})"
#: kind, pattern; the first that fits where a mention starts.
PATTERNS = (
    ("email", _EMAIL),
    ("ip", _IP),
    ("ip6", _IP6),
    ("iban", _IBAN),
    ("social", _SOCIAL),
    ("card", _CARD),
    ("phone", _PHONE),
    ("name", _NAME),
)
ANY = "|".join(p for _, p in PATTERNS)
#: A cheap sign that a text may hold a mention.
_HINT = rf"@|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|[0-9][0-9 ().+-]{{5,}}[0-9]|[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}|(?:{_FEMALE}|{_MALE}|{_NEUTRAL})\.? \p{{Lu}}"
_TITLE = rf"^(?:{_FEMALE}|{_MALE}|{_NEUTRAL})\.? "


def _kind(mention: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in PATTERNS:
        # Looking around is for the text; the mention alone is tested whole.
        bare = pattern.replace(r"(?<![0-9A-Za-z.])", "").replace(r"(?<!\p{L})", "")
        out = out.when(mention.rlike(f"^(?:{bare})$"), kind)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _gender(title: Column) -> Column:
    return (
        F.when(title.rlike(rf"^(?:{_FEMALE})\.? $"), "f")
        .when(title.rlike(rf"^(?:{_MALE})\.? $"), "m")
        .otherwise("n")
    )


def _nobody() -> Column:
    return F.lit(None).cast("string")


def _component(before: Column, kind: Column, raw: Column, person: Column | None = None) -> Column:
    person = _nobody() if person is None else person
    return F.struct(
        before.alias("before"), kind.alias("kind"), raw.alias("raw"), person.alias("person")
    )


def _components(gap: Column, mention: Column) -> Column:
    """The components of a mention, the first with all text since the mention before."""

    def named(title: Column) -> Column:
        words = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ")
        surname = F.element_at(words, -1)
        of_surname = F.concat(F.lit("surname_"), _script(surname))
        given = F.element_at(words, 1)
        of_given = F.concat(F.lit("given_"), _gender(title), F.lit("_"), _script(given))
        return F.when(
            F.size(words) == 1, F.array(_component(F.concat(gap, title), of_surname, surname))
        ).otherwise(
            F.array(
                _component(F.concat(gap, title), of_given, given, F.lower(F.concat_ws(" ", given, surname))),
                _component(F.lit(" "), of_surname, surname),
            )
        )

    kind = _kind(mention)
    return let(
        kind,
        lambda k: F.when(
            k == "name", let(F.regexp_extract(mention, _TITLE, 0), named)
        ).otherwise(F.array(_component(gap, k, mention))),
    )


def normalised(kind: Column, raw: Column) -> Column:
    """What the mentions of one entity have in common."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "social"), digits)
        .when(
            kind == "phone",
            F.when(raw.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(F.right(digits, F.lit(10))),
        )
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "ip", raw)
        .when(kind == "ip6", F.array_join(_groups(raw), ":"))
        .otherwise(F.lower(raw))
    )


def _groups(raw: Column) -> Column:
    """The eight groups of an address, lower case and without leading zeros."""

    def stated(part: Column) -> Column:
        groups = F.transform(F.split(part, ":"), lambda g: F.regexp_replace(g, "^0+(?=.)", F.lit("")))
        return F.filter(groups, lambda g: g != "")

    before, after = (stated(F.split_part(F.lower(raw), F.lit("::"), F.lit(i))) for i in (1, 2))
    left = F.greatest(8 - F.size(before) - F.size(after), F.lit(0))
    return F.concat(before, F.array_repeat(F.lit("0"), left), after)


def _body(kind: Column, value: Column) -> Column:
    """What the surrogate of a value stands for: the country code of a number stays as it is."""
    return F.when(kind == "phone", F.right(F.replace(value, F.lit("+")), F.lit(10))).otherwise(value)


def mentions(text: Column) -> Column:
    """Struct of components (before, kind, raw, value, person) in order, and tail: the text after them."""

    def with_value(c: Column) -> Column:
        return F.struct(
            c["before"].alias("before"),
            c["kind"].alias("kind"),
            c["raw"].alias("raw"),
            normalised(c["kind"], c["raw"]).alias("value"),
            c["person"].alias("person"),
        )

    def both(found: Column) -> Column:
        gaps = F.split(text, ANY, -1)
        return let(
            gaps,
            lambda g: F.struct(
                F.transform(
                    F.flatten(F.zip_with(F.slice(g, F.lit(1), F.size(found)), found, _components)),
                    with_value,
                ).alias("components"),
                F.element_at(g, -1).alias("tail"),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), both)


def with_words(found: Column) -> Column:
    """found with the capitalised words between mentions as components of kind word.

    Only a text with a titled name gets them; `pseudonymised` replaces those that repeat one.
    """

    def words(gap: Column) -> Column:
        raws = F.regexp_extract_all(gap, F.lit(f"({_WORD})"), F.lit(1))
        return let(
            F.struct(raws.alias("raws"), F.split(gap, _WORD, -1).alias("gaps")),
            lambda z: F.struct(
                F.zip_with(
                    F.slice(z["gaps"], F.lit(1), F.size(z["raws"])),
                    z["raws"],
                    lambda before, raw: F.struct(
                        before.alias("before"),
                        F.lit("word").alias("kind"),
                        raw.alias("raw"),
                        F.lower(raw).alias("value"),
                        _nobody().alias("person"),
                    ),
                ).alias("components"),
                F.element_at(z["gaps"], -1).alias("tail"),
            ),
        )

    def split(c: Column) -> Column:
        return let(
            words(c["before"]),
            lambda w: F.concat(
                w["components"],
                F.array(
                    F.struct(
                        w["tail"].alias("before"),
                        c["kind"].alias("kind"),
                        c["raw"].alias("raw"),
                        c["value"].alias("value"),
                        c["person"].alias("person"),
                    )
                ),
            ),
        )

    def whole(m: Column) -> Column:
        return let(
            words(m["tail"]),
            lambda w: F.struct(
                F.concat(F.flatten(F.transform(m["components"], split)), w["components"]).alias("components"),
                w["tail"].alias("tail"),
            ),
        )

    return let(
        found,
        lambda m: F.when(F.exists(m["components"], lambda c: _is_name(c["kind"])), whole(m)).otherwise(m),
    )


def _is_name(kind: Column) -> Column:
    return kind.startswith("given_") | kind.startswith("surname_")


def _number(seed: Column, i: Column | int) -> Column:
    """A keyed number below 2^28 for the i-th character."""
    i = F.lit(i) if isinstance(i, int) else i
    digest = F.sha2(F.concat_ws("|", seed, i.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def _pick(seed: Column, i: Column | int, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), (_number(seed, i) % len(alphabet) + 1).cast("int"), F.lit(1))


def _like(value: Column, seed: Column) -> Column:
    """Each letter and digit drawn anew within its class; other characters stay."""
    return F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), _pick(seed, i, "0123456789"))
            .when(c.rlike("[a-z]"), _pick(seed, i, "abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), _pick(seed, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .otherwise(c),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    """The remainder of the check sum of card numbers."""
    points = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, seed: Column) -> Column:
    """First digit kept, the rest drawn; valid exactly where the original is."""
    body = F.concat(
        F.substring(value, 1, 1),
        _like(F.substring(value, F.lit(2), F.length(value) - 2), seed),
    )
    check = F.pmod(_luhn(value) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return F.concat(body, check.cast("string"))


def _remainder(text: Column) -> Column:
    """Of the number that the characters spell, letters as 10 to 35, modulo 97."""
    points = F.transform(F.split(text, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(
        points, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97
    )


def _iban(value: Column, seed: Column) -> Column:
    """Country kept, the rest drawn; the check digits hold exactly where the original's do."""
    country, body = F.substring(value, 1, 2), F.substring(value, 5, 40)

    def checked(new: Column) -> Column:
        wanted = _remainder(F.concat(body, F.substring(value, 1, 4)))
        check = F.pmod(wanted - _remainder(F.concat(new, country, F.lit("00"))), F.lit(97))
        check = check + F.when(check < 2, 97).otherwise(0)
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    return let(_like(body, seed), checked)


def _ip6(value: Column, seed: Column, draw: Column) -> Column:
    """First group kept, the others drawn; groups of zeros stay so in the earlier draws."""
    return F.array_join(
        F.transform(
            F.split(value, ":"),
            lambda g, i: F.when((i == 0) | ((g == "0") & (draw < DRAWS // 2)), g).otherwise(
                F.lower(F.hex(_number(seed, i) % 65535 + 1))
            ),
        ),
        ":",
    )


def _ip(value: Column, seed: Column, draw: Column) -> Column:
    """An address of the same network class: private and loopback prefixes stay.

    Later draws take all octets, and then the largest private network for the smaller ones.
    """
    own = F.regexp_extract(
        value, r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)", 0
    )
    kept = F.when((draw >= DRAWS // 2) & own.rlike("^1[79]"), "10.").otherwise(own)
    octets = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.when((draw == 0) | (kept == ""), _number(seed, i) % 223 + 1)
        .otherwise(_number(seed, i) % 256)
        .cast("string"),
    )
    left = 4 - (F.length(kept) - F.length(F.replace(kept, F.lit("."))))
    return F.concat(kept, F.array_join(F.slice(octets, F.lit(1), left), "."))


def _name(kind: Column, value: Column, seed: Column, draw: Column) -> Column:
    """Syllables of the script, more in later draws; given names end as names of the gender do.

    The parts of a hyphenated name are drawn one by one.
    """

    def syllables(onsets: str, vowels: str) -> Column:
        return F.array_join(
            F.transform(F.split(value, "-"), lambda part, at: of_part(part, at * 100, onsets, vowels)), "-"
        )

    def of_part(part: Column, at: Column, onsets: str, vowels: str) -> Column:
        count = (F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.length(part) / 2)))).cast("int")
        count = count + F.floor(draw / 3).cast("int")
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.concat(_pick(seed, at + i * 2, onsets), _pick(seed, at + i * 2 + 1, vowels)),
            ),
            "",
        )

    latin = syllables("bcdfghjklmnprstvwz", "aeiou")
    cyrillic = syllables(
        "бвгдклмнпрст",
        "аеиоу",
    )
    stem = F.when(kind.endswith("cyrillic"), cyrillic).otherwise(latin)
    female = F.when(kind.endswith("cyrillic"), F.lit("на")).otherwise(F.lit("na"))
    male = F.when(kind.endswith("cyrillic"), F.lit("н")).otherwise(F.lit("n"))
    end = F.when(kind.startswith("given_f"), female).when(kind.startswith("given_m"), male)
    return F.concat(stem, F.coalesce(end, F.lit("")))


def drawn(kind: Column, value: Column, draw: Column, key: str) -> Column:
    """The surrogate of a component's value at a draw."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, draw.cast("string")), 256)
    at = F.instr(value, "@")
    address = F.concat(
        _like(F.substring(value, F.lit(1), at - 1), seed),
        _like(F.repeat(F.lit("a"), draw), F.concat(seed, F.lit("+"))),  # longer in later draws
        F.lit("@"),
        _like(F.regexp_extract(value, r"@(.*)\.[a-z]+$", 1), F.reverse(seed)),
        F.lit(".example"),  # reserved: never somebody's address
    )
    surrogate = (
        F.when(kind == "email", address)
        .when(kind == "card", _card(value, seed))
        .when(kind == "ip", _ip(value, seed, draw))
        .when(kind == "ip6", _ip6(value, seed, draw))
        .when(kind == "iban", _iban(value, seed))
        .when(kind.isin("phone", "social"), _like(_body(kind, value), seed))
        .otherwise(_name(kind, value, seed, draw))
    )
    return F.when(draw < DRAWS, surrogate).otherwise(F.concat(F.lit("~"), F.substring(seed, 1, 24)))


def _by_rank(now: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """now with free values, by rank, for what no draw gave a value in its format.

    Numbers take free numbers of their length; addresses take reserved ones, 240.0.0.0 and up. Of
    as many values as are taken and asked for, enough are free, so no more are looked at.
    """
    rank = F.when(F.col("kind") == "ip", 0).otherwise(F.length(_body(F.col("kind"), F.col("value"))))
    full = (F.col("draw") >= DRAWS) & F.col("kind").isin("phone", "social", "ip")
    left = now.where(full).withColumn("shape", rank)
    groups = left.groupBy("kind", "shape").count().collect()
    if not groups:
        return now
    used = taken.select("family", "surrogate").unionByName(now.select("family", "surrogate"))
    used = used.groupBy("family").count().collect()
    used = {r["family"]: r["count"] for r in used}
    given = None
    for kind, shape, wanted in groups:
        space = 10**shape if shape else 1 << 28
        digest = hashlib.sha256(f"{key}|{kind}|{shape}".encode()).digest()
        start = int.from_bytes(digest[:4], "big") % space
        numbers = now.sparkSession.range(min(space, used[kind] + wanted)).select(
            F.col("id").alias("i"), ((F.col("id") * 387_420_489 + start) % space).alias("v")  # 3^18
        )
        octets = [F.shiftright("v", 24) + 240, *(F.shiftright("v", b) % 256 for b in (16, 8, 0))]
        value = F.lpad(F.col("v").cast("string"), shape, "0") if shape else F.concat_ws(".", *octets)
        values = numbers.select("i", value.alias("surrogate"))
        for others in (taken, now):
            own = others.where(F.col("family") == kind).select("surrogate")
            values = values.join(own, "surrogate", "left_anti")
        values = values.orderBy("i").limit(wanted)
        values = values.select(F.col("surrogate").alias("free"), F.row_number().over(Window.orderBy("i")).alias("r"))
        asked = left.where((F.col("kind") == kind) & (F.col("shape") == shape))
        asked = asked.select("kind", "value", F.row_number().over(Window.orderBy("value")).alias("r"))
        pairs = asked.join(values, "r").drop("r")
        given = pairs if given is None else given.unionByName(pairs)
    given, _ = written(given, "ranked")
    return now.join(given, ["kind", "value"], "left").withColumn("surrogate", F.coalesce("free", "surrogate"))


def surrogates(components: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate of each distinct component (kind, value).

    Within a kind no two values share a surrogate, and none is an original of that kind. That of a
    number has its last ten digits; given names of all genders count as one kind.
    """
    family = F.regexp_replace("kind", "_(f|m|n)_", "_")  # given names of any gender stay apart
    originals, _ = written(
        components.select("kind", "value").distinct().withColumn("family", family), "entities"
    )
    originals = originals.withColumn("draw", F.lit(0))
    taken = originals.select("family", _body(F.col("kind"), F.col("value")).alias("surrogate")).distinct()
    current = originals
    while True:
        now = current.withColumn("surrogate", drawn(F.col("kind"), F.col("value"), F.col("draw"), key))
        first = Window.partitionBy("family", "surrogate").orderBy("draw", "kind", "value")
        now = now.withColumn("place", F.row_number().over(first)).join(
            taken.withColumn("real", F.lit(True)), ["family", "surrogate"], "left"
        )
        now, _ = written(
            now.withColumn("clash", (F.col("place") > 1) | F.col("real").isNotNull()), "surrogates"
        )
        if now.where("clash").isEmpty():
            return _by_rank(now, taken, key).select("kind", "value", "surrogate")
        current = now.select(
            "kind", "value", "family", (F.col("draw") + F.col("clash").cast("int")).alias("draw")
        )


def shown(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention."""
    significant = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")

    def aligned(c: Column, i: Column) -> Column:
        rest = F.substring(raw, i + 1, F.length(raw))
        after = F.length(F.regexp_replace(rest, F.when(kind == "iban", "[^A-Z0-9]").otherwise("[^0-9]"), F.lit("")))
        use = F.regexp_like(c, significant) & (after <= F.length(surrogate))
        return F.when(use, F.substring(surrogate, F.length(surrogate) - after + 1, F.lit(1))).otherwise(c)

    in_place = F.array_join(F.transform(F.split(raw, ""), aligned), "")
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    short = F.when(
        raw.contains("::"),
        F.regexp_replace(surrogate, "^(.*?)(?:^|:)0(?::0)+(?::|$)(.*)$", F.lit("$1::$2")),
    ).otherwise(surrogate)
    return (
        F.when(surrogate.startswith("~"), F.substring(surrogate, 2, 24))
        .when(kind.isin("card", "social", "phone", "iban"), in_place)
        .when(kind == "ip6", F.when(upper, F.upper(short)).otherwise(short))
        .when(upper & (F.length(raw) > 1), F.upper(surrogate))
        .when(kind.isin("email", "ip"), surrogate)
        .otherwise(F.array_join(F.transform(F.split(surrogate, "-"), F.initcap), "-"))
    )


def _only(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The keys whose rows agree on a value, and that value; nulls do not count."""
    both = rows.groupBy(*keys).agg(F.min(value).alias(name), F.max(value).alias("__last"))
    return both.where(F.col(name) == F.col("__last")).drop("__last")


def resolved(titled: DataFrame) -> DataFrame:
    """titled, with the gender of neutral titles and the country of bare numbers where they are known.

    Only rows that leave something open are joined, with aggregates that combine map-side.
    """
    kind, value = F.col("kind"), F.col("value")
    open_name, open_number = kind.startswith("given_n_"), (kind == "phone") & ~value.startswith("+")
    stated = titled.where(kind.startswith("given_") & ~open_name)
    gender = F.substring("kind", 7, 1)
    names = (
        titled.where(open_name)
        .join(_only(stated, ["person"], gender, "of_person"), "person", "left")
        .join(_only(stated, ["value"], gender, "of_name"), "value", "left")
        .withColumn(
            "kind",
            F.concat(F.lit("given_"), F.coalesce("of_person", "of_name", F.lit("n")), F.substring("kind", 8, 40)),
        )
    )
    full = titled.where((kind == "phone") & value.startswith("+")).select(
        "row", F.col("value").alias("number"), _body(kind, value).alias("value")
    )
    numbers = (
        titled.where(open_number)
        .join(_only(full, ["row", "value"], F.col("number"), "in_text"), ["row", "value"], "left")
        .join(_only(full, ["value"], F.col("number"), "anywhere"), "value", "left")
        .withColumn("value", F.coalesce("in_text", "anywhere", "value"))
    )
    rest = titled.where(~open_name & ~open_number)
    return rest.unionByName(names.select(titled.columns)).unionByName(numbers.select(titled.columns))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, and the number of components replaced, for each row of docs.

    A null text stays null and an empty one empty; an empty table gives no rows. Rows without
    mentions keep their text. Texts of any length are read whole. Other columns of docs are ignored,
    whatever their names; repeated rows give repeated results.
    """
    check_columns(docs, ("doc_id", "text"))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hint = F.coalesce(F.col("text").rlike(_HINT), F.lit(False))
    found, _ = written(
        docs.where(hint).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            with_words(mentions(whole_text())).alias("m"),
        ),
        "mentions",
    )
    each = found.select("row", F.posexplode("m.components").alias("at", "c")).select(
        "row", "at", *(F.col(f"c.{name}").alias(name) for name in ("kind", "value", "raw", "person"))
    )
    titled, _ = written(each.where(F.col("kind") != "word"), "titled")
    titled, _ = written(resolved(titled).drop("person"), "resolved")
    # A word of the text that repeats a name found in it is that name.
    names = titled.where(_is_name(F.col("kind"))).groupBy("row", "value").agg(F.min("kind").alias("kind"))
    words = each.where(F.col("kind") == "word").drop("kind", "person").join(names, ["row", "value"], "left")
    mapped = titled.unionByName(words).join(surrogates(titled, key), ["kind", "value"], "left")
    mapped = mapped.select(
        "row",
        "at",
        F.col("kind").isNotNull().cast("long").alias("real"),
        F.when(F.col("kind").isNull(), F.col("raw"))
        .otherwise(shown(F.col("kind"), F.col("raw"), F.col("surrogate")))
        .alias("shown"),
    )
    lists = mapped.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", "shown"))).alias("new"), F.sum("real").alias("real")
    )
    pieces = F.zip_with("m.components", "new", lambda c, n: F.concat(c["before"], n["shown"]))
    replaced = found.join(lists, "row", "left").select(
        "doc_id",
        F.concat(
            F.coalesce(F.array_join(pieces, ""), F.lit("")), F.col("m.tail")
        ).alias("text"),
        F.coalesce("real", F.lit(0).cast("long")).alias("n_replaced"),
    )
    rest = docs.where(~hint).select("doc_id", "text", F.lit(0).cast("long").alias("n_replaced"))
    return rest.unionByName(replaced)
