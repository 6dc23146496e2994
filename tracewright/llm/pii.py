"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Each value found is checked (Luhn digit, address range, calendar, numbering plan) and
then moved by a keyed permutation of all values of its format. Equal values get equal
pseudonyms in every document, and a holder of the key can invert the permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
DEFAULT_KEY = "set a secret key of your own"

# The formats, each with its own boundaries, so that the first that matches at a place takes it.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})"
DATE = r"(?<![\d.\/-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}\/\d{2}\/\d{4})(?![\d\/-]|\.\d)"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])|(?<![\d+])\+\d{7,15}(?!\d)"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\d-])"
CARD = CARD.replace(r"\1", r"\k<gap>").replace("([ -])", "(?<gap>[ -])")
FOUND = "|".join([EMAIL, DATE, ADDRESS, SOCIAL, PHONE, CARD])
KINDS = ["email", "date", "address", "social", "phone", "card"]

# The Gregorian calendar repeats after 400 years of 146,097 days, here 1800 to 2199.
FIRST_DAY = "1800-01-01"
DAYS = (189, 773)


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permuted(value: Column, left: int, right: int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1: Feistel rounds that add modulo each half in turn."""
    mixed = lambda i, half: _number(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string")))
    ended = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(F.floor(value / right).cast("long").alias("l"), (value % right).cast("long").alias("r")),
        lambda s, i: F.when(
            i % 2 == 1, F.struct(((s["l"] + mixed(i, s["r"])) % left).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + mixed(i, s["l"])) % right).alias("r"))),
    )
    return ended["l"] * right + ended["r"]


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _digits_moved(digits: Column, width: int, key: str, tweak: str) -> Column:
    """Digit strings of one width among themselves; at most 18 digits fit a long."""
    split = width // 2
    return _padded(permuted(digits.cast("long"), 10 ** (width - split), 10**split, key, tweak), width)


def _by_width(digits: Column, widths: range, key: str, tweak: str) -> Column:
    out = F.lit(None).cast("string")
    for width in widths:
        out = F.when(F.length(digits) == width, _digits_moved(digits, width, key, f"{tweak}{width}")).otherwise(out)
    return out


def _refilled(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced in order by ``digits``."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    return F.aggregate(
        F.split(pattern, ""), state,
        lambda s, c: F.when(
            c.rlike("[0-9]"),
            F.struct(F.concat(s["out"], F.substr(digits, s["next"], F.lit(1))).alias("out"), (s["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))),
        lambda s: s["out"],
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit at weight one."""
    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(
        places, F.lit(0),
        lambda total, i: total + F.when(
            i % 2 == 1, F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        ).otherwise(
            F.element_at(F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                         F.substr(F.reverse(digits), i, F.lit(1)).cast("int") + 1)
        ),
    )


def _card(value: Column, key: str) -> Column:
    """The issuer's first digit stays, the middle moves, the check digit is computed anew."""
    digits = _digits(value)
    middle = F.substr(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(F.substring(digits, 1, 1), _by_width(middle, range(11, 18), key, "card"))
    check = (F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(digits) % 10 == 0, _refilled(value, F.concat(body, check.cast("string"))))


def _address(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    whole = F.aggregate(octets, F.lit(0).cast("long"), lambda total, x: total * 256 + x)
    moved = permuted(whole, 1 << 16, 1 << 16, key, "address")
    parts = [((F.floor(moved / F.lit(256**n))) % 256).cast("string") for n in (3, 2, 1, 0)]
    return F.when(F.forall(octets, lambda x: x < 256), F.concat_ws(".", *parts))


def _social(value: Column, key: str) -> Column:
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(n)).cast("long") for n in (1, 2, 3))
    ranked = area - F.when(area > 666, 2).otherwise(1)  # 898 areas: 1 to 899 without 666
    place = ranked * (99 * 9999) + (group - 1) * 9999 + serial - 1
    moved = permuted(place, 898, 99 * 9999, key, "social")
    rank = F.floor(moved / (99 * 9999)) + 1
    rest = moved % (99 * 9999)
    out = F.concat_ws(
        "-", _padded(rank + F.when(rank > 665, 1).otherwise(0), 3), _padded(F.floor(rest / 9999) + 1, 2),
        _padded(rest % 9999 + 1, 4),
    )
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, out)


def _phone(value: Column, key: str) -> Column:
    """Numbers of the ten-digit plan move within its three classes of area and exchange; others keep two digits."""
    digits = _digits(value)
    ten = (F.length(digits) == 10) & ~value.startswith("+") | (F.length(digits) == 11) & value.startswith("+1")
    head = F.substr(digits, F.lit(1), F.length(digits) - 10)
    local = F.substr(digits, F.length(digits) - 9, F.lit(10)).cast("long")
    area, rest = F.floor(local / 10**7).cast("long"), local % 10**7
    normal = (area - 200) * 8_000_000 + rest - 2_000_000
    in_plan = permuted(normal, 800, 8_000_000, key, "phone")
    low = permuted((area - 200) * 2_000_000 + rest, 800, 2_000_000, key, "exchange")
    under = permuted(local, 200, 10**7, key, "area")
    moved = (
        F.when(area < 200, under)
        .when(rest < 2_000_000, (F.floor(low / 2_000_000) + 200) * 10**7 + low % 2_000_000)
        .otherwise((F.floor(in_plan / 8_000_000) + 200) * 10**7 + in_plan % 8_000_000 + 2_000_000)
    )
    tail = F.substr(digits, F.lit(3), F.length(digits) - 2)
    other = F.concat(F.substring(digits, 1, 2), _by_width(tail, range(5, 17), key, "number"))
    # Ten digits without a code in front are fewer than 12, so F.length(digits) - 2 is 5 at least.
    return _refilled(value, F.when(ten, F.concat(head, _padded(moved.cast("long"), 10))).otherwise(other))


def _date(value: Column, key: str) -> Column:
    """Days of 1800 to 2199. A date with slashes is day first if that is a date, else month first."""
    forms = [("yyyy-MM-dd", value.rlike("-")), ("dd.MM.yyyy", value.rlike(r"\.")), ("dd/MM/yyyy", value.rlike("/")), ("MM/dd/yyyy", value.rlike("/"))]
    out = F.lit(None).cast("string")
    for form, fits in reversed(forms):
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")
        index = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        moved = permuted(index.cast("long"), *DAYS, key, "date").cast("int")
        inside = fits & day.isNotNull() & index.between(0, DAYS[0] * DAYS[1] - 1)
        out = F.when(inside, F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved), form)).otherwise(out)
    return out


def _email(value: Column, key: str) -> Column:
    """The local part moves, letter for letter and digit for digit, in halves that shift each other."""
    local = F.substring_index(value, "@", 1)
    size = F.length(local)
    half = F.floor(size / 2).cast("int")
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]

    def shifted(text: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other), 256)

        def moved(c: Column, n: Column) -> Column:
            by = F.conv(F.substr(stream, n % 31 * 2 + 1, F.lit(3)), 16, 10).cast("int")
            out = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                to = F.substr(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))
                out = F.when(at > 0, to).otherwise(out)
            return out

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), moved), "")

    ended = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, size - half).alias("r")),
        lambda s, i: F.when(i % 2 == 1, F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r"))
        ),
        lambda s: F.concat(s["l"], s["r"]),
    )
    return F.concat(ended, F.lit("@"), F.substring_index(value, "@", -1))


def _kind(value: Column) -> Column:
    shapes = [("email", "@"), ("date", f"^(?:{DATE})$"), ("address", f"^(?:{ADDRESS})$"), ("social", f"^(?:{SOCIAL})$"), ("phone", f"^(?:{PHONE})$")]
    out = F.lit("card")
    for kind, shape in reversed(shapes):
        out = F.when(value.rlike(shape), kind).otherwise(out)
    return out


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    """The pseudonym of one value, null if it fails its check."""
    movers = {"email": _email, "date": _date, "address": _address, "social": _social, "phone": _phone, "card": _card}
    out = F.lit(None).cast("string")
    for name, move in movers.items():
        out = F.when(kind == name, move(value, key)).otherwise(out)
    return out


def _masked(docs: DataFrame, key: str) -> DataFrame:
    """Each input row as struct ``row``, the new text, and ``moved``: kind and pseudonym of each place, null if not valid."""
    step = docs.select(F.struct("*").alias("row")).withColumn(
        "found",
        F.when(F.col("row.text").rlike("[0-9@]"), F.regexp_extract_all("row.text", F.lit(FOUND), F.lit(0)))
        .otherwise(F.array().cast("array<string>")),
    )
    step = step.withColumn(
        "moved",
        F.transform(
            "found",
            lambda v: F.struct(_kind(v).alias("kind"), pseudonym(_kind(v), v, key).alias("value")),
        ),
    )
    # The text between the places, and behind each of them the new or the old value.
    between = F.split("row.text", FOUND, -1)
    values = F.zip_with("found", "moved", lambda old, new: F.coalesce(new["value"], old))
    values = F.concat(values, F.array(F.lit("")))
    whole = F.array_join(F.zip_with(between, values, lambda a, b: F.concat(a, b)), "")
    return step.withColumn("text", F.when(F.size("found") > 0, whole).otherwise(F.col("row.text")))


def _number_of(kind: str) -> Column:
    return F.size(F.filter("valid", lambda m: m["kind"] == kind)).cast("long")


def pseudonymized(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """Per input row ``doc_id``, ``text`` with pseudonyms, ``n_moved`` and a count per kind.

    Null stays null, empty stays empty, values that fail their check stay as they are.
    """
    valid = F.filter("moved", lambda m: m["value"].isNotNull())
    step = _masked(docs, key).withColumn("valid", valid)
    counts = [_number_of(k).alias(f"n_{k}") for k in KINDS]
    return step.select("row.doc_id", "text", F.size("valid").cast("long").alias("n_moved"), *counts)


def masked(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """All rows and columns of ``docs``, with pseudonyms in ``text``; ``n_chars``, where there is one, follows it."""
    step = _masked(docs, key)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    old = {c: F.col(f"row.`{c}`") for c in docs.columns}
    return step.select(*[F.when(F.size("found") > 0, made[c]).otherwise(old[c]).alias(c) if c in made else old[c].alias(c) for c in docs.columns])
