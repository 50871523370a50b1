"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities found by pattern: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment card numbers,
social security numbers, IBANs, access keys, passwords and tokens after their markers (in any case, behind = or :
with or without blanks, up to 20 a side, and quotes), and person names after a title. Every value behind such a marker
counts as a secret, for tokens from eight characters on and if it is no call. Each becomes another value of the same type and form:

* characters are exchanged within their class (digit, a-f, g-z, A-F, G-Z), so hexadecimal stays hexadecimal;
* telephone and card numbers keep their punctuation, the country code and, for cards, a valid check digit;
* IPv6 addresses, written whole or with `::`, keep their groups of zeros and the way they are written; an IPv4 address
  at their end is exchanged as one, without what stands before it;
* mail domains become labels under the reserved example domains, IPv4 addresses lie in the reserved block
  240.0.0.0/4;
* names keep title, number of parts, script (Latin, Greek, Cyrillic) and the gender that the title shows.

The surrogate depends only on the key and the entity's canonical form (case, punctuation and country code left
out), so all mentions of an entity agree in all documents. Distinct entities get distinct surrogates: all
entities of the table are proposed for together, and one whose proposal equals another's, or a value that
really occurs, is proposed for again with the next counter until none is left. From `GROW` attempts on,
proposals get longer, so short forms cannot run out (addresses have 2**28 values).

Every document is read in full. Only documents with an entity are shuffled with their text; the table of
entities is joined by shuffle, and its distinct step combines before it.

Defined results: null text stays null; text without entities stays as it is, empty text too; repeated rows
are each rewritten the same way; an empty table gives an empty one; other columns pass through, whatever
their names. A column `n_chars` is set to the new length by the pipeline's stage, not here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, materialise

KEY = "kinfold-public-demo-key"
GROW = 6
MAX_ATTEMPTS = 40

_TITLES_M = r"Mr|Herr|Señor|Monsieur|Sir|Κύριος|Господин"
_TITLES_F = r"Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Κυρία|Госпожа"

_BLANK = r"[ \t\u00a0]{0,20}"


def _marked(markers: str) -> str:
    """Place behind a marker in any case, `=` or `:` with or without blanks, and at most one quote; the first
    two tests are implied by the third and cheap."""
    return (
        rf"(?<=[=:>\"' \t\u00a0])(?<=[=:]>?{_BLANK}[\"']?)(?<=(?i:{markers})[\"']?{_BLANK}[=:]{{1,2}}>?{_BLANK}[\"']?)(?![=:>])"
    )


_H = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer with `::` for one or more groups of zeros; `::` alone is no address of anybody.
_IPV6 = "|".join(
    [f"(?:{_H}:){{7}}{_H}"]
    + [f"(?:{_H}:){{{n}}}(?::{_H}){{1,{7 - n}}}" for n in range(6, 0, -1)]
    + [f":(?::{_H}){{1,7}}", f"(?:{_H}:){{1,7}}:"]
)

_PASSWORDS = r"password|passwd|pwd|secret"
_TOKENS = r"token|api[_-]?key"

#: Type and pattern, in order of precedence. Patterns have no capturing groups.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "password": rf"{_marked(_PASSWORDS)}(?:(?<=\")[^\"\n]+(?=\")|(?<=')[^'\n]+(?=')|(?=[^\s\"']*[\p{{L}}\p{{N}}])[^\s\"']*[^\s\"'.,;:!?)\]}}])",
    "token": rf"{_marked(_TOKENS)}(?=[A-Za-z0-9_.~+/=-]{{8}})[A-Za-z0-9_~+/=-]++(?:\.[A-Za-z0-9_~+/=-]++)*+(?![A-Za-z0-9_(\[])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv6": rf"(?=[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f:])(?:(?<![0-9A-Fa-f:])(?:{_H}:){{7}}{_H}(?![0-9A-Fa-f:])"
    rf"|(?<![0-9A-Za-z_])(?<!::)(?<!(?<![0-9A-Za-z_])[0-9A-Fa-f]{{1,4}}:)(?:{_IPV6})(?![0-9A-Za-z_]|:[0-9A-Fa-f:]|\.[0-9]))",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9+-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "name": rf"(?<=\b(?:{_TITLES_M}|{_TITLES_F})\.? )\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?",
}

#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "latin_m": ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Nils", "Oscar", "Paul", "Simon"],
    "latin_f": ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Ida", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula", "Sara"],
    "greek_m": ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Λουκάς", "Νίκος", "Πέτρος", "Σπύρος"],
    "greek_f": ["Άννα", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία"],
    "cyrillic_m": ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Николай", "Павел"],
    "cyrillic_f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
}
SYLLABLES = {
    "latin": ["bar", "ben", "dor", "fal", "gar", "hol", "kin", "lan", "mor", "nel", "per", "ros", "sel", "tan", "vol", "wen"],
    "greek": ["αλ", "βα", "γο", "δη", "κα", "λα", "μα", "νι", "πα", "ρο", "σα", "τσι", "φι", "χα", "ψα", "ζο"],
    "cyrillic": ["бо", "ва", "го", "да", "зи", "ка", "ла", "ми", "но", "по", "ро", "са", "ти", "фе", "ха", "че"],
}

#: Titles in any of the patterns' languages, as one pattern for the whole search.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Text without one of these characters or words has no entity; a cheap test before the full search. Each pattern
#: needs one of them.
HINT = rf"[0-9@]|AKIA|ASIA|:[0-9A-Fa-f]{{0,4}}:|(?i:{_PASSWORDS}|{_TOKENS})|(?:{_TITLES_M}|{_TITLES_F})"


def entities(text: Column) -> Column:
    """All entities of a text, from left to right."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _mention(text: Column) -> Column:
    """As `entities`, each with the title before it (for gender)."""
    return F.regexp_extract_all(text, F.lit(rf"(?:(?:{_TITLES_F})\.? )(?:{PATTERNS['name']})"), F.lit(0))


def kind(value: Column) -> Column:
    """The first type whose pattern the whole value has; marked secrets are told by what is left."""
    out = F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for k in ("access_key", "iban", "ipv6", "ipv4", "card", "ssn", "phone"):
        out = out.when(value.rlike(f"^(?:{PATTERNS[k]})$"), k)
    out = out.when(value.rlike(r"^\p{Lu}[\p{L}'’-]+( \p{Lu}[\p{L}'’-]+)?$") & ~value.rlike("[0-9]"), "name")
    return out.otherwise("secret")


def _groups(value: Column) -> Column:
    """An IPv6 address with all eight groups of four digits."""
    sides = F.transform(F.split(value, "::", -1), lambda side: F.filter(F.split(side, ":"), lambda g: g != ""))
    left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), (8 - F.size(left) - F.size(right)).cast("int"))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")


def canonical(k: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(k == "email", F.lower(value))
        .when(k == "ipv6", _groups(F.lower(value)))
        .when(k == "phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))
        .when(k.isin("card", "ssn"), digits)
        .when(k == "iban", F.regexp_replace(value, " ", ""))
        .otherwise(value)
    )


def _stream(key: str, seed: Column, n: Column) -> Column:
    """At least `n` keyed bytes as hexadecimal text."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.floor(n / 32).cast("int")),
            lambda j: F.sha2(F.concat_ws("\x1f", F.lit(key), seed, j.cast("string")).cast("binary"), 256),
        ),
        "",
    )


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _exchanged(value: Column, stream: Column) -> Column:
    """Every ASCII letter and digit exchanged within its class."""
    classes = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"]

    def char(c: Column, b: Column) -> Column:
        out = F.when(F.lit(False), c)
        for letters in classes:
            new = F.substr(F.lit(letters), b % len(letters) + 1, F.lit(1))
            out = out.when(c.rlike(f"[{letters}]"), new)
        return out.otherwise(c)

    chars = F.split(value, "")
    return let(
        stream, lambda st: F.array_join(F.transform(chars, lambda c, i: char(c, _byte(st, i))), "")
    )


def _hexadecimal(value: Column, stream: Column) -> Column:
    """Every hexadecimal digit by any other; 0 by none, so that no group becomes one of zeros."""
    chars = F.split(value, "")
    return let(
        stream,
        lambda st: F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(c == ":", c).otherwise(F.substr(F.lit("123456789abcdef"), _byte(st, i) % 15 + 1, F.lit(1))),
            ),
            "",
        ),
    )


def _checked(digits: Column) -> Column:
    """The digits with the last one set so that the Luhn sum is a multiple of ten."""
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(body)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (F.length(body) - i) % 2 == 0,
            (2 * F.substr(body, i, F.lit(1)).cast("int")) % 10
            + F.floor(2 * F.substr(body, i, F.lit(1)).cast("int") / 10).cast("int"),
        ).otherwise(F.substr(body, i, F.lit(1)).cast("int")),
    )
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _pick(options: list[str], b: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (b % len(options) + 1).cast("int"))


def _name(value: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    script = (
        F.when(value.rlike(r"[Ͱ-Ͽ]"), "greek").when(value.rlike(r"[Ѐ-ӿ]"), "cyrillic").otherwise("latin")
    )

    def given(s):
        return F.when(gender == "f", _pick(GIVEN[f"{s}_f"], _byte(stream, F.lit(0)))).otherwise(
            _pick(GIVEN[f"{s}_m"], _byte(stream, F.lit(0)))
        )

    def family(s):
        return F.initcap(
            F.array_join(
                F.transform(
                    F.sequence(F.lit(1), F.lit(4) + F.floor(attempt / GROW).cast("int")),
                    lambda i: _pick(SYLLABLES[s], _byte(stream, i)),
                ),
                "",
            )
        )

    out = None
    for s in SYLLABLES:
        one = F.when(value.contains(" "), F.concat_ws(" ", given(s), family(s))).otherwise(family(s))
        out = F.when(script == s, one) if out is None else out.when(script == s, one)
    return out


def propose(k: Column, value: Column, gender: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of a canonical value for one attempt."""
    seed = F.concat_ws("\x1f", k, value, attempt.cast("string"))
    stream = _stream(key, seed, F.length(value) + 40)
    extra = F.greatest(attempt - GROW, F.lit(0))
    tail = F.when(extra > 0, F.substr(stream, F.lit(1), extra)).otherwise("")
    domain = F.substring_index(value, "@", -1)
    domain_stream = _stream(key, F.concat_ws("\x1f", F.lit("domain"), domain), F.lit(64))
    label = _exchanged(F.substring_index(domain, ".", 1), domain_stream)
    local = F.substring_index(value, "@", 1)
    mail = F.concat(
        _exchanged(local, stream),
        tail,
        F.lit("@"),
        label,
        F.lit(".example."),
        _pick(["com", "net", "org"], _byte(domain_stream, F.lit(60))),
    )
    at = F.length(value)
    octets = [_byte(stream, at + i) for i in range(4)]
    address = F.concat_ws(
        ".", (F.lit(240) + octets[0] % 15).cast("string"), *[o.cast("string") for o in octets[1:]]
    )
    swapped = _exchanged(value, stream)
    first = (F.lit(2) + _byte(stream, at) % 8).cast("string")
    number = F.concat(first, F.substr(swapped, F.lit(2)))
    # Groups of zeros stay, so that what was short can be; all groups change where that leaves too few addresses.
    groups = F.array_join(
        F.zip_with(
            F.split(value, ":"),
            F.split(_hexadecimal(value, stream), ":"),
            lambda a, b: F.when((a == "0000") & (attempt < GROW), a).otherwise(b),
        ),
        ":",
    )
    return (
        F.when(k == "email", mail)
        .when(k == "ipv4", address)
        .when(k == "ipv6", groups)
        .when(k == "card", _checked(F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(swapped, F.lit(2)))))
        .when(k.isin("phone", "ssn"), number)
        .when(k == "access_key", F.concat(F.substr(value, F.lit(1), F.lit(4)), F.substr(swapped, F.lit(5))))
        .when(k == "iban", F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(swapped, F.lit(3))))
        .when(k == "name", _name(value, gender, stream, attempt))
        .otherwise(F.concat(swapped, tail))
    )


def render(k: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the form of one mention: its punctuation, country code and case."""
    n = F.length(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))

    def char(i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^0-9]", ""))
        place = at - (digits - F.length(surrogate))
        return F.when(c.rlike("[0-9]") & (place >= 1), F.substr(surrogate, place, F.lit(1))).otherwise(c)

    short = F.regexp_replace(surrogate, "(?<![0-9a-f])0{1,3}(?=[0-9a-f])", "")
    short = F.when(value.contains("::"), F.regexp_replace(short, "^(.*?)(?:^|:)0(?::0)*(?::|$)", "$1::")).otherwise(short)
    address = F.when(value.rlike("::|(?:^|:)[^:]{1,3}(?::|$)"), short).otherwise(surrogate)
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), char), "")
    return (
        F.when(k.isin("phone", "card", "ssn"), spaced)
        .when(k == "ipv6", address)
        .when((k == "email") & (value == F.upper(value)), F.upper(surrogate))
        .when((k == "iban") & value.contains(" "), F.rtrim(F.regexp_replace(surrogate, "(.{4})", "$1 ")))
        .otherwise(surrogate)
    )


def surrogate_table(found: DataFrame, key: str = KEY) -> DataFrame:
    """`kind`, `form` (canonical), `surrogate` for the distinct entities `kind`, `form`, `gender`.

    Each round settles the proposals that clash with nothing; the few others try again.
    """
    real = materialise(found.groupBy("kind", "form").agg(F.min("gender").alias("gender")), "entities")
    pending, settled = real, None
    for attempt in range(MAX_ATTEMPTS):
        cand = pending.select(
            "kind",
            "form",
            "gender",
            propose(F.col("kind"), F.col("form"), F.col("gender"), F.lit(attempt), key).alias("surrogate"),
        )
        first = cand.groupBy("surrogate").agg(F.min(F.struct("kind", "form")).alias("first"))
        taken = real.select(F.col("form").alias("taken"))
        if settled is not None:
            taken = taken.unionByName(settled.select(F.col("surrogate").alias("taken")))
        free = (
            first.join(taken, F.col("surrogate") == F.col("taken"), "left_anti")
            .select(F.col("first.kind").alias("kind"), F.col("first.form").alias("form"))
        )
        marked = cand.join(free.withColumn("free", F.lit(True)), ["kind", "form"], "left")
        marked = materialise(marked, "proposals")
        good = marked.where("free").select("kind", "form", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        pending = marked.where("free IS NULL").select("kind", "form", "gender")
        if pending.isEmpty():
            return settled
    raise RuntimeError("no distinct surrogates found")


def replace_entities(docs: DataFrame, text: str = "text", key: str = KEY) -> tuple[DataFrame, str]:
    """`docs` with surrogates in `text` under a secret key of the caller's, and a column (its name is returned) with the number of mentions."""
    count = free_name(docs, "n_entities")
    row, ms, text_row, news = (free_name(docs, c) for c in ("__row", "__mentions", "__text", "__news"))
    th = F.xxhash64(text)
    marked = docs.withColumn(
        ms, F.when(F.col(text).rlike(HINT), entities(F.col(text))).otherwise(F.array().cast("array<string>"))
    )
    clean = marked.where(F.coalesce(F.size(ms), F.lit(0)) < 1).drop(ms).withColumn(count, F.lit(0).cast("long"))
    dirty = marked.where(F.size(ms) > 0).withColumn(row, th)

    women = F.transform(_mention(F.col(text)), lambda m: F.regexp_replace(m, rf"^(?:{_TITLES_F})\.? ", ""))
    seen = dirty.select(
        F.col(row).alias("row"),
        women.alias("women"),
        F.explode(F.array_distinct(ms)).alias("value"),
    ).select(
        "row",
        "value",
        kind(F.col("value")).alias("kind"),
        F.when(F.array_contains("women", F.col("value")), "f").otherwise("m").alias("gender"),
    )
    seen = materialise(
        seen.withColumn("form", canonical(F.col("kind"), F.col("value"))).distinct(), "mentions"
    )
    found = surrogate_table(seen.select("kind", "form", "gender"), key)
    per_text = (
        seen.join(found, ["kind", "form"])
        .select(
            "row",
            F.struct("value", render(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new")).alias("pair"),
        )
        .groupBy(F.col("row").alias(text_row))
        .agg(F.map_from_entries(F.collect_set("pair")).alias(news))
    )
    done = dirty.join(per_text, F.col(row) == F.col(text_row))
    parts = F.split(F.col(text), ANY, -1)
    rebuilt = F.array_join(
        F.zip_with(
            parts,
            F.transform(F.col(ms), lambda m: F.element_at(news, m)),
            lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))),
        ),
        "",
    )
    done = done.withColumn(count, F.size(ms).cast("long")).withColumn(text, rebuilt)
    return done.select(*docs.columns, count).unionByName(clean.select(*docs.columns, count)), count
