"""Personal data replaced by keyed surrogates of the same type, in DataFrame operations only.

Every detected entity gets a replacement drawn from a keyed digest of its type and value:
the same value gets the same surrogate everywhere. A surrogate keeps the format: letters
stay letters of their case, digits digits, separators stand where they stood, card
and account numbers keep their check digits right, names keep script and gender. No two values
share a surrogate and no surrogate is a value that occurs: such collisions are found over the
whole table and drawn again.

A name is found behind one of the titles below; its parts are then replaced wherever they stand
in the same text as whole words of that spelling. Not found are names without a title in
their text, mentions in other spellings (capitals), tokens without one of the key names or
prefixes, and values behind a key name of fewer than 6 characters or of symbols alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.cluster import broadcast_if_small, settle
from kindling.functions.text import evaluate_once

# --- fixed values: what personal data looks like ---------------------------------

FEMALE, MALE, ANY = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа|Κυρία", "Mr|Herr|Monsieur|Señor|Sr|господин|Κύριος", "Dr|Prof"
_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"
# A secret's value ends at the quote that closes it, or else at white space, less the punctuation there.
_CLOSING = r"[.,;:!?\"')\]}>]"
_BEHIND_KEY = r"(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}%s)"
_SECRET = (
    rf"(?:{_BEHIND_KEY % chr(34)}(?=[^\"\r\n]*[\p{{L}}\p{{N}}])[^\s\"][^\"\r\n]{{5,}}(?=\")"
    rf"|{_BEHIND_KEY % chr(39)}(?=[^'\r\n]*[\p{{L}}\p{{N}}])[^\s'][^'\r\n]{{5,}}(?=')"
    rf"|{_BEHIND_KEY % '[\"\']?'}(?=[^\s\p{{Z}}]*[\p{{L}}\p{{N}}])[^\s\p{{Z}}\"'][^\s\p{{Z}}]{{4,}}(?!{_CLOSING})[^\s\p{{Z}}])"
)
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "access": r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{19,}[A-Za-z0-9])(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?:{FEMALE}|{MALE}|{ANY})\.?[  ]{_NAME}(?:[  ]{_NAME})?(?![\p{{L}}])",
}
# Types that may hold spaces: a value of these is no secret that ends at its first space.
_SPACED = "|".join(PATTERNS[k] for k in ("iban", "phone", "card", "name"))
PATTERNS = {"secret": rf"(?<=[=:]\s{{0,3}}[\"']?)(?!(?:{_SPACED}){_CLOSING}*(?:\s|\z)){_SECRET}", **PATTERNS}
# One pattern of all types; an entity never starts inside a word or number.
_TITLED = r"(?<![\p{L}\p{N}_])" + PATTERNS["name"]
ENTITY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(PATTERNS.values()) + ")"

# Syllables of made-up names by script, and endings by gender.
SYLLABLES = {
    "latin": ["ba", "be", "ci", "do", "fa", "ga", "ka", "le", "li", "lo", "ma", "me", "na", "ni", "ra", "re", "ro", "sa", "ta", "ve"],
    "cyrillic": ["ба", "бе", "ви", "го", "да", "за", "ка", "ле", "ли", "ло", "ма", "ме", "на", "ни", "ра", "ре", "ро", "са", "та", "ве"],
    "greek": ["βα", "βε", "γι", "δο", "ζα", "θα", "κα", "λε", "λι", "λο", "μα", "με", "να", "νι", "ρα", "ρε", "ρο", "σα", "τα", "βι"],
}
ENDINGS = {
    "latin": {"female": ["na", "lia", "ra", "sa"], "male": ["n", "ro", "s", "do"], "any": ["l", "x"], "surname": ["son", "ner", "mann", "vel"]},
    "cyrillic": {"female": ["на", "лия", "ра", "са"], "male": ["н", "р", "с", "д"], "any": ["ль"], "surname": ["ев", "ин", "ко", "ский"]},
    "greek": {"female": ["να", "λια", "ρα", "σα"], "male": ["νος", "ρος", "σης"], "any": ["λις"], "surname": ["δης", "κος", "λας"]},
}
# -----------------------------------------------------------------------------------

# Draws of a value that keep its length. Later ones come from a wider space: an address of octets
# of any length, else one more syllable, letter or digit for every further draw.
WIDEN_AFTER = 6
# Draws after which the run fails: wider spaces are never full by then.
LAST_DRAW = 64


def _kind(value: Column) -> Column:
    """The type of a matched entity: the first of the patterns, in their order, that fits it whole."""
    out = F.when(value.rlike(_NAME_PARTS), "name").otherwise("secret")
    for kind in reversed([k for k in PATTERNS if k not in ("name", "secret")]):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _bytes(seed: Column, length: Column) -> Column:
    """Digests of ``seed`` in hex, each of 32 bytes, with at least one byte for each of ``length`` characters."""
    return F.transform(F.sequence(F.lit(0), F.ceil(length / 32).cast("int")), lambda k: F.sha2(F.concat(seed, k.cast("string")), 256))


def _draw(digest: Column, i: Column, n: int | Column) -> Column:
    """A number below n from the i-th byte of digests."""
    block = F.get(digest, F.floor(i / 32).cast("int"))
    return (F.conv(F.substring(block, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") % n).cast("int")


def _pick(choices: Column, at: Column) -> Column:
    return F.substring(choices, at + 1, F.lit(1))


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC, _GREEK = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _reshape(value: Column, seed: Column) -> Column:
    """Each letter and digit replaced by one of its own kind; lower hex strings stay hex.

    Letters of other scripts than Latin, Cyrillic and Greek become Latin ones.
    """
    is_hex = value.rlike("^[0-9a-f]*$") & value.rlike("[0-9]") & value.rlike("[a-f]")

    def with_digest(known: Column) -> Column:
        digest = known["digest"]

        def char(c: Column, i: Column) -> Column:
            def cased(choices: str) -> Column:
                return F.when(c.rlike(r"\p{Lu}"), choices.upper()).otherwise(choices)

            choices = (
                F.when(known["is_hex"], "0123456789abcdef")
                .when(c.rlike("[a-z]"), _LOWER)
                .when(c.rlike("[A-Z]"), _LOWER.upper())
                .when(c.rlike(r"\p{N}"), _DIGITS)
                .when(c.rlike(r"[\x00-\x7f]"), "")
                .when(c.rlike(r"\p{IsCyrillic}"), cased(_CYRILLIC))
                .when(c.rlike(r"\p{IsGreek}"), cased(_GREEK))
                .when(c.rlike(r"\p{L}"), cased(_LOWER))
                .otherwise("")
            )
            return evaluate_once(choices, lambda own: F.when(own == "", c).otherwise(_pick(own, _draw(digest, i, F.length(own)))))

        return F.array_join(F.transform(F.split(value, ""), char), "")

    known = F.struct(_bytes(seed, F.length(value)).alias("digest"), is_hex.alias("is_hex"))
    return F.when(F.length(value) > 0, evaluate_once(known, with_digest)).otherwise(value)


def _luhn(payload: Column) -> Column:
    """The check digit that follows a payload's digits."""
    digits = F.reverse(F.split(F.regexp_replace(payload, r"\D", ""), ""))
    digits = F.filter(digits, lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return ((10 - total % 10) % 10).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an account number."""
    moved = F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00"))
    codes = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int")))
    rest = F.aggregate(codes, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _made_up_name(value: Column, seed: Column, role: Column, extra: Column) -> Column:
    def with_digest(digest: Column) -> Column:
        def one(script: str) -> Column:
            syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
            stem = F.concat(*[F.get(syllables, _draw(digest, F.lit(k), len(SYLLABLES[script]))) for k in range(3)])
            more = F.transform(F.sequence(F.lit(1), extra), lambda k: F.get(syllables, _draw(digest, k + 4, len(SYLLABLES[script]))))
            stem = F.when(extra > 0, F.concat(stem, F.array_join(more, ""))).otherwise(stem)
            longer = F.concat(stem, F.get(syllables, _draw(digest, F.lit(3), len(SYLLABLES[script]))))
            ending = F.lit("")
            for name, choices in ENDINGS[script].items():
                ending = F.when(role == name, F.get(F.array(*[F.lit(c) for c in choices]), _draw(digest, F.lit(4), len(choices)))).otherwise(ending)
            return F.concat(F.when(role == "surname", longer).otherwise(stem), ending)

        name = F.when(value.rlike(r"\p{IsCyrillic}"), one("cyrillic")).when(value.rlike(r"\p{IsGreek}"), one("greek")).otherwise(one("latin"))
        return F.when(value == F.upper(value), F.upper(name)).otherwise(F.initcap(name))

    return evaluate_once(_bytes(seed, extra + 8), with_digest)


def _seed(key: str, label: Column, of: Column, attempt: Column) -> Column:
    # A digest stands for a long value, which would be hashed anew for every 32 of its characters.
    of = F.when(F.length(of) > 256, F.sha2(of, 256)).otherwise(of)
    return F.concat_ws("\u0001", F.lit(key), label, of, attempt.cast("string"))


def _surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The replacement of one part: ``kind`` is a type, or for parts of names their role."""
    own = _seed(key, kind, value, attempt)
    extra = F.greatest(attempt - (WIDEN_AFTER - 1), F.lit(0))

    def longer(part: Column) -> Column:
        """A part with its last letter or digit repeated ``extra`` times."""
        last = F.regexp_extract(part, r"([A-Za-z0-9])[^A-Za-z0-9]*$", 1)
        return F.when(extra > 0, F.concat(part, F.repeat(F.when(last == "", "a").otherwise(last), extra))).otherwise(part)

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    tail = F.regexp_extract(domain, r"(?i)((?:(?:^|\.)example)?\.[a-z]+)$", 1)
    head = F.length(domain) - F.length(tail)
    host = F.substring(domain, F.lit(1), head)
    # A domain keeps its surrogate in all addresses, whatever else is drawn again.
    new_host = _reshape(host, F.concat_ws("\u0001", F.lit(key), F.lit("domain"), F.lower(domain)))
    email = F.concat(_reshape(longer(local), own), F.lit("@"), new_host, tail)

    def octets(digest: Column) -> Column:
        def octet(o: Column, i: Column) -> Column:
            two = _draw(digest, i * 2, 256) * 256 + _draw(digest, i * 2 + 1, 256)
            return F.when(extra > 0, two % 256).when(F.length(o) == 1, two % 9 + 1).when(F.length(o) == 2, two % 90 + 10).otherwise(two % 155 + 100).cast("string")

        return F.array_join(F.transform(F.split(value, r"\."), octet), ".")

    ip = evaluate_once(_bytes(own, F.lit(32)), octets)
    country_code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|)", 1)
    phone = F.concat(country_code, _reshape(longer(F.substring(value, F.length(country_code) + 1, F.length(value))), own))

    payload = F.substring(value, F.lit(1), F.length(value) - 1)
    valid = _luhn(payload) == F.substring(value, F.length(value), F.lit(1))
    new_payload = F.concat(F.substring(payload, 1, 1), _reshape(longer(F.substring(payload, F.lit(2), F.length(payload))), own))
    card = F.when(valid, evaluate_once(new_payload, lambda p: F.concat(p, _luhn(p)))).otherwise(_reshape(longer(value), own))

    country, account = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    iban = evaluate_once(_reshape(longer(account), own), lambda a: F.concat(country, _iban_check(country, a), a))

    prefix = F.regexp_extract(value, r"^(AKIA|ASIA|gh[pousr]_|sk-(?:proj-)?)", 1)
    access = F.concat(prefix, _reshape(longer(F.substring(value, F.length(prefix) + 1, F.length(value))), own))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
        .when(kind == "iban", iban).when(kind == "access", access).when(kind.isin("secret", "ssn"), _reshape(longer(value), own))
        .otherwise(_made_up_name(value, own, kind, extra))
    )


_NAME_PARTS = rf"^((?:{FEMALE}|{MALE}|{ANY})\.?[  ])({_NAME})(?:([  ])({_NAME}))?$"


def _parts(entity: Column) -> Column:
    """What of an entity is replaced: struct(kind, value) of the whole, or of each name after the title."""

    def of(kind: Column) -> Column:
        first, second = F.regexp_extract(entity, _NAME_PARTS, 2), F.regexp_extract(entity, _NAME_PARTS, 4)
        role = F.when(entity.rlike(rf"^(?:{FEMALE})\.?[  ]"), "female").when(entity.rlike(rf"^(?:{MALE})\.?[  ]"), "male").otherwise("any")
        one = F.array(F.struct(F.lit("surname").alias("kind"), first.alias("value")))
        two = F.array(F.struct(role.alias("kind"), first.alias("value")), F.struct(F.lit("surname").alias("kind"), second.alias("value")))
        return F.when(kind != "name", F.array(F.struct(kind.alias("kind"), entity.alias("value")))).when(second == "", one).otherwise(two)

    return evaluate_once(_kind(entity), of)


def _entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def _names(text: Column) -> Column:
    """The parts of all names found in a text, in its order."""
    return F.flatten(F.transform(F.filter(_entities(text), lambda e: e.rlike(_NAME_PARTS)), _parts))


def _bare(names: Column) -> Column:
    """The pattern of whole words that are one of ``names``, longer ones before their beginnings."""
    words = F.array_join(F.reverse(F.array_sort(F.array_distinct(names["value"]))), "|")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), words, F.lit(r")(?![\p{L}\p{N}_])"))


def _n_bare(text: Column) -> Column:
    """How many words outside of entities mention a name that is found in the text."""
    found = F.struct(_bare(_names(text)).alias("bare"), F.split(text, ENTITY, -1).alias("gaps"))
    count = evaluate_once(found, lambda f: F.aggregate(f["gaps"], F.lit(0), lambda n, g: n + F.size(F.regexp_extract_all(g, f["bare"], F.lit(0)))))
    return F.when(text.rlike(_TITLED), count).otherwise(0)


def _rewritten(key: str, text: Column, redrawn: Column | None) -> Column:
    """The text with every entity and bare mention replaced; ``redrawn`` maps kind and value to a later draw."""

    def replacement(entity: Column) -> Column:
        def part(p: Column) -> Column:
            first = _surrogate(key, p["kind"], p["value"], F.lit(0))
            return first if redrawn is None else F.coalesce(F.try_element_at(redrawn, F.concat_ws("\u0001", p["kind"], p["value"])), first)

        title, gap = F.regexp_extract(entity, _NAME_PARTS, 1), F.regexp_extract(entity, _NAME_PARTS, 3)
        return F.concat(title, F.call_function("array_join", F.transform(_parts(entity), part), gap))

    def name(p: Column) -> Column:
        first = _made_up_name(p["value"], _seed(key, p["kind"], p["value"], F.lit(0)), p["kind"], F.lit(0))
        return first if redrawn is None else F.coalesce(F.try_element_at(redrawn, F.concat_ws("\u0001", p["kind"], p["value"])), first)

    def mentions(names: Column) -> Column:
        """What a gap of the text becomes needs: the names, their surrogates and their pattern."""
        return F.struct(names["value"].alias("of"), F.transform(names, name).alias("new"), _bare(names).alias("bare"))

    def with_mentions(gap: Column, known: Column) -> Column:
        words = F.regexp_extract_all(gap, known["bare"], F.lit(0))
        new = F.transform(words, lambda w: F.get(known["new"], F.array_position(known["of"], w).cast("int") - 1))
        around = F.split(gap, known["bare"], -1)
        return evaluate_once(new, lambda found: F.array_join(F.transform(around, lambda g, i: F.concat(g, F.coalesce(F.get(found, i), F.lit("")))), ""))

    def joined(new: Column) -> Column:
        gaps = F.split(text, ENTITY, -1)
        known = evaluate_once(_names(text), mentions)
        replaced = evaluate_once(known, lambda k: F.transform(gaps, lambda g: with_mentions(g, k)))
        gaps = F.when(text.rlike(_TITLED), replaced).otherwise(gaps)
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.lit("")))), "")

    return evaluate_once(F.transform(_entities(text), replacement), joined)


def _settled_draws(key: str, parts: DataFrame) -> DataFrame:
    """(kind, value, attempt, surrogate) of all different parts, without collisions."""
    draws = parts.select("kind", "value", F.lit(0).alias("attempt"))
    draws = settle(draws.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))), "draws")
    values = draws.select(F.col("value").alias("surrogate")).distinct()
    for _ in range(LAST_DRAW):
        # Of several parts with one surrogate, the least keeps it. A value in the table is never a surrogate.
        several = draws.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("keeps"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        twice = draws.join(several, "surrogate").filter(F.struct("kind", "value") != F.col("keeps")).select("kind", "value", "attempt")
        used = draws.join(values, "surrogate", "left_semi").select("kind", "value", "attempt")
        again = settle(twice.unionByName(used).distinct(), "redrawn")
        if not again.limit(1).count():
            return draws
        later = again.select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        later = later.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("value"), F.col("attempt")))
        draws = settle(draws.join(again, ["kind", "value"], "left_anti").unionByName(later), "draws")
    raise RuntimeError(f"no free surrogates after {LAST_DRAW} draws")


def replace_personal_data(docs: DataFrame, secret: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in its texts replaced; adds n_entities.

    Every row stays. Null and empty texts stay as they are with 0 entities; an input column
    named n_entities is replaced. The same ``secret`` and table give the same surrogates.
    Null keys are treated like any other, unless a collision had to be drawn again in a row of
    that key, where the earlier draw stays. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c != "n_entities"]
    text = F.col(f"`{text_col}`")
    seen = docs.filter(text.rlike(ENTITY)).select(F.col(f"`{key}`").alias("__of"), F.explode(_entities(text)).alias("__entity"))
    seen = seen.select("__of", F.explode(_parts(F.col("__entity"))).alias("__part")).select("__of", "__part.kind", "__part.value")
    draws = _settled_draws(secret, seen.select("kind", "value").distinct())
    redrawn = draws.filter("attempt > 0").select("kind", "value", "surrogate")
    later = None
    if redrawn.limit(1).count():
        entry = F.struct(F.concat_ws("\u0001", "kind", "value"), "surrogate")
        changed = seen.join(redrawn, ["kind", "value"]).groupBy("__of").agg(F.map_from_entries(F.collect_set(entry)).alias("__later"))
        changed = settle(changed, "later-draws")
        docs = docs.join(broadcast_if_small(changed), docs[key] == changed["__of"], "left").drop("__of")
        later = F.col("__later")
    n = F.coalesce(F.size(F.when(text.isNotNull(), _entities(text))), F.lit(0))
    counted = docs.withColumn("__n", F.when(text.isNull(), 0).otherwise(n + _n_bare(text)))
    new = F.when(F.col("__n") > 0, _rewritten(secret, text, later)).otherwise(text)
    columns = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in own]
    return counted.select(*columns, F.col("__n").alias("n_entities"))
