"""Replacement of personal data by keyed, consistent surrogates, in DataFrame functions only.

Every mention is found with one pattern; a mention names an entity (its type
and its value without spelling differences), and an entity gets one surrogate
for the whole corpus, derived from a secret key. A surrogate has the type, the
format and the script of what it replaces: digits stay digits in the same
places, hexadecimal strings keep their length and case, card numbers and IBANs
their length and check digits, names their title's gender and their script. Two
entities never share a surrogate and no surrogate is an entity of the corpus:
those that would are drawn again.

A name is found by its title, however many words, hyphens, initials and particles
it has. Each of its words is an entity, so a full name, a shortened one and one
without a title have the words of their surrogates alike: what a title introduced
in a text is replaced wherever else that text has one of its words. Initials move
along their alphabet by a keyed step; particles stay.

Entities are aggregated by task before they are shuffled, so a value that
stands in a third of all texts is one row a task. Texts meet their surrogates
by text, and only texts with a mention are moved.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Titles by gender, and syllables of made-up names by script.
_MALE = ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Signor", "Господин", "г-н", "Κύριος"]
_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "Госпожа", "г-жа", "Κυρία"]
_NEUTRAL = ["Mx", "Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор", "Δρ"]
_PARTICLES = ["de", "del", "della", "der", "den", "di", "da", "das", "dos", "du", "la", "le", "van", "von", "zu", "zur", "ten", "ter", "bin", "ibn", "al", "el", "y"]
_ALPHABETS = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
_SYLLABLES = {
    "latin": ["ba", "do", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "vi", "ze", "fa", "go", "hu", "jo"],
    "cyrillic": ["ба", "до", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ви", "зе", "фа", "го", "ху", "жо"],
    "greek": ["βα", "δο", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βι", "ζε", "φα", "γο", "θυ", "ξο"],
}
_ENDINGS = {
    ("latin", "f"): "na", ("latin", "m"): "ron", ("cyrillic", "f"): "на", ("cyrillic", "m"): "рон",
    ("greek", "f"): "να", ("greek", "m"): "ρων", ("latin", "n"): "len", ("cyrillic", "n"): "лен", ("greek", "n"): "λεν",
}


def _either(titles: list[str]) -> str:
    return "|".join(sorted((t.replace("-", "\\-") for t in titles), key=len, reverse=True))


_TITLES = _either(_MALE + _FEMALE + _NEUTRAL)
# A word of a name begins with a capital: inner capitals and O'Neil count, the 's of a genitive does not.
_WORD = r"\p{Lu}(?:['’]\p{Lu}|[\p{L}\p{M}])++"
_INITIAL = r"\p{Lu}\."
_NAME = rf"(?:{_INITIAL}[ -]?)*(?:(?:{'|'.join(_PARTICLES)}) )*{_WORD}(?:(?: |-| (?:(?:{'|'.join(_PARTICLES)}) )+)(?:{_WORD}|{_INITIAL}))*"
_TITLED = rf"(?<![\p{{L}}\p{{N}}_])(?:{_TITLES})\.? "
#: The groups tell the type; the order decides where two could begin.
TYPES = ["email", "ip", "phone", "card", "ssn", "iban", "secret", "name"]
_PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?!\d|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|gho|xox[abp])[_-][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}"
    r"|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})(?!\w)",
    "name": _TITLED + _NAME,
}
PATTERN = "|".join(f"(?:{_PATTERNS[t]})" for t in TYPES)
HEX = "0123456789abcdef"


def may_mention(text: Column) -> Column:
    """Whether a text holds what every mention does; false for all others, which are not searched.

    A digit, an at sign, hexadecimal letters, a title or the start of a key: plain
    searches, many times as fast as the pattern.
    """
    starts = [*_MALE, *_FEMALE, *_NEUTRAL, "sk-", "sk_", "pk-", "pk_", "gho", "ghp", "xox", "AKIA", "eyJ"]
    found = text.rlike("[0-9@]|[a-f]{32}|[A-F]{32}")
    for start in starts:
        found = found | text.contains(start)
    return F.coalesce(found, F.lit(False))


def _type(mention: Column) -> Column:
    """The first type whose pattern is the whole mention."""
    found = F.lit(None).cast("string")
    for t in reversed(TYPES):
        bare = _PATTERNS[t]
        found = F.when(mention.rlike(rf"^(?:{bare})$"), F.lit(t)).otherwise(found)
    return found


def _name_words(mention: Column) -> Column:
    """The words of a titled name that are replaced."""
    return F.regexp_extract_all(F.regexp_replace(mention, rf"^{_TITLED}", ""), F.lit(f"({_WORD})"), F.lit(1))


def _entities(kind: Column, mention: Column) -> Column:
    """What two mentions of one entity have alike, whatever their spelling: one for a mention, one a word for a name."""
    gender = F.when(mention.rlike(rf"^(?:{_either(_FEMALE)})\.? "), "f:").when(mention.rlike(rf"^(?:{_either(_NEUTRAL)})\.? "), "n:").otherwise("m:")
    words = F.transform(_name_words(mention), lambda w: F.concat(gender, F.lower(w)))
    return F.when(kind == "name", words).otherwise(F.array(_entity(kind, mention)))


def _entity(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", F.when(mention.rlike("^[0-9A-Fa-f]+$"), F.lower(mention)).otherwise(mention))
        .otherwise(mention)
    )


def _noise(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """64 hexadecimal digits that follow from the key, the entity and the attempt."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, entity, attempt.cast("string")), 256)


def _digit(noise: Column, k: Column) -> Column:
    """The k-th (from 0) pseudo-random decimal digit of ``noise``."""
    block = F.sha2(F.concat(noise, F.floor(k / 16).cast("string")), 256)
    two = F.substring(block, (F.pmod(k, F.lit(16)) * 4 + 1).cast("int"), F.lit(4))
    return F.pmod(F.conv(two, 16, 10).cast("long"), F.lit(10)).cast("string")


def _letters(noise: Column, count: Column, alphabet: str) -> Column:
    """``count`` characters of ``alphabet``, a power of two long up to 256."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((count - 1) / 32)).cast("int")), lambda j: F.sha2(F.concat(noise, F.lit("l"), j.cast("string")), 256))
    stream = F.array_join(blocks, "")
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1).cast("int"))
    pick = lambda k: F.substring(F.lit(alphabet), (F.pmod(F.conv(F.substring(stream, k * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.when(count > 0, F.array_join(F.transform(places, pick), "")).otherwise("")


def _digits(noise: Column, count: Column) -> Column:
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1).cast("int"))
    return F.when(count > 0, F.array_join(F.transform(places, lambda k: _digit(noise, k)), "")).otherwise("")


def _checked(body: Column) -> Column:
    """``body`` and the Luhn check digit that makes it a card number."""
    n = F.length(body)
    places = F.sequence(F.lit(1), n)

    def value(k: Column) -> Column:
        d = F.substring(body, k, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(n - k, F.lit(2)) == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _iban(country: Column, account: Column) -> Column:
    """The account number of that country with the check digits that make it valid."""

    def take(rest: Column, c: Column) -> Column:  # a letter stands for two digits, from A = 10
        digit = c.rlike("[0-9]")
        value = F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(rest * F.when(digit, 10).otherwise(100) + value, F.lit(97))

    rest = F.aggregate(F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != ""), F.lit(0), take)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(noise: Column, entity: Column, attempt: Column) -> Column:
    """A made-up word of a name, as ``gender:word`` in lower case; longer from the third draw on."""
    script, gender = _script(F.substring(entity, 3, 1 << 30)), F.substring(entity, 1, 1)
    parts, ending = F.lit(" ".join(_SYLLABLES["latin"])), F.lit("")
    for name in ("cyrillic", "greek"):
        parts = F.when(script == name, " ".join(_SYLLABLES[name])).otherwise(parts)
    for (name, sex), last in _ENDINGS.items():
        ending = F.when((script == name) & (gender == sex), last).otherwise(ending)
    digits = F.split(F.when(attempt > 1, F.concat(F.substring(noise, 20, 4), F.substring(noise, 1, 3))).otherwise(F.substring(noise, 1, 3)), "")
    word = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.element_at(F.split(parts, " "), F.conv(d, 16, 10).cast("int") + 1))
    return F.concat(gender, F.lit(":"), F.array_join(word, ""), ending)


def _surrogate(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """The entity that takes the place of ``entity`` at this attempt."""
    noise = _noise(key, kind, entity, attempt)
    octet = lambda k, low, span: (F.pmod(F.conv(F.substring(noise, k, 4), 16, 10).cast("long"), F.lit(span)) + low).cast("string")
    n = F.length(entity)
    local = F.concat(F.lit("u"), _letters(noise, F.lit(10), "abcdefghijklmnop"))
    return (
        F.when(kind == "email", F.concat(local, F.lit("@"), F.substring(noise, 40, 6), F.lit(".example.net")))
        .when(kind == "ip", F.concat_ws(".", octet(1, 1, 223), octet(5, 0, 256), octet(9, 0, 256), octet(13, 1, 254)))
        .when(kind == "card", _checked(_digits(noise, n - 1)))
        .when(kind.isin("phone", "ssn"), _digits(noise, n))
        .when(kind == "iban", _iban(F.substring(entity, 1, 2), _shaped(noise, F.substring(entity, 5, 40))))
        .when((kind == "secret") & entity.rlike("^[0-9a-f]+$"), _letters(noise, n, HEX))
        .when(kind == "secret", F.concat(_lead(entity), _shaped(noise, F.regexp_replace(entity, _LEAD, ""))))
        .otherwise(_name(noise, entity, attempt))
    )


_LEAD = "^(?:(?:sk|pk|ghp|gho|xox[abp])[_-]|AKIA|eyJ)"


def _lead(entity: Column) -> Column:
    return F.regexp_extract(entity, f"({_LEAD})", 1)


def _shaped(noise: Column, value: Column) -> Column:
    """Letters for letters in the same case and digits for digits; other characters stay."""
    lower, upper = F.lit("abcdefghijklmnop"), F.lit("ABCDEFGHIJKLMNOP")
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(value) - 1))

    def one(k: Column) -> Column:
        c = F.substring(value, k + 1, F.lit(1))
        at = (F.conv(F.substring(F.sha2(F.concat(noise, k.cast("string")), 256), 1, 1), 16, 10).cast("int") + 1)
        return (
            F.when(c.rlike("[0-9]"), _digit(noise, k))
            .when(c.rlike("[a-z]"), F.substring(lower, at, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(upper, at, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(places, one), "")


def _capital(word: Column, surrogate: Column) -> Column:
    """The surrogate of a word in its case."""
    loud = (word == F.upper(word)) & (F.length(word) > 1)
    return F.when(loud, F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))


def _initials(key: str, text: Column) -> Column:
    """Every initial moved along its alphabet, by the same step, never none."""
    step = int(hashlib.sha256(f"{key}\u0001initials".encode()).hexdigest(), 16)
    out = text
    for letters in _ALPHABETS.values():
        k = 1 + step % (len(letters) - 1)
        out = F.translate(out, letters, letters[k:] + letters[:k])
    return out


def _titled(key: str, mention: Column, words: Column) -> Column:
    """A titled name with the surrogates of its words in their places; title, particles and hyphens stay."""
    title = F.regexp_extract(mention, rf"^({_TITLED})", 1)
    rests = F.transform(F.split(F.regexp_replace(mention, rf"^{_TITLED}", ""), _WORD, -1), lambda r: _initials(key, r))
    return F.concat(title, F.array_join(F.zip_with(rests, words, lambda r, w: F.concat(r, F.coalesce(w, F.lit("")))), ""))


def _spelled(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention; of a name see ``_titled``."""
    digit = r"[0-9]"
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def fill(s: Column, c: Column) -> Column:
        hit = c.rlike(digit)
        taken = F.when(hit, F.substring(surrogate, s["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], taken).alias("out"), (s["at"] + hit.cast("int")).alias("at"))

    placed = F.aggregate(chars, state, fill, lambda s: s["out"])
    spaced = F.when(mention.contains(" "), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    return (
        F.when(kind.isin("phone", "card", "ssn"), placed)
        .when(kind == "iban", spaced)
        .when((kind == "secret") & mention.rlike("^[0-9A-F]+$") & ~mention.rlike("^[0-9]+$"), F.upper(surrogate))
        .when((kind == "email") & (mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate))
        .otherwise(surrogate)
    )


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """(``kind``, ``entity``, ``surrogate``) for distinct entities (``kind``, ``entity``).

    Surrogates are drawn; of those that meet, or that are entities of the
    corpus themselves, the smallest entity keeps an own one and the others
    draw again, until all differ.
    """
    held = stored(entities.withColumn("attempt", F.lit(0)), "entities")
    known = held.select("kind", F.col("entity").alias("surrogate")).withColumn("real", F.lit(True))
    while True:
        drawn = held.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("entity"), F.col("attempt")))
        drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "entity")))
        drawn = stored(drawn.join(known, ["kind", "surrogate"], "left"), "surrogates")
        again = (F.col("nth") > 1) | F.coalesce("real", F.lit(False))
        if drawn.filter(again).isEmpty():
            return drawn.select("kind", "entity", "surrogate")
        held = stored(drawn.select("kind", "entity", (F.col("attempt") + again.cast("int")).alias("attempt")), "entities")


_BARE = rf"(?<![\p{{L}}\p{{N}}_]){_WORD}(?![\p{{L}}\p{{N}}_])"


def _bare(gap: Column, names: Column) -> Column:
    """A gap between mentions with the words of ``names`` replaced, and how many there are."""
    tokens = F.regexp_extract_all(gap, F.lit(f"({_BARE})"), F.lit(1))
    found = F.transform(tokens, lambda w: F.struct(w.alias("w"), F.element_at(names, F.lower(w)).alias("s")))
    texts = F.transform(found, lambda f: F.when(f["s"].isNull(), f["w"]).otherwise(_capital(f["w"], f["s"])))
    glued = F.array_join(F.zip_with(F.split(gap, _BARE, -1), texts, lambda rest, w: F.concat(rest, F.coalesce(w, F.lit("")))), "")
    return F.struct(glued.alias("s"), F.size(F.filter(found, lambda f: f["s"].isNotNull())).alias("n"))


def with_surrogates(df: DataFrame, key: str, text: str = "text", counted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with its texts rewritten, and the surrogates used.

    The first frame has all columns and rows of ``df``; only ``text`` changes, and
    ``counted``, if named, is added: the number of mentions replaced, 0 for a null text.
    Null and empty texts and texts without a mention stay as they are; repeated
    texts are rewritten alike, under whatever other columns. Where titles of several
    genders introduce one word in a text, its mentions without a title go with the
    first of f, m and n (no gender). The second frame
    is (``kind``, ``entity``, ``surrogate``): it undoes the replacement, so keep
    it as safe as the key.
    """
    found = F.regexp_extract_all(F.col("text"), F.lit(f"({PATTERN})"), F.lit(1))
    texts = df.select(df[text].cast("string").alias("text")).filter(may_mention(F.col("text")))
    texts = texts.select(F.sha2("text", 256).alias("__key"), found.alias("mentions")).filter(F.size("mentions") > 0)
    listed = texts.select("__key", F.posexplode("mentions").alias("nth", "mention")).distinct()
    listed = stored(listed, "listed")
    mentions = listed.select("mention").distinct().withColumn("kind", _type(F.col("mention"))).filter("kind is not null")
    mentions = mentions.select("mention", "kind", F.posexplode(_entities(F.col("kind"), F.col("mention"))).alias("at", "entity"))
    mentions = stored(mentions, "mentions")
    used = surrogate_map(mentions.select("kind", "entity").distinct(), key)
    part = F.struct("at", "entity", "surrogate")
    spelled = mentions.join(used, ["kind", "entity"]).groupBy("mention", "kind").agg(F.sort_array(F.collect_list(part)).alias("p"))
    words = F.zip_with(_name_words(F.col("mention")), "p", lambda w, p: _capital(w, F.substring(p["surrogate"], 3, 1 << 30)))
    names = F.transform("p", lambda p: F.struct(F.substring(p["entity"], 3, 1 << 30).alias("w"), p["surrogate"].alias("s")))
    spelled = spelled.select(
        "mention",
        F.when(F.col("kind") == "name", _titled(key, F.col("mention"), words))
        .otherwise(_spelled(F.col("kind"), F.col("mention"), F.col("p")[0]["surrogate"])).alias("spelled"),
        F.when(F.col("kind") == "name", names).alias("names"),
    )
    replaced = listed.join(spelled, "mention", "left").select(
        "__key", "names", F.struct("nth", F.coalesce("spelled", "mention").alias("s")).alias("r")
    )
    replaced = replaced.groupBy("__key").agg(
        F.transform(F.sort_array(F.collect_list("r")), lambda r: r["s"]).alias("__new"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("names"))), asc=False).alias("__names"),
    )
    # from the last to the first of equal words, so that the first gender is the one that stays
    last = F.aggregate("__names", F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(
        F.map_filter(m, lambda w, _: w != p["w"]), F.create_map(p["w"], F.substring(p["s"], 3, 1 << 30))))
    replaced = stored(replaced.select("__key", "__new", F.when(F.size("__names") > 0, last).alias("__names")), "replaced")
    whole = df[text].cast("string")
    columns = [*df.columns, counted] if counted else df.columns
    keyed = df.withColumn("__key", F.when(may_mention(whole), F.sha2(whole, 256)))
    plain = keyed.filter(F.col("__key").isNull())
    joined = keyed.filter(F.col("__key").isNotNull()).join(replaced, "__key", "left")
    gaps = F.split(F.col(text), PATTERN, -1)
    kept = F.transform(gaps, lambda gap: F.struct(gap.alias("s"), F.lit(0).alias("n")))
    joined = joined.withColumn("__gaps", F.when(F.col("__names").isNull(), kept).otherwise(F.transform(gaps, lambda gap: _bare(gap, F.col("__names")))))
    glued = F.array_join(F.zip_with("__gaps", "__new", lambda gap, new: F.concat(gap["s"], F.coalesce(new, F.lit("")))), "")
    joined = joined.withColumn(text, F.when(F.col("__new").isNull(), F.col(text)).otherwise(glued))
    if counted:
        plain = plain.withColumn(counted, F.lit(0))
        bare = F.aggregate("__gaps", F.lit(0), lambda a, gap: a + gap["n"])
        joined = joined.withColumn(counted, F.when(F.col("__new").isNull(), 0).otherwise(F.size("__new") + bare))
    return plain.select(*columns).unionByName(joined.select(*columns)), used
