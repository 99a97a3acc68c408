"""Personal data replaced by surrogates of its kind, in DataFrame functions only.

Emails, IPv4 addresses, phone, card and social security numbers, keys, tokens and names after a title
are found in the text. Each entity is named by its canonical form (letters lower-cased, numbers without
their signs but the + of a phone number), and a keyed hash of it draws the surrogate: the same entity gets the same one in every
spelling and document, a digit stays a digit, a letter a letter of its case, a name keeps gender and script.
Surrogates of different entities are compared over the whole corpus; where two meet, or one meets a
real entity, all but one draw again until none do. A name that a document gives with a title is replaced in that document
without one too: as a whole and by its last part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.session import checkpointed

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Titles by gender. A title before a capitalised name marks a person.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Doña", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Доктор")
_TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))
_NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}"
KINDS = {
    # It begins where a run of its signs or the search does, and takes no part of a run twice, so long runs cost their length;
    # more than 127 labels are no domain, and a bound keeps the search from nesting as deep as the text is long.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:sk|pk|rk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}",
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # what looks like a card; it is one if `_is_entity` agrees
    "card": r"(?<![0-9+])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9+])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|(?<![0-9+])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_NAME}",
}
#: A word that may be a part of a name; what follows an apostrophe belongs to it only if it is capitalised.
_NAME_WORD = r"(?<!\p{L})\p{Lu}\p{L}*+(?:['’-]\p{Lu}\p{L}*+){0,3}"
#: Cards begin with one of these digits, by their industry.
_CARD_STARTS = "23456"
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these holds no entity; they are quick to look for.
_HINT = rf"[0-9@]|(?:AKIA|ASIA)[A-Z0-9]{{16}}|[-_][A-Za-z0-9_-]{{16}}|[0-9A-Fa-f]{{32}}|(?:{_TITLES})\.? \p{{Lu}}"
# Syllables of which surrogate names are made, by script, and their endings by gender.
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fa", "ga", "ka", "la", "le", "ma", "me", "na", "ra", "sa", "te", "vo"),
    "cyrillic": ("ба", "ве", "га", "до", "жа", "за", "ка", "ле", "ма", "не", "ра", "ро", "са", "та", "фе", "ша"),
    "greek": ("βα", "γε", "δα", "ζο", "θα", "κα", "λε", "μα", "νε", "πα", "ρο", "σα", "τε", "φα", "χα", "ψε"),
}
ENDINGS = {"latin": ("rin", "lia", "len"), "cyrillic": ("рин", "лия", "лен"), "greek": ("ρος", "λια", "λεν")}
# The country codes of phone numbers; none begins another, so the digits alone tell where one ends. Signs may stand between.
_COUNTRY = r"\+(?:[17]|2~[07]|3~[0-469]|4~[013-9]|5~[1-8]|6~[0-6]|8~[1246]|9~[0-58]|[2-9]~[0-9]~[0-9])".replace("~", "[^0-9]*")
#: Entities that drew again are given to all tasks up to this number; beyond it they are joined.
MAX_LISTED = 1_000
LONGEST_NUMBER = 64
#: From this draw on a surrogate also gets more characters, so a small space of forms cannot run out.
LONGER_FROM = 4
#: More draws than this mean that a kind has hardly more forms than the corpus has entities.
MAX_DRAWS = 100


def kind_of(value: Column) -> Column:
    out = F.lit("phone")
    for kind in ("name", "card", "ssn", "ip", "token", "key"):
        out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return F.when(value.contains("@"), "email").otherwise(out)


def _bare(value: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(value, rf"^(?:{_TITLES})\.? ", "")


def _gender(value: Column) -> Column:
    """0 for a man's title, 1 for a woman's, 2 for one of either."""
    at = lambda titles: value.rlike(rf"^(?:{'|'.join(titles)})\.? ")
    return F.when(at(FEMALE), 1).when(at(MALE), 0).otherwise(2)


def canonical(value: Column) -> Column:
    """What makes two spellings one entity: the kind, and lower-cased letters or bare digits.

    Keys and tokens keep their case. A name counts without its title but with the gender it tells.
    A phone number keeps a leading +, as the same digits without it are another number.
    """
    def form(kind: Column) -> Column:
        return F.concat_ws(
            ":",
            kind,
            F.when(kind.isin("ssn", "card", "phone"), F.regexp_replace(value, "(?!^[+])[^0-9]", ""))
            .when(kind == "name", F.concat_ws(":", _gender(value).cast("string"), F.lower(_bare(value))))
            .when(kind.isin("key", "token"), value)
            .otherwise(F.lower(value)),
        )

    return _let(kind_of(value), form)


def _matches(text: Column) -> Column:
    """All that looks like an entity, in its order."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _is_entity(value: Column) -> Column:
    """False for a run of digits like a card's without a card's first digit or checksum."""
    bare = F.regexp_replace(value, "[ -]", "")
    card = F.substr(bare, F.lit(1), F.lit(1)).isin(*_CARD_STARTS) & (F.pmod(_luhn_sum(bare), F.lit(10)) == 0)
    return ~value.rlike("^[0-9][0-9 -]{12,22}$") | card


def entities(text: Column) -> Column:
    """All entities of a text in their order, as they are spelled; without untitled mentions of names."""
    return F.filter(_matches(text), _is_entity)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _byte(drawn: Column, at: Column) -> Column:
    """Byte ``at`` of the drawn bytes, which are 128 hexadecimal digits; beyond them it begins again."""
    return F.conv(F.substr(drawn, F.pmod(at, F.lit(63)) * 2 + 1, F.lit(3)), 16, 10).cast("int")


def _char(drawn: Column, at: Column, c: Column) -> Column:
    """A character of the same kind as ``c``."""
    lower, upper = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def one(v: Column) -> Column:
        return (
            F.when(c == "0", F.pmod(v, F.lit(10)).cast("string"))
            .when(c.between("1", "9"), (F.pmod(v, F.lit(9)) + 1).cast("string"))
            .when(c.between("a", "z"), F.substr(lower, F.pmod(v, F.lit(26)) + 1, F.lit(1)))
            .when(c.between("A", "Z"), F.substr(upper, F.pmod(v, F.lit(26)) + 1, F.lit(1)))
            .otherwise(c)
        )

    return _let(_byte(drawn, at), one)


def _chars(value: Column) -> Column:
    return F.split(value, "")


def _alike(drawn: Column, value: Column) -> Column:
    """Every letter and digit drawn anew; signs stay, and do not count, so spellings agree. In values longer
    than any number they count, as no spelling of those differs by signs."""
    before = lambda i: F.char_length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^0-9A-Za-z]", ""))
    by_place = F.transform(_chars(value), lambda c, i: _char(drawn, i, c))
    by_count = F.transform(_chars(value), lambda c, i: _char(drawn, before(i), c))
    return F.array_join(F.when(F.char_length(value) > LONGEST_NUMBER, by_place).otherwise(by_count), "")


def _luhn_sum(digits: Column) -> Column:
    """The checksum of a run of digits; 0 modulo 10 if it holds."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), one), F.lit(0), lambda a, d: a + d)


def _card(alike: Column, value: Column) -> Column:
    """First digit kept; where the checksum held it holds again, by the last digit."""
    made = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(alike, F.lit(2)))
    bare = lambda x: F.regexp_replace(x, "[^0-9]", "")
    head = lambda m: F.substr(m, F.lit(1), F.char_length(m) - 1)
    held = F.pmod(_luhn_sum(bare(value)), F.lit(10)) == 0
    last = lambda m: F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(bare(head(m)), F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return _let(made, lambda m: F.when(held, F.concat(head(m), last(m))).otherwise(m))


def _ip(drawn: Column, value: Column, draw: Column) -> Column:
    """Each number keeps its number of digits, in the first draws."""
    def one(x: Column, i: Column) -> Column:
        v = _byte(drawn, i * 2)
        return F.when(draw >= LONGER_FROM, 1 + F.pmod(v, F.lit(254))).when(F.char_length(x) == 3, 100 + F.pmod(v, F.lit(155))).when(F.char_length(x) == 2, 10 + F.pmod(v, F.lit(90))).otherwise(1 + F.pmod(v, F.lit(9)))

    return F.array_join(F.transform(F.split(value, "\\."), lambda x, i: one(x, i).cast("string")), ".")


def _hexadecimal(drawn: Column, value: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        h = F.substr(F.lit("0123456789abcdef"), F.pmod(_byte(drawn, i), F.lit(16)) + 1, F.lit(1))
        return F.when(value.rlike("[a-f]"), h).otherwise(F.upper(h))

    return F.array_join(F.transform(_chars(value), one), "")


def _words(of: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, of))


def _name(drawn: Column, value: Column, draw: Column) -> Column:
    """Title kept; as many names, of the same script and gender, in the same capitals."""
    bare = _bare(value)
    title = F.substr(value, F.lit(1), F.char_length(value) - F.char_length(bare))
    script = F.when(bare.rlike(r"\p{IsCyrillic}"), "cyrillic").when(bare.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    tables = F.when(script == "cyrillic", _words(SYLLABLES["cyrillic"])).when(script == "greek", _words(SYLLABLES["greek"])).otherwise(_words(SYLLABLES["latin"]))
    endings = F.when(script == "cyrillic", _words(ENDINGS["cyrillic"])).when(script == "greek", _words(ENDINGS["greek"])).otherwise(_words(ENDINGS["latin"]))
    n = 2 + F.when(draw >= LONGER_FROM, draw).otherwise(0)

    def one(part: Column, i: Column) -> Column:
        body = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(tables, F.pmod(_byte(drawn, i * 5 + k), F.lit(16)))), "")
        whole = F.concat(body, F.get(endings, _gender(value)))
        return _let(whole, lambda w: F.when((part == F.upper(part)) & (F.char_length(part) > 1), F.upper(w)).otherwise(F.initcap(w)))

    return F.concat(title, F.array_join(F.transform(F.split(bare, " "), one), " "))


def surrogate(value: Column, draw: Column, key: str) -> Column:
    """The surrogate of an entity as it is spelled, at the given draw (0 the first)."""
    # Addresses of one domain get one domain again; the last label stays.
    domain = F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    inner = F.substr(domain, F.lit(1), F.char_length(domain) - F.char_length(top))
    hidden = _let(_drawn(F.concat_ws(":", F.lit("domain"), F.lower(inner)), F.lit(0), key), lambda d: _alike(d, inner))
    # A phone number keeps its country, the same digits in every spelling; a key the letters that tell its kind.
    front = F.char_length(F.regexp_extract(value, rf"^(?:{_COUNTRY}|AKIA|ASIA|[a-z]+[-_])", 0))

    def made(drawn: Column) -> Column:
        more = F.when(draw >= LONGER_FROM, F.concat(F.lit("."), draw.cast("string"), F.substr(drawn, F.lit(1), F.lit(8)))).otherwise("")

        def by_kind(x: Column) -> Column:
            kind, alike = x["kind"], x["alike"]
            return (
                F.when(kind == "email", F.concat(F.substring_index(alike, "@", 1), more, F.lit("@"), hidden, top))
                .when(kind == "ip", _ip(drawn, value, draw))
                .when(kind == "card", _card(alike, value))
                .when(kind == "token", _hexadecimal(drawn, value))
                .when(kind == "name", _name(drawn, value, draw))
                .when(kind == "ssn", alike)
                .otherwise(F.concat(F.substr(value, F.lit(1), front), F.substr(alike, front + 1)))
            )

        return _let(F.struct(kind_of(value).alias("kind"), _alike(drawn, value).alias("alike")), by_kind)

    return _let(_drawn(canonical(value), draw, key), made)


def _drawn(form: Column, draw: Column, key: str) -> Column:
    """128 hexadecimal digits from the key, the entity and the draw."""
    parts = F.concat_ws("|", F.lit(key), form, draw.cast("string"))
    return F.concat(F.sha2(F.concat(F.lit("a|"), parts).cast("binary"), 256), F.sha2(F.concat(F.lit("b|"), parts).cast("binary"), 256))


def draws(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``form, draw`` of the entities that had to draw again: all of the corpus, distinct by their form.

    Distinct entities are found by partial sums, so an entity that stands everywhere is one row per
    task. Each round draws for every one, finds surrogates that two share or that are real entities
    of the corpus, and lets all but the least form of a group go on to the next draw.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(F.explode(F.transform(entities(body), lambda e: F.struct(canonical(e).alias("form"), e.alias("value")))).alias("e"))
    known = checkpointed(found.groupBy("e.form").agg(F.min("e.value").alias("value")).withColumn("draw", F.lit(0)))
    for _ in range(MAX_DRAWS):
        made = known.withColumn("made", _let(surrogate(F.col("value"), F.col("draw"), key), canonical))
        real = made.join(known.select(F.col("form").alias("made")).distinct(), "made", "left_semi").select("form")
        shared = made.groupBy("made").agg(F.min("form").alias("first"), F.count("*").alias("n")).where("n > 1")
        losers = made.join(shared, "made").where("form <> first").select("form").union(real).distinct()
        losers = checkpointed(losers.withColumn("again", F.lit(1)))
        if losers.isEmpty():
            return known.where("draw > 0").select("form", "draw")
        known = checkpointed(known.join(losers, "form", "left").select("form", "value", (F.col("draw") + F.coalesce("again", F.lit(0))).alias("draw")))
    raise RuntimeError(f"some surrogates still meet after {MAX_DRAWS} draws: the corpus has about as many entities as their kind has forms")


def _people(told: Column) -> Column:
    """The distinct names among entities, as lists to look words up in: ``all`` by their last parts, with the gender of the title and
    what replaces that part; ``longer``, those of several parts; and ``pairs`` of neighbouring parts, with what replaces the first
    (``lead``) and the second (``trail``)."""
    def one(e: Column) -> Column:
        parts = F.transform(F.split(F.lower(_bare(e["value"])), " "), lambda p: F.regexp_replace(p, "['’]s$", ""))
        return F.struct(parts.alias("parts"), _gender(e["value"]).alias("gender"), F.split(_bare(e["surrogate"]), " ").alias("new"))

    def lists(names: Column) -> Column:
        tail = lambda p: F.struct(F.element_at(p["parts"], -1).alias("last"), p["gender"].alias("gender"), F.element_at(p["new"], -1).alias("new"))
        pair = lambda p, j: F.struct(F.concat_ws(" ", F.get(p["parts"], j), F.get(p["parts"], j + 1)).alias("pair"), F.get(p["new"], j).alias("lead"), F.get(p["new"], j + 1).alias("trail"))
        several = F.filter(names, lambda p: F.size(p["parts"]) > 1)
        pairs = F.flatten(F.transform(several, lambda p: F.transform(F.sequence(F.lit(0), F.size(p["parts"]) - 2), lambda j: pair(p, j))))
        return F.struct(F.transform(names, tail).alias("all"), F.transform(several, tail).alias("longer"), F.array_distinct(pairs).alias("pairs"))

    return _let(F.array_distinct(F.transform(F.filter(told, lambda e: e["kind"] == "name"), one)), lists)


def _looked_up(keys: Column, values: Column, key: Column) -> Column:
    """The value beside the first of equal keys, or null."""
    return F.get(values, F.nullif(F.array_position(keys, key), F.lit(0)).cast("int") - 1)


def _cased(new: Column, word: Column) -> Column:
    return F.when((word == F.upper(word)) & (F.char_length(word) > 1), F.upper(new)).otherwise(F.initcap(new))


def _titled_again(e: Column, people: Column) -> Column:
    """An entity that is a title and one name: by the last part of a longer name of the document that it may be."""
    def resolved(x: Column) -> Column:
        fits = lambda p: (p["last"] == F.lower(x["bare"])) & ((p["gender"] == x["gender"]) | (p["gender"] == 2) | (x["gender"] == 2))
        title = F.substr(e["value"], F.lit(1), F.char_length(e["value"]) - F.char_length(x["bare"]))
        known = F.array_contains(people["longer"]["last"], F.lower(x["bare"]))
        new = F.when(known, F.get(F.filter(people["longer"], fits), F.lit(0))["new"])
        return F.struct(e["kind"].alias("kind"), e["value"].alias("value"), F.coalesce(F.concat(title, _cased(new, x["bare"])), e["surrogate"]).alias("surrogate"))

    return F.when((e["kind"] != "name") | F.contains(_bare(e["value"]), F.lit(" ")), e).otherwise(_let(F.struct(_bare(e["value"]).alias("bare"), _gender(e["value"]).alias("gender")), resolved))


def _mentions(piece: Column, people: Column) -> Column:
    """(gap, value, surrogate) of the capitalised words of a text without entities, and a last gap; surrogate is null for words that
    name nobody. A word is a mention if it is the last part of a name, or a part beside the part that stands next to it."""
    def of(x: Column) -> Column:
        words, gaps = x["words"], x["gaps"]

        def one(word: Column, i: Column) -> Column:
            low, pairs = F.lower(word), people["pairs"]
            after = F.when(F.get(gaps, i + 1) == " ", F.concat_ws(" ", low, F.lower(F.get(words, i + 1))))
            before = F.when(F.get(gaps, i) == " ", F.concat_ws(" ", F.lower(F.get(words, i - 1)), low))
            new = F.coalesce(
                _looked_up(pairs["pair"], pairs["trail"], before),
                _looked_up(pairs["pair"], pairs["lead"], after),
                _looked_up(people["all"]["last"], people["all"]["new"], low),
            )
            return F.struct(F.get(gaps, i).alias("gap"), word.alias("value"), _cased(new, word).alias("surrogate"))

        end = F.struct(F.element_at(gaps, -1).alias("gap"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("surrogate"))
        return F.concat(F.transform(words, one), F.array(end))

    return _let(F.struct(F.regexp_extract_all(piece, F.lit(_NAME_WORD), F.lit(0)).alias("words"), F.split(piece, _NAME_WORD, -1).alias("gaps")), of)


def replace(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with surrogates in ``text``, and ``entities``: (kind, value, surrogate) in text order.

    Whole texts are searched. A null text stays null, an empty one empty, both without entities. Equal
    rows get equal results. A column named ``entities`` is replaced; an empty table stays empty. A number that
    only looks like a card stays. Capitalised words that mention a name which the text gives with a title count as entities of
    kind ``name``; looking for them costs the words times the distinct names of that text. A title before one name
    takes the last part of a longer name of the text, unless their titles tell different genders.
    """
    again = draws(docs, key, text)
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("entities", text.lower())]
    others = [F.col(f"`{c}`") for c in columns]
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(*others, body.alias("__text"), _matches(F.coalesce(body, F.lit(""))).alias("__found"))
    if len(again.take(MAX_LISTED + 1)) <= MAX_LISTED:
        # few enough to go along with every task, so no text is shuffled
        listed = again.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("form", "draw")))).alias("m"))
        rows = rows.withColumn("__draws", listed.scalar())
    else:
        # Equal rows share a key, and all of their results.
        keys = [F.xxhash64(F.col(f"`{c}`").cast("string"), F.col("__text"), F.lit(i)) for i, c in enumerate((doc_id, doc_id))] if doc_id in columns else [F.xxhash64("__text"), F.xxhash64(F.lit(1), "__text")]
        rows = rows.withColumns({"__k1": keys[0], "__k2": keys[1]})
        held = rows.select("__k1", "__k2", F.explode(F.transform("__found", canonical)).alias("form")).distinct().join(again, "form")
        maps = held.groupBy("__k1", "__k2").agg(F.map_from_entries(F.collect_list(F.struct("form", "draw"))).alias("__draws"))
        rows = rows.join(maps, ["__k1", "__k2"], "left")
    draw = lambda e: F.coalesce(F.try_element_at("__draws", canonical(e)), F.lit(0))
    stays = lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x["e"].alias("value"), x["e"].alias("surrogate"))
    told_of = lambda x: F.when(_is_entity(x["e"]), F.struct(kind_of(x["e"]).alias("kind"), x["e"].alias("value"), surrogate(x["e"], x["draw"], key).alias("surrogate"))).otherwise(stays(x))
    made = F.transform("__found", lambda e: _let(F.struct(e.alias("e"), draw(e).alias("draw")), told_of))
    told = rows.select(*others, "__text", made.alias("__told")).withColumn("__people", _people(F.col("__told")))
    # The text between what looks like entities; each piece is followed by what replaces the entity after it.
    steps = F.arrays_zip(F.split("__text", ENTITY, -1).alias("gap"), F.col("__told").alias("e"))
    plain = F.transform(steps, lambda x: F.struct(x["gap"].alias("gap"), x["e"]["kind"].alias("kind"), x["e"]["value"].alias("value"), x["e"]["surrogate"].alias("surrogate")))

    def with_mentions(x: Column) -> Column:
        said = F.transform(_mentions(x["gap"], F.col("__people")), lambda m: F.struct(m["gap"].alias("gap"), F.when(m["surrogate"].isNotNull(), "name").alias("kind"), m["value"].alias("value"), F.coalesce(m["surrogate"], m["value"]).alias("surrogate")))
        ends = lambda e: F.struct(F.lit("").alias("gap"), e["kind"].alias("kind"), e["value"].alias("value"), e["surrogate"].alias("surrogate"))
        return F.concat(said, F.array(_let(F.when(x["e"]["kind"] == "name", _titled_again(x["e"], F.col("__people"))).otherwise(x["e"]), ends)))

    told = told.withColumn("__steps", F.when(F.size("__people.all") > 0, F.flatten(F.transform(steps, with_mentions))).when(F.size("__told") > 0, plain))
    told = told.withColumn("entities", F.transform(F.filter(F.coalesce("__steps", F.array().cast(_STEPS)), lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["surrogate"].alias("surrogate"))))
    joined = F.array_join(F.transform("__steps", lambda x: F.concat(x["gap"], F.coalesce(x["surrogate"], F.lit("")))), "")
    told = told.withColumn("__new", F.when(F.size("entities") > 0, joined).otherwise(F.col("__text")))
    order = [F.col("__new").alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() != "entities"]
    return told.select(*order, "entities")


_STEPS = "array<struct<gap:string,kind:string,value:string,surrogate:string>>"
