"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same for the same entity.

Everything here is DataFrame expressions. A mention is reduced to its entity (case and separators do not count), a keyed
digest of the entity gives the letters and digits of the surrogate, and the surrogate is laid out like the mention: digits for
digits, letters of the same case and script, names of the same gender, valid check digits where the mention has one.

Two entities of a type could get one surrogate, or a surrogate could be an entity of the corpus. Both are looked for in the
table of all entities, and the entity concerned is given the next attempt of the digest until every one is distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import let, materialize, table

KEY = "surrogates-1"

MALE = ("Mr", "Herr", "Señor", "Monsieur", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "госпожа")
_TITLES = "|".join((*FEMALE, *MALE))

#: Types in the order in which they are tried. Each starts only where a run begins, so long texts take linear time.
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|secret|token|api_key)\s?[=:]\s?[\"']?)[A-Za-z0-9+/_-]{8,}+",
    "access_key": r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
    "address": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9])",
    "phone": r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?)?(?<![0-9])(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
}
ANY = "|".join(f"(?:{pattern})" for pattern in TYPES.values())

# The letters of scripts, and first names by script and gender.
DIGITS, HEX = "0123456789", "abcdef"
ALPHABETS = (
    DIGITS,
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзиклмнопрстуфхцчшэюя",
    "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
FIRST_NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Leo Martin Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Berta Clara Diana Emma Flora Greta Helena Irene Julia Laura Maria Nora Olivia Sara Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Семён Тимур Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Клара Лидия Мария Нина Ольга Полина Римма Софья Юлия".split(),
}
SYLLABLES = {
    "latin": "bar den fel gor han kel lin mar nor pel ros sen tal vin wes zan".split(),
    "cyrillic": "бар ден фел гор хан кел лин мар нор пел рос сен тал вин вес зан".split(),
}
#: Runs of letters of one kind beside those alphabets, capitals and small letters in runs of equal size (first and last code
#: point): a letter moves on in its run by a keyed step, and comes round.
RUNS = (
    (0xC0, 0xD6), (0xE0, 0xF6), (0xD8, 0xDE), (0xF8, 0xFE),  # Latin with marks
    (0x400, 0x40F), (0x450, 0x45F), (0x410, 0x42F), (0x430, 0x44F),  # Cyrillic
    (0x531, 0x556), (0x561, 0x586),  # Armenian
    (0x5D0, 0x5EA),  # Hebrew
    (0x621, 0x63A), (0x641, 0x64A),  # Arabic
    (0x905, 0x939), (0x985, 0x98C), (0x993, 0x9A8),  # Devanagari, Bengali
    (0xE01, 0xE2E),  # Thai
    (0x10D0, 0x10F0),  # Georgian
    (0x3041, 0x3096), (0x30A1, 0x30FA),  # Hiragana, Katakana
    (0x4E00, 0x9FFF),  # Han
    (0xAC00, 0xD7A3),  # Hangul
)
#: From the first of these attempts on a surrogate is longer than its format by more and more drawn characters, so that more
#: entities than a format has surrogates find one; at the last one it carries a whole digest, and is taken.
LONGER, LAST = 8, 16
#: Digest blocks of 32 characters each are added until the entity is covered; longer entities repeat them.
MAX_BLOCKS = 64


def kind_of(mention: Column) -> Column:
    """The type of a mention."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES.items()):
        kind = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def entity_of(kind: Column, mention: Column) -> Column:
    """What a mention stands for: the same for every way of writing it."""
    bare = F.regexp_replace(mention, r"[^\p{L}\p{N}]", "")
    name = F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "address", mention)
        .when(kind == "name", F.concat(_gender(mention), F.lit(" "), name))
        .when(kind == "secret", _secret(mention))
        .otherwise(bare)
    )


def _gender(mention: Column) -> Column:
    return F.when(mention.rlike(f"^(?:{'|'.join(FEMALE)})[. ]"), F.lit("f")).otherwise(F.lit("m"))


def _secret(mention: Column) -> Column:
    return F.regexp_extract(mention, r"[A-Za-z0-9+/_-]+$", 0)


def _stream(seed: Column, length: Column) -> Column:
    blocks = F.sequence(F.lit(0), F.least(F.floor(length / 32), F.lit(MAX_BLOCKS)).cast("int"))
    return F.array_join(F.transform(blocks, lambda block: F.sha2(F.concat(seed, F.lit("|"), block.cast("string")), 256)), "")


def _draw(stream: Column, index: Column) -> Column:
    """The number from 0 to 255 at an index from 0 on."""
    at = F.pmod(index, (F.length(stream) / 2).cast("int")) * 2 + 1
    return F.conv(F.substr(stream, at, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str] | str, number: Column) -> Column:
    if isinstance(values, str):
        return F.substr(F.lit(values), number % len(values) + 1, F.lit(1))
    return F.element_at(F.array(*(F.lit(v) for v in values)), number % len(values) + 1)


def recode(text: Column, seed: Column) -> Column:
    """Every letter and digit replaced by another of its kind; separators stay, and do not change what the others become."""

    def one(given: Column, at: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(given["text"], F.lit(1), at - 1), r"[^\p{L}\p{N}]", ""))
        drawn = F.struct(F.substr(given["text"], at, F.lit(1)).alias("char"), _draw(given["stream"], before).alias("number"))
        return let(drawn, lambda d: _of_kind(d["char"], d["number"], given["hex"]))

    def all_of(given: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(given["text"])), lambda at: one(given, at)), "")

    given = F.struct(
        text.alias("text"), _stream(seed, F.length(text)).alias("stream"), text.rlike("^[0-9a-f]{16,}$").alias("hex")
    )
    return F.when(F.length(text) == 0, text).otherwise(let(given, all_of))


def _moved(char: Column, number: Column) -> Column:
    """A letter or digit outside of the alphabets: the letter some steps on in its run, a digit for a digit, and a Latin letter
    of the same case for what has no run.
    """
    runs = F.array(*(F.struct(F.lit(first).alias("first"), F.lit(last - first + 1).alias("size")) for first, last in RUNS))
    small, capital = (_pick(ALPHABETS[i], number) for i in (1, 2))
    alone = F.when(char.rlike(r"\p{N}"), _pick(DIGITS, number)).when((F.upper(char) == char) & (F.lower(char) != char), capital).otherwise(small)

    def along(point: Column) -> Column:
        run = F.get(F.filter(runs, lambda r: (r["first"] <= point) & (point < r["first"] + r["size"])), F.lit(0))
        return let(run, lambda r: r["first"] + (point - r["first"] + 1 + number % (r["size"] - 1)) % r["size"])

    def two_or_three_bytes(point: Column) -> Column:
        two = [F.lit(0xC0) + F.shiftright(point, 6), F.lit(0x80) + point % 64]
        three = [F.lit(0xE0) + F.shiftright(point, 12), F.lit(0x80) + F.shiftright(point, 6) % 64, F.lit(0x80) + point % 64]
        spelled = F.when(point < 0x800, F.concat(*map(F.hex, two))).otherwise(F.concat(*map(F.hex, three)))
        return F.decode(F.unhex(spelled), "UTF-8")

    return let(along(F.ascii(char)), lambda point: F.when(point.isNull(), alone).otherwise(two_or_three_bytes(point)))


def _of_kind(char: Column, number: Column, hexadecimal: Column) -> Column:
    new = F.when(char.rlike(r"[\p{L}\p{N}]"), _moved(char, number)).otherwise(char)
    for alphabet in reversed(ALPHABETS):
        new = F.when(F.contains(F.lit(alphabet), char), _pick(alphabet, number)).otherwise(new)
    return F.when(hexadecimal & char.rlike("[a-f]"), _pick(HEX, number)).otherwise(new)


def _luhn(digits: Column, doubled_last: bool) -> Column:
    """Sum of a number's digits from the right, every second one doubled."""

    def add(total: Column, reverse: Column, at: Column) -> Column:
        digit = F.substr(reverse, at, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(at % 2 == (1 if doubled_last else 0), twice).otherwise(digit)

    return let(
        F.reverse(digits),
        lambda reverse: F.aggregate(F.sequence(F.lit(1), F.length(reverse)), F.lit(0), lambda total, at: add(total, reverse, at)),
    )


def _card(mention: Column, seed: Column) -> Column:
    """Keeps the first digit, and the check digit is right if it was."""
    valid = _luhn(F.regexp_replace(mention, "[^0-9]", ""), False) % 10 == 0

    def checked(drawn: Column) -> Column:
        payload = F.regexp_replace(F.substr(drawn, F.lit(1), F.length(drawn) - 1), "[^0-9]", "")
        check = F.pmod(10 - F.pmod(_luhn(payload, True), F.lit(10)), F.lit(10)).cast("string")
        return F.when(valid, F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), check)).otherwise(drawn)

    recoded = F.substr(recode(mention, seed), F.lit(2), F.length(mention))
    return let(F.concat(F.substr(mention, F.lit(1), F.lit(1)), recoded), checked)


def _name(mention: Column, seed: Column) -> Column:
    title, bare = F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0), F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", "")

    def drawn(given: Column) -> Column:
        def pick(values: list[str], index: int) -> Column:
            return _pick(values, _draw(given["stream"], F.lit(index)))

        def in_script(script: str) -> Column:
            first = F.when(given["gender"] == "f", pick(FIRST_NAMES[script, "f"], 0)).otherwise(pick(FIRST_NAMES[script, "m"], 0))
            family = F.initcap(F.concat(*(pick(SYLLABLES[script], i) for i in range(1, 6))))
            return F.when(given["bare"].contains(" "), F.concat_ws(" ", first, family)).otherwise(family)

        name = F.when(given["bare"].rlike(r"^\p{IsCyrillic}"), in_script("cyrillic")).otherwise(in_script("latin"))
        return F.concat(given["title"], name)

    stream = _stream(seed, F.lit(1))
    return let(F.struct(title.alias("title"), bare.alias("bare"), _gender(mention).alias("gender"), stream.alias("stream")), drawn)


def surrogate(kind: Column, mention: Column, entity: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a mention of an entity; of later attempts it is longer."""
    drawn = F.sha2(F.concat(F.lit(f"{key}|longer|"), kind, F.lit("|"), entity, F.lit("|"), attempt.cast("string")), 256)
    size = F.when(attempt >= LAST, 64).otherwise(2 * (attempt - LONGER + 1))
    letters, digits = (F.translate(F.substr(drawn, F.lit(1), size), "0123456789abcdef", signs) for signs in ("bcdfghjklmnpqrst", "0123456789012345"))
    added = F.when(kind.isin("email", "name"), letters).otherwise(digits)
    of_format = _of_format(kind, mention, entity, attempt, key)
    return let(of_format, lambda new: F.when(attempt < LONGER, new).when(kind == "email", F.concat(added, new)).otherwise(F.concat(new, added)))


def _of_format(kind: Column, mention: Column, entity: Column, attempt: Column, key: str) -> Column:
    seed = F.concat(F.lit(f"{key}||"), kind, F.lit("|"), entity, F.lit("|"), attempt.cast("string"))
    local, domain = F.substring_index(mention, "@", 1), F.substring_index(mention, "@", -1)
    last = F.substring_index(domain, ".", -1)
    labels = F.substr(domain, F.lit(1), F.length(domain) - F.length(last))
    host = F.concat(F.lit(f"{key}|domain|"), F.lower(domain))  # one domain stays one domain
    address = let(
        _stream(seed, F.lit(1)),
        lambda stream: F.array_join(F.transform(F.split(mention, r"\."), lambda _, i: (_draw(stream, i) % 254 + 1).cast("string")), "."),
    )
    code = F.regexp_extract(mention, r"^\+[0-9]{1,3}(?=[ .(-])", 0)

    # The beginning of a mention that is kept as it is; the rest is recoded.
    start = (
        F.when(kind == "secret", F.substr(mention, F.lit(1), F.length(mention) - F.length(_secret(mention))))
        .when(kind == "access_key", F.lit("AKIA"))
        .when(kind == "account", F.substr(mention, F.lit(1), F.lit(2)))
        .when(kind == "phone", code)
        .otherwise(F.lit(""))
    )
    recoded = let(start, lambda kept: F.concat(kept, recode(F.substr(mention, F.length(kept) + 1, F.length(mention)), seed)))
    return (
        F.when(kind == "email", F.concat(recode(local, seed), F.lit("@"), recode(labels, host), last))
        .when(kind == "address", address)
        .when(kind == "name", _name(mention, seed))
        .when(kind == "card", _card(mention, seed))
        .otherwise(recoded)
    )


def _candidate(text: Column) -> Column:
    """Quick to tell that most texts hold nothing."""
    found = text.rlike("[0-9@]") | F.lower(text).rlike("(?:passw|secret|token|api_key)")
    for title in (*MALE, *FEMALE):
        found = found | text.contains(title)
    return found


def mentions_of(text: Column) -> Column:
    return F.when(_candidate(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def retries(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate collides, with the attempt that does not.

    An entity collides if its surrogate is that of a smaller entity of the type, or one settled before, or an entity of the
    corpus itself. There are at most LAST + 1 rounds: surrogates of later attempts are longer, and those of the last one carry
    a digest of their own.
    """
    mention = F.col("mention")
    found = docs.select(F.explode(mentions_of(F.col(text))).alias("mention")).distinct().withColumn("kind", kind_of(mention))
    entities = found.withColumn("entity", entity_of(F.col("kind"), mention)).groupBy("kind", "entity").agg(F.min("mention").alias("mention"))
    entities = materialize(entities, "entities")
    settled, pending = None, entities
    for attempt in range(LAST + 1):
        drawn = surrogate(F.col("kind"), mention, F.col("entity"), F.lit(attempt), key)
        drawn = pending.withColumn("surrogate", let(drawn, lambda new: entity_of(F.col("kind"), new))).withColumn("attempt", F.lit(attempt))
        taken = entities.select("kind", F.col("entity").alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "surrogate"))
        free = drawn if attempt == LAST else drawn.join(taken.distinct(), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min_by(F.struct("entity", "mention", "attempt"), "entity").alias("one"))
        settling = materialize(first.select("kind", "one.*", "surrogate"), "surrogates")
        settled = settling if settled is None else settled.unionByName(settling)
        pending = materialize(pending.join(settling.select("kind", "entity"), ["kind", "entity"], "left_anti"), "pending")
        if pending.isEmpty():
            break
    return settled.where("attempt > 0").select("kind", "entity", "attempt")


def replace_entities(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The same rows and columns, with surrogates in the text for all that TYPES detect.

    A null text stays null; an empty text, and one in which nothing is found, stays as it is. Repeated rows get the same text.
    Rows of whatever doc_id are treated alike: only the text is looked at. Other columns stay, whatever their names.
    """
    again = materialize(retries(docs, key, text), "surrogate-retries")
    body = F.col(f"`{text}`")
    attempts, joined = F.lit(None).cast("map<string,int>"), docs
    columns = [F.col(f"`{name}`") for name in docs.columns]
    if not again.isEmpty():
        mention = F.col("mention")
        held = docs.select(F.xxhash64(body).alias("held_text"), F.explode(mentions_of(body)).alias("mention"))
        held = held.withColumn("kind", kind_of(mention)).withColumn("entity", entity_of(F.col("kind"), mention)).drop("mention").distinct()
        tagged = F.concat_ws("|", "kind", "entity")
        held = held.join(again, ["kind", "entity"]).groupBy("held_text").agg(F.map_from_entries(F.collect_list(F.struct(tagged, "attempt"))).alias("attempts_"))
        joined = docs.join(held, F.xxhash64(body) == held["held_text"], "left")
        attempts = held["attempts_"]

    def one(mention: Column) -> Column:
        def with_entity(kind: Column, entity: Column) -> Column:
            known = F.element_at(attempts, F.concat_ws("|", kind, entity))
            return surrogate(kind, mention, entity, F.coalesce(known, F.lit(0)), key)

        return let(kind_of(mention), lambda kind: let(entity_of(kind, mention), lambda entity: with_entity(kind, entity)))

    news = F.transform(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), one)
    parts = F.split(body, ANY, -1)
    whole = F.array_join(F.transform(parts, lambda part, i: F.concat(part, F.coalesce(F.get(news, i), F.lit("")))), "")
    changed = F.when(_candidate(body), whole).otherwise(body)
    return joined.select(*(changed.alias(name) if name == text else column for name, column in zip(docs.columns, columns)))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs).withColumn("n_chars", F.length("text").cast("long"))
