"""Personal data replaced by surrogates, in built-in expressions only.

Mentions of e-mail addresses, IPv4 addresses, payment cards, phone and social security numbers, bank
accounts, long hexadecimal secrets and names after a title are found by one pattern. Each entity gets a
surrogate from a keyed hash: numbers keep their length and layout (cards a valid check digit), names
their gender, script and capitals, addresses their form. Entities are compared by a canonical form
(digits alone, lower case, each word of a name by itself), so different spellings of one entity get
matching surrogates everywhere. Surrogates that two entities share, or that equal an entity of the
corpus, are drawn anew until none is left; so distinct entities stay distinct.

Edge cases: null text stays null, a text without mentions stays as it is; equal texts get equal
results, so repeated rows do too; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import stored

#: Titles before names, by gender.
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
#: Syllables that surrogate names are made of, by script, and the endings by gender.
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zu"],
    "cyrillic": ["ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зу"],
    "greek": ["βα", "δε", "φι", "γο", "χα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βε", "ξι", "ζου"],
}
ENDINGS = {
    "given_m": {"latin": "n", "cyrillic": "н", "greek": "ς"},
    "given_f": {"latin": "a", "cyrillic": "а", "greek": "α"},
    "surname": {"latin": "r", "cyrillic": "р", "greek": "ρ"},
}
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
NAME = r"\p{Lu}[\p{L}'’-]+"
#: Kind of entity and its pattern; of two that begin at one place the earlier kind wins.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?|(?<![0-9])\([0-9]{2,4}\)[ .-]?|(?<![0-9])[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{2}(?:[ .-]?[0-9]{2,5})?(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE)})\.?[ \x{{a0}}]{NAME}(?: {NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No text without one of these holds a mention; finding one is much cheaper than the whole pattern.
HINT = rf"[0-9@]|(?:{'|'.join(MALE + FEMALE)})\.?[ \x{{a0}}]"
DIGITS = ["iban", "card", "ssn", "phone"]


def mentions(text: Column) -> Column:
    """All mentions in `text`, in order; null where there are none."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    return F.when(F.size(found) > 0, found)


def _kind(mention: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        if kind != "name":
            out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _parts(kind: Column, mention: Column) -> Column:
    """(kind, canonical form, spelling) of the entities of a mention."""
    title = F.regexp_extract(mention, r"^(\p{L}+)\.?[ \x{a0}]", 1)
    words = F.split(F.regexp_replace(mention, r"^\p{L}+\.?[ \x{a0}]", ""), " ")
    given = F.when(title.isin(FEMALE), "given_f").otherwise("given_m")
    names = F.transform(words, lambda w, i: F.struct(
        F.when(i == F.size(words) - 1, "surname").otherwise(given).alias("kind"), F.lower(w).alias("canon"), w.alias("spelled")))
    canon = F.when(kind.isin(DIGITS), F.regexp_replace(mention, "[^0-9]", "")).otherwise(F.lower(mention))
    one = F.array(F.struct(kind.alias("kind"), canon.alias("canon"), mention.alias("spelled")))
    return F.when(kind == "name", names).otherwise(one)


def _luhn(digits: Column) -> Column:
    """The check digit that follows `digits`."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(
        i % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")))
    total = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _hex(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def _picker(choice: Column):
    """Maps a hexadecimal digit to one of sixteen."""
    return lambda c: F.element_at(choice, F.conv(c, 16, 10).cast("int") + 1)


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an entity's canonical form at the given attempt."""
    seed = _hex(F.lit(key), kind, canon, attempt.cast("string"))
    more = F.concat(seed, _hex(seed))
    figures = F.translate(more, "abcdef", "274916")
    size = F.length(canon)
    number = F.concat(canon.substr(1, 1), F.substring(figures, 1, 127)).substr(F.lit(1), size)
    card = number.substr(F.lit(1), size - 1)
    octets = [F.conv(F.substring(seed, 2 * k + 1, 2), 16, 10) for k in range(3)]
    domain = _hex(F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1))
    email = F.concat(F.lit("u"), F.substring(seed, 1, 14), F.lit("@d"), F.substring(domain, 1, 12), F.lit(".example."), F.substring_index(canon, ".", -1))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    name = F.lit(None).cast("string")
    for one, syllables in SYLLABLES.items():
        at = F.split(F.substring(seed, 1, 60), "")
        choice = F.array(*map(F.lit, syllables))
        picked = F.transform(F.slice(at, F.lit(1), 3 + attempt), _picker(choice))
        ending = reduce(lambda a, k: F.when(kind == k, ENDINGS[k][one]).otherwise(a), ENDINGS, F.lit(""))
        name = F.when(script == one, F.concat(F.array_join(picked, ""), ending)).otherwise(name)
    return (
        F.when(kind == "card", F.concat(card, _luhn(card)))
        .when(kind.isin(DIGITS), number)
        .when(kind == "ip", F.concat_ws(".", F.lit("10"), *octets))
        .when(kind == "secret", F.substring(F.concat(more, _hex(more)), 1, 128).substr(F.lit(1), size))
        .when(kind == "email", email)
        .otherwise(name)
    )


def surrogates(entities: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """(kind, canon, surrogate) of the distinct `entities` (kind, canon), no surrogate twice in a kind.

    Of entities that share a surrogate the one with the fewest attempts, then the first, keeps it; the
    others draw again, and so does any whose surrogate is an entity of the corpus itself.
    """
    now = stored(entities.select("kind", "canon", F.lit(0).alias("attempt")).distinct(), "entities")
    for _ in range(rounds):
        drawn = now.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        taken = now.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
        judged = drawn.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        lost = F.col("taken").isNotNull() | (F.col("first.canon") != F.col("canon"))
        judged = stored(judged.select("kind", "canon", "attempt", "surrogate", lost.alias("lost")), "surrogates")
        if judged.where("lost").isEmpty():
            return judged.select("kind", "canon", "surrogate")
        now = judged.select("kind", "canon", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
    raise RuntimeError(f"surrogates: not distinct after {rounds} rounds")


def _lay_out(digits: Column, layout: Column) -> Column:
    """`layout` with its digits replaced by `digits`, one after the other."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    done = F.aggregate(F.split(layout, ""), start, lambda a, c: F.struct(
        F.concat(a.out, F.when(c.rlike("^[0-9]$"), digits.substr(a.k + 1, F.lit(1))).otherwise(c)).alias("out"),
        (a.k + c.rlike("^[0-9]$").cast("int")).alias("k")))
    return done.out


def _spelled(kind: Column, surrogate: Column, spelled: Column) -> Column:
    capitals = F.when((F.length(spelled) > 1) & (F.upper(spelled) == spelled), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    is_name = kind.isin(list(ENDINGS))
    return F.when(kind.isin(DIGITS), _lay_out(surrogate, spelled)).when(is_name, capitals).otherwise(surrogate)


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text with surrogates, n_mentions."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("mentions", mentions(F.col("text")))
    # Every text has a digest, also one that needs no surrogates: null keys would all meet in one task.
    rows = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    some = rows.where("mentions is not null")
    held = stored(some.select("digest", F.explode(F.array_distinct("mentions")).alias("mention")).distinct(), "mentions")
    spelled = held.select("mention").distinct().withColumn("kind", _kind(F.col("mention")))
    spelled = spelled.select("mention", F.posexplode(_parts(F.col("kind"), F.col("mention"))).alias("k", "part"))
    spelled = spelled.select("mention", "k", "part.*")
    drawn = spelled.join(surrogates(spelled.select("kind", "canon"), key), ["kind", "canon"])
    drawn = drawn.withColumn("new", _spelled(F.col("kind"), F.col("surrogate"), F.col("spelled")))
    drawn = drawn.groupBy("mention").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda x: x.new), " ").alias("new"),
        F.max(F.col("kind").isin(list(ENDINGS))).alias("titled"))
    title = F.regexp_extract("mention", r"^\p{L}+\.?[ \x{a0}]", 0)
    new = F.when(F.col("titled"), F.concat(title, "new")).otherwise(F.col("new"))
    by_text = held.join(drawn.select("mention", new.alias("new")), "mention")
    by_text = by_text.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("news"))
    found = rows.join(by_text, "digest", "left")
    between = F.split("text", ANY, -1)
    put = F.transform(F.col("mentions"), lambda m: F.element_at(F.col("news"), m))
    mixed = F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return found.select(
        "doc_id",
        F.when(F.col("mentions").isNotNull(), mixed).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size("mentions"), F.lit(0)).alias("n_mentions"),
    )
