"""PII surrogates, in DataFrame functions only.

One pattern finds the mentions of entities in a text. What names an entity is a mention's core (what follows a keyword
or a title), normalised: e-mail addresses without regard to case, telephone, card, account and social security numbers
without separators, and names word by word, surnames apart from given names. So `Mrs. Jane Doe` and `Mrs. Doe` share a
surname, and `+1 212 555 0123` and `+1 (212) 555-0123` are one number. Each entity gets a keyed surrogate of its type:
digits stay digits and letters letters of their case at the same places (hexadecimal ones hexadecimal), telephone
numbers keep their country code or trunk 0, card numbers their first digit and a valid check digit if they had one,
addresses stay addresses, given names keep their gender (by title) and names their script. Each mention then gets the
surrogate in its own form: its separators, capitals, hyphens and number of words. Equal entities get equal surrogates
everywhere, so coreference holds. Surrogates are checked against each other and against all entities found; of those
that clash the one drawn earliest (then the least) keeps it and the others are drawn again, longer ones for names, so
there is always room: distinct entities stay distinct and no surrogate is somebody else's.

Only rows with an entity are shuffled, and the table of entities is distributed, so many to a task at every size.

Defined cases: a null text stays null; a text without entities stays as it is; repeated rows are replaced alike;
other columns pass through in place, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize

#: What the detectors look for, in order of precedence. The keyword or title is group 1 of its own pattern.
KEYWORD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
TITLES_F = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|Signora|г-жа|Госпожа"
TITLES_M = "Mr|Herr|Monsieur|Señor|Signor|г-н|Господин"
TITLES_N = "Dr|Prof"
#: National telephone numbers: area code in parentheses, 3-3-4 digits with like separators, and a trunk 0 with 9 to 15 digits in all.
NATIONAL = (
    r"(?=[\d(])(?<![\w.,(/-])(?:(?:1[ .-])?\(\d{2,5}\)[ .-]?\d{2,4}[ .-]?\d{2,5}(?:[ .-]\d{2,4})?"
    r"|(?:1[ .-])?[2-9]\d{2}(?:-[2-9]\d{2}-|\.[2-9]\d{2}\.| [2-9]\d{2} )\d{4}"
    r"|(?=0(?:[ .-]?\d){8,14}(?![ .-]?\d))0\d{1,4}(?:(?: \d{2,4}){2,4}|(?:-\d{2,4}){2,4}|(?:\.\d{2,4}){2,4})|(?=0\d{2,5}[ /-]\d{5,8}(?!\d))(?=0(?:[ /-]?\d){8,14}(?!\d))0\d{2,5}[ /-]\d{5,8})(?![\d-])"
)
DETECTORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": KEYWORD + r"[A-Za-z0-9_+/-]{8,}+",
    "key": r"(?=[Ags])(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{82,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": rf"\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?(?:\d{{2,4}}(?:[ .-]\d{{2,4}}){{1,3}}|\d{{6,12}})(?!\d)|{NATIONAL}",
    "ssn": r"(?=\d)(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "iban": r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?=\d)(?<![\d.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",
    "name": rf"(?=[MFSHDPгГ])(?<!\p{{L}})(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in DETECTORS.values())
#: What stands before the core and stays.
LEAD = rf"^(?:{KEYWORD}|(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? (?=\p{{Lu}}))"

#: An entity has one of these in it; they are found much faster than the pattern.
SIGNS = (
    "@", *"0123456789", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-",
    "Mr.", "Mr ", "Mrs", "Ms.", "Ms ", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señor", "Sra", "Signor", "г-жа", "Госпо", "Herr", "Monsieur", "г-н", "Dr.", "Dr ", "Prof",
)
SIGNS_ANY_CASE = ("passw", "pwd", "secret", "token", "apikey", "api_key", "api-key")

#: Given names by gender, and surnames, by script.
NAMES = {
    ("Latin", "f"): "Alice Clara Elena Greta Ingrid Julia Laura Marta Nora Olivia Paula Rosa Silvia Teresa Ursula Vera".split(),
    ("Latin", "m"): "Albert Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Oscar Peter Ralf".split(),
    ("Latin", "s"): "Abbott Becker Castro Dumont Ellis Fischer Garcia Hansen Ibarra Jansen Keller Lambert Morel Novak Olsen Porter".split(),
    ("Cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Нина Ольга Полина Раиса София Тамара Юлия".split(),
    ("Cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Юрий".split(),
    ("Cyrillic", "s"): "Авдеенко Бойко Вдовенко Гриценко Дорош Ермак Жук Зайченко Кравец Лысенко Мороз Назарук Остапенко Панченко Савчук Ткач".split(),
}
#: What names grow by when they are drawn again, and how they end then.
SYLLABLES = {"Latin": [c + v for c in "bdfgklmnprstvzj" for v in "aeiou"], "Cyrillic": [c + v for c in "бвгджзклмнпрстх" for v in "аеиоу"]}
ENDINGS = {("Latin", "f"): "na", ("Latin", "m"): "no", ("Latin", "s"): "r", ("Cyrillic", "f"): "на", ("Cyrillic", "m"): "н", ("Cyrillic", "s"): "р"}
#: Country codes of one and of two digits; the others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"

#: Entities that a task draws.
TASK_ENTITIES = 1000
MOST_TASKS = 4096
#: Surrogates that are drawn again are of their entity's length this often before they grow.
SAME_LENGTH = 3


def may_have(text: Column) -> Column:
    """False only for texts without an entity."""
    low, out = F.lower(text), F.contains(text, F.lit(SIGNS[0]))
    for sign in SIGNS[1:]:
        out = out | F.contains(text, F.lit(sign))
    for sign in SIGNS_ANY_CASE:
        out = out | F.contains(low, F.lit(sign))
    return out


def kind_of(entity: Column) -> Column:
    """The first detector that matches all of the entity."""
    out = F.lit(None).cast("string")
    for kind, p in reversed(DETECTORS.items()):
        # Look-around sees the text's neighbours, which an entity by itself doesn't have.
        out = F.when(entity.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return out


def _sex(lead: Column) -> Column:
    return F.when(lead.rlike(rf"^(?:{TITLES_F})\b"), "f").when(lead.rlike(rf"^(?:{TITLES_M})\b"), "m").otherwise("n")


def _lead(entity: Column) -> Column:
    return F.regexp_extract(entity, LEAD, 0)


def _core(entity: Column) -> Column:
    return F.regexp_replace(entity, LEAD, "")


def _byte(h: Column, i: Column) -> Column:
    """A number from 0 to 65535 from place i of a hex string of 128 digits."""
    return F.conv(h.substr((i * 4) % 125 + 1, F.lit(4)), 16, 10).cast("int")


def _shaped(core: Column, h: Column, keep: Column) -> Column:
    """core with each digit and ASCII letter after the first keep characters replaced by another of its class."""

    def one(c: Column, at: Column) -> Column:
        i = at + 1
        b = _byte(h, i)
        made = F.when(c.between("0", "9"), F.chr(F.lit(48) + b % 10)).when(c.between("a", "z"), F.chr(F.lit(97) + b % 26)).when(c.between("A", "Z"), F.chr(F.lit(65) + b % 26)).otherwise(c)
        return F.when(i <= keep, c).otherwise(made)

    return F.array_join(F.transform(F.split(core, ""), one), "")


def _luhn(digits: Column, double_first: bool) -> Column:
    """The Luhn sum of digits from the right; double_first: the last one counts double."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.coalesce(turned.substr(i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == (1 if double_first else 0), 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), n % len(words) + 1)


def draw(entity: Column, kind: Column, sex: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits that depend on the key, the entity and the attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, sex, entity, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|more")), 256))


def entity_of(core: Column, kind: Column) -> Column:
    """What is equal for all mentions of an entity."""
    plain = F.regexp_replace(core, "[^0-9A-Za-z]", "")
    number = F.when((kind == "phone") & core.startswith("+"), F.concat(F.lit("+"), plain)).otherwise(plain)
    return F.when(kind == "email", F.lower(core)).when(kind.isin("phone", "ssn", "iban", "card"), number).otherwise(core)


def in_form(surrogate_: Column, core: Column, kind: Column) -> Column:
    """An entity's surrogate with the separators, or the capitals, of a mention."""
    letters = F.regexp_replace(surrogate_, "[^0-9A-Za-z]", "")

    def nth(c: Column, at: Column) -> Column:
        before = F.length(F.regexp_replace(core.substr(F.lit(1), at + 1), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("^[0-9A-Za-z]$"), letters.substr(before, F.lit(1))).otherwise(c)

    def cased(c: Column, at: Column) -> Column:
        return F.when(core.substr(at + 1, F.lit(1)).rlike("^[A-Z]$"), F.upper(c)).otherwise(c)

    local = F.split_part(surrogate_, F.lit("@"), F.lit(1))
    mail = F.concat(F.array_join(F.transform(F.split(local, ""), cased), ""), F.lit("@"), F.split_part(surrogate_, F.lit("@"), F.lit(2)))
    # A surrogate that has grown ends in what is beyond the mention's own places.
    number = F.concat(F.array_join(F.transform(F.split(core, ""), nth), ""), letters.substr(F.length(F.regexp_replace(core, "[^0-9A-Za-z]", "")) + 1, F.length(letters)))
    return F.when(kind == "email", mail).when(kind.isin("phone", "ssn", "iban", "card"), number).otherwise(surrogate_)


def shape(entity: Column, kind: Column, h: Column) -> Column:
    """The entity with its digits and letters drawn anew, but for the first ones of some kinds. h: a column that holds draw()."""
    start = lambda p: F.length(F.regexp_extract(entity, p, 0))
    keep = (
        F.when(kind == "card", 1).when(kind == "phone", start(COUNTRY + "|^0"))
        .when(kind.isin("key", "iban"), start(r"^(?:AKIA|gh[pousr]_|github_pat_|sk-|[A-Z]{2}(?=\d\d))")).otherwise(0)
    )
    return _shaped(entity, h, keep)


def surrogate(entity: Column, kind: Column, sex: Column, attempt: Column, h: Column, shaped: Column) -> Column:
    """The attempt-th surrogate of an entity. Names drawn again grow by two syllables an attempt, others by four digits once SAME_LENGTH draws have failed.

    h, shaped: columns that hold draw() and shape(); they are read for every character.
    """
    n = lambda i: _byte(h, F.lit(i))
    # Four digits more for each draw beyond SAME_LENGTH, as text; none before.
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - SAME_LENGTH, F.lit(1))), lambda i: F.lpad((_byte(h, i + 40) % 10000).cast("string"), 4, "0")), "")
    more = F.when(attempt > SAME_LENGTH, more).otherwise(F.lit(""))
    local = F.split_part(shaped, F.lit("@"), F.lit(1))
    email = F.concat(local, F.lit("@mail"), (n(17) % 1000).cast("string"), more, F.lit(".example."), _pick(["com", "net", "org"], n(18)))
    ip = F.concat_ws(".", *[(n(i) % 254 + 1).cast("string") for i in (3, 5, 7, 9)])
    # The addresses that are set apart for documentation, once those of four numbers are crowded.
    ip = F.when(attempt > SAME_LENGTH, F.concat(F.lit("2001:db8:"), F.concat_ws(":", *[F.substring(h, i, 4) for i in range(1, 25, 4)]))).otherwise(ip)
    body = F.concat(shaped.substr(F.lit(1), F.length(shaped) - 1), more)
    check = (10 - _luhn(F.regexp_replace(body, "[^0-9]", ""), True) % 10) % 10
    shaped = F.concat(shaped, more)
    card = F.when(_luhn(F.regexp_replace(entity, "[^0-9]", ""), False) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(shaped)

    def word(script: str) -> Column:
        grown = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), attempt * 2)), lambda i: _pick(SYLLABLES[script], _byte(h, i))), "")
        of = lambda g: F.concat(_pick(NAMES[script, g], n(2)), F.when(attempt > 0, F.concat(grown, F.lit(ENDINGS[script, g]))).otherwise(F.lit("")))
        female = (sex == "f") | ((sex == "n") & (n(11) % 2 == 0))
        return F.when(kind == "surname", of("s")).when(female, of("f")).otherwise(of("m"))

    secret = F.when(entity.rlike("^[0-9a-f]{12,}$"), F.repeat(h, F.ceil(F.length(entity) / 128).cast("int")).substr(F.lit(1), F.length(entity))).otherwise(shaped)
    named = F.when(entity.rlike(r"\p{IsCyrillic}"), word("Cyrillic")).otherwise(word("Latin"))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind.isin("given", "surname"), named).when(kind == "secret", secret)
        .otherwise(shaped)
    )


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entity, kind, sex (each entity once) -> entity, replacement, with no clash among replacements or with entities.

    What is settled stays; only entities whose surrogate clashes are drawn again, and these grow, so a form with fewer members than
    entities, such as seven digits, ends like any other.
    """
    real = materialize(entities.select(F.regexp_replace("entity", "^given ", "").alias("real")).distinct(), "pii-real")
    open_, settled = materialize(entities.withColumn("attempt", F.lit(0)), "pii-entities"), None
    while n := open_.count():
        # A fixed number of tasks, as a merged one would draw them all.
        drawn = open_.repartition(max(1, min(MOST_TASKS, n // TASK_ENTITIES)), "entity").withColumn("h", draw(F.col("entity"), F.col("kind"), F.col("sex"), F.col("attempt"), key))
        drawn = drawn.withColumn("shape", shape(F.col("entity"), F.col("kind"), F.col("h")))
        drawn = drawn.withColumn("replacement", surrogate(F.col("entity"), F.col("kind"), F.col("sex"), F.col("attempt"), F.col("h"), F.col("shape"))).drop("h", "shape")
        drawn = materialize(drawn, "pii-drawn")
        owners = drawn.groupBy(F.col("replacement").alias("of")).agg(F.min("entity").alias("owner"))
        checked = drawn.join(owners, F.col("replacement") == F.col("of")).join(real, F.col("replacement") == F.col("real"), "left")
        clash = (F.col("entity") != F.col("owner")) | F.col("real").isNotNull()
        if settled is not None:
            checked = checked.join(settled.select(F.col("replacement").alias("held")), F.col("replacement") == F.col("held"), "left")
            clash = clash | F.col("held").isNotNull()
        checked = materialize(checked.select("entity", "kind", "sex", (F.col("attempt") + 1).alias("attempt"), "replacement", clash.alias("clash")), "pii-checked")
        done = checked.where(~F.col("clash")).select("entity", "replacement")
        settled = done if settled is None else settled.unionByName(done)
        open_ = checked.where("clash").drop("clash", "replacement")
    return entities.select("entity", F.lit("").alias("replacement")) if settled is None else settled


def _parts(entity: Column) -> Column:
    """(lead, core, kind, sex) of what a mention consists of: the words of a name, else one."""
    lead, core, kind = _lead(entity), _core(entity), F.coalesce(kind_of(entity), F.lit("other"))
    words, gaps = F.regexp_extract_all(core, F.lit(r"\p{L}+"), F.lit(0)), F.regexp_extract_all(core, F.lit("[ -]"), F.lit(0))
    given = F.size(F.regexp_extract_all(F.regexp_extract(core, "^(.*) ", 1), F.lit(r"\p{L}+"), F.lit(0)))  # the words before the last blank

    def named(w: Column, i: Column) -> Column:
        return F.struct(
            F.when(i == 0, lead).otherwise(F.get(gaps, i - 1)).alias("lead"), w.alias("core"), F.when(i < given, F.lit("given")).otherwise(F.lit("surname")).alias("kind"), F.when(i < given, _sex(lead)).otherwise(F.lit("n")).alias("sex")
        )

    whole = F.array(F.struct(lead.alias("lead"), core.alias("core"), kind.alias("kind"), F.lit("n").alias("sex")))
    return F.when(kind == "name", F.transform(words, named)).otherwise(whole)


def replace_pii(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """df with the entities of the text replaced; count_col: a column of the number of mentions, if named; length_col: one of the text's characters to renew, if named."""
    hashed, its, swaps, total = fresh(df, "text_hash", "its_hash", "replacements", "mentions")
    text, order = F.col(f"`{text_col}`"), [c for c in df.columns if c != count_col]
    has = F.coalesce(may_have(text) & text.rlike(PATTERN), F.lit(False))
    some = df.where(has).withColumn(hashed, F.sha2(text, 256))
    # Each distinct text's mentions once: (hash, place, part, lead, core).
    found = some.groupBy(F.col(hashed).alias("h")).agg(F.first(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("e"))
    found = found.select("h", F.posexplode("e").alias("place", "mention")).withColumn("parts", _parts(F.col("mention")))
    found = found.select("h", "place", F.size("parts").alias("size"), F.posexplode("parts").alias("part", "p"))
    # A given name and a surname of one spelling are two entities.
    entity = F.concat(F.when(F.col("p.kind") == "given", F.lit("given ")).otherwise(F.lit("")), entity_of(F.col("p.core"), F.col("p.kind")))
    found = materialize(found.select("h", "place", "part", (F.col("part") + 1 == F.col("size")).alias("last"), "p.*", entity.alias("entity")), "pii-mentions")
    # An entity that is found as several kinds, or under titles of both sexes, is one.
    sexed = F.when(F.col("sex") != "n", F.col("sex"))
    sex = F.when(F.min(sexed) == F.max(sexed), F.min(sexed)).otherwise("n")
    given = assign_surrogates(found.groupBy("entity").agg(F.min("kind").alias("kind"), sex.alias("sex")), key)
    swapped = found.join(given.withColumnRenamed("entity", "e"), F.col("entity") == F.col("e"))
    swapped = swapped.select("h", F.struct("place", "part", F.concat("lead", in_form(F.col("replacement"), F.col("core"), F.col("kind"))).alias("r"), "last").alias("s"))
    swapped = swapped.groupBy("h").agg(F.sort_array(F.collect_list("s")).alias("s"), F.count_if(F.col("s.last")).cast("int").alias("n"))
    done = some.join(swapped.select(F.col("h").alias(its), F.col("s").alias(swaps), F.col("n").alias(total)), F.col(hashed) == F.col(its))
    between = F.split(text, PATTERN, -1)
    after = lambda s: F.when(s["last"], F.get(between, s["place"] + 1)).otherwise(F.lit(""))
    whole = F.concat(F.element_at(between, 1), F.array_join(F.transform(F.col(swaps), lambda s: F.concat(s["r"], after(s))), ""))
    count = [] if count_col is None else [F.col(total).alias(count_col)]
    none = [] if count_col is None else [F.lit(0).alias(count_col)]
    cols = lambda t: [t.alias(text_col) if c == text_col else F.length(t).cast(df.schema[c].dataType).alias(c) if c == length_col else F.col(f"`{c}`") for c in order]
    return df.where(~has).select(*cols(text), *none).unionByName(done.select(*cols(whole), *count))
