"""Personal data: every entity gets a keyed surrogate of its own type, script, gender and format.

All of it is DataFrame operations. One pattern cuts a text into what is left alone and the entities; an
entity has one part or, for names, one for each word. The distinct parts of the whole corpus (by kind and
canonical form) make a table; each draws its surrogate from a keyed digest. Surrogates that two
parts drew, or that occur in the corpus themselves, are drawn again until none is left: so
different entities stay different, and an entity looks the same wherever it turns up.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import dropped, saved

# Titles, given names and surnames by script and gender.
TITLES = {"m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Госпожа"], "n": ["Dr", "Prof"]}
GIVEN = {
    ("latin", "m"): ["James", "Robert", "Michael", "William", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Hans", "Jürgen", "Wolfgang", "Stefan", "Pierre", "François", "Jacques", "Carlos", "Miguel", "Javier"],
    ("latin", "f"): ["Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Margaret", "Dorothy", "Nancy", "Ursula", "Ingrid", "Katharina", "Sabine", "Amélie", "Hélène", "Juliette", "Carmen", "Isabel", "Lucía"],
    ("cyrillic", "m"): ["Иван", "Дмитрий", "Сергей", "Алексей", "Николай", "Михаил", "Андрей", "Павел"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Татьяна", "Наталья", "Ирина", "Светлана"],
}
SURNAMES = {
    "latin": ["Smith", "Johnson", "Williams", "Brown", "Miller", "Davis", "Wilson", "Anderson", "Taylor", "Moore", "Müller", "Schmidt", "Schneider", "Fischer", "Weber", "Dubois", "Moreau", "Lefebvre", "García", "Martínez", "Rodríguez", "López", "Fernández", "Romero"],
    "cyrillic": ["Иваненко", "Петренко", "Сидоренко", "Кравченко", "Шевченко", "Бондаренко", "Ткаченко", "Савченко"],
}
# By script its block's name, sixteen syllables, and the endings of male, female and other given names.
SCRIPTS = {
    "latin": ("Latin", "ba del fer gan hol kem lor mar nel por ros sten tor vel wen zim", "o a e"),
    "cyrillic": ("Cyrillic", "ба дел фер ган хол кем лор мар нел пор рос стен тор вел вен зим", "ий а о"),
    "greek": ("Greek", "βα δελ φερ γαν χολ κεμ λορ μαρ νελ πορ ροσ στεν τορ βελ βεν ζιμ", "ος α ι"),
    "armenian": ("Armenian", "բա դել ֆեր գան հոլ կեմ լոր մար նել պոր րոս ստեն տոր վել վեն զիմ", "ո ա ե"),
    "hebrew": ("Hebrew", "בא דל פר גן הל קם לר מר נל פו רס סט טר ול ון זם", "ון ה י"),
    "arabic": ("Arabic", "با دل فر غن حل كم لر مر نل بر رس ست تر ول ون زم", "ن ة ي"),
    "devanagari": ("Devanagari", "बा दे फे गा हो के लो मा ने पो रो से तो वे वी जी", "न ी े"),
    "kana": ("Katakana", "バ デ フ ガ ホ ケ ロ マ ネ ポ ラ セ ト ベ ウ ジ", "オ ア エ"),
    "hiragana": ("Hiragana", "ば で ふ が ほ け ろ ま ね ぽ ら せ と べ う じ", "お あ え"),
    "hangul": ("Hangul", "바 델 페 간 홀 켐 로 마 넬 포 라 세 토 벨 원 짐", "호 희 영"),
    "han": ("Han", "文 德 方 高 海 金 林 明 宁 平 荣 世 天 伟 云 泽", "强 丽 安"),
}
KEY = "spark.lexquarry.surrogates.key"
COMPACT = ("kana", "hiragana", "hangul", "han")  # scripts of short names
MOST = 15  # syllables of a name after many attempts


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}"
PHONE = r"(?<![0-9.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?|[0-9]{3}[ .-][0-9]{3}[ .-])[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KEY = r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"
LABEL = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}"
SECRET = rf"""{LABEL}(?:"[^"\s]{{6,}}+"|'[^'\s]{{6,}}+'|(?=[^\s"',;]*[0-9])[^\s"',;]{{6,}}+)"""
TITLE = rf"(?:{_any([t for x in TITLES.values() for t in x])})(?:\. ?| )"
WORD = r"\p{Lu}\p{Ll}+"
LABELLED = r"(?:Full name|Name|Patient|Attn|Signed|Signed by|Nombre|Nom|Vorname|Nachname)[:.] ?|My name is "
# after a title in any script, after a label, or with a common given name
NAME = rf"(?<![\p{{L}}])(?:{TITLE}(?:{WORD}(?:[ -]{WORD}){{0,2}}|\p{{Lo}}[\p{{Lo}}\p{{M}}]+(?:[ -]\p{{Lo}}[\p{{Lo}}\p{{M}}]+){{0,2}})|(?:{LABELLED}){WORD}(?:[ -]{WORD}){{1,2}}|(?:{_any([g for x in GIVEN.values() for g in x])})(?: {WORD}){{1,2}})(?![\p{{L}}\p{{M}}])"
# what a match can begin with comes first, so that most places of a text fail at once
ENTITY = rf"(?:(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9._%+-])(?:{EMAIL})|(?=[0-9+(])(?:{PHONE}|{SSN}|{IP}|{CARD})|(?<![A-Za-z])(?=[A-Zgs])(?:{IBAN}|{KEY})|(?=[ApstPSTaA])(?:{SECRET})|(?<!\p{{L}})(?=\p{{Lu}})(?:{NAME}))"
KINDS = {"email": EMAIL, "secret": SECRET, "key": KEY, "ip": IP, "phone": PHONE, "ssn": SSN, "card": CARD, "iban": IBAN}
DIGITS = ("phone", "ssn", "card")


def _lits(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _script(word: Column) -> Column:
    """The place in SCRIPTS of the word's script; Latin if it has none of them."""
    out = F.lit(0)
    for at, (block, _, _) in reversed(list(enumerate(SCRIPTS.values()))):
        out = F.when(word.rlike(rf"\p{{Is{block}}}"), at).otherwise(out)
    return out


def _gender(title: Column, given: Column) -> Column:
    known = [(g, [n for (s, x), names in GIVEN.items() if x == g for n in names]) for g in "mf"]
    title = F.regexp_replace(title, "[. ]", "")
    return F.coalesce(*(F.when(given.isin(names), g) for g, names in known), *(F.when(title.isin(TITLES[g]), g) for g in "mf"), F.lit("n"))


def _parts(e: Column) -> Column:
    """Of an entity: parts with the text before each, the part as it stands, kind and canonical form."""
    part = lambda lead, raw, kind, canon: F.struct(lead.alias("lead"), raw.alias("raw"), kind.alias("kind"), canon.alias("canon"))
    digits = F.regexp_replace(e, "[^0-9]", "")
    label = F.regexp_extract(e, LABEL + "[\"']?", 0)
    value = F.regexp_replace(F.substring(e, F.length(label) + 1, F.length(e)), "[\"']$", "")
    plain = F.array(part(F.lit(""), e, F.lit("email"), F.lower(e)))
    single = F.when(e.rlike(f"^(?:{EMAIL})$"), plain)
    # the closing quotation mark is a part that stays as it is
    single = single.when(e.rlike(f"^{LABEL}"), F.array(part(label, value, F.lit("secret"), value), part(F.lit(""), F.substring(e, F.length(label) + F.length(value) + 1, F.length(e)), F.lit(None).cast("string"), F.lit(None).cast("string"))))
    canon = {"key": e, "ip": e, "phone": F.right(digits, F.lit(10)), "ssn": digits, "card": digits, "iban": F.replace(e, F.lit(" "), F.lit(""))}
    for kind, form in canon.items():
        single = single.when(e.rlike(f"^(?:{KINDS[kind]})$"), F.array(part(F.lit(""), e, F.lit(kind), form)))
    title = F.regexp_extract(e, f"^(?:{TITLE}|{LABELLED})", 0)
    words = F.split(F.substring(e, F.length(title) + 1, F.length(e)), "(?<=[ -])")
    last = F.size(words) - 1
    gender = _gender(title, F.regexp_replace(words[0], "[ -]$", ""))

    def word(w: Column, i: Column) -> Column:
        bare = F.regexp_replace(w, "[ -]$", "")
        before = F.when(i == 0, title).otherwise(F.right(F.get(words, i - 1), F.lit(1)))
        return part(before, bare, F.when(i < last, F.concat(F.lit("given:"), gender)).otherwise("surname"), F.lower(bare))

    return single.otherwise(F.transform(words, word))


def _stream(key: str, *of: Column) -> Column:
    message = F.concat_ws("\x1f", F.lit(key), *of)
    return F.concat(*(F.sha2(F.concat(F.lit(f"{key}{i}"), F.sha2(message, 256)), 256) for i in (0, 1)))


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, F.pmod(i - 1, F.lit(128)) + 1, F.lit(1))


def _shaped(x: Column, hexes: Column, own: Column) -> Column:
    """x with each digit and letter replaced by another of its class, other letters by one of ``own``; hexadecimal strings stay so."""
    digits, letters = F.translate(hexes, "abcdef", "012345"), F.translate(hexes, "0123456789abcdef", "ghijklmnopqrstuv")

    def other(i: Column) -> Column:
        c = F.substring(x, i, F.lit(1))
        foreign = F.substring(own, F.instr(F.lit("0123456789abcdef"), _at(hexes, i)), F.lit(1))
        return F.when(c.rlike("[0-9]"), _at(digits, i)).when(c.rlike("[a-z]"), _at(letters, i)).when(c.rlike("[A-Z]"), F.upper(_at(letters, i))).when(c.rlike(r"\p{Lu}"), F.upper(foreign)).when(c.rlike(r"\p{L}"), foreign).otherwise(c)

    hexa = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: _at(hexes, i))
    return F.array_join(F.when(x.rlike("^(?=[0-9]*[a-f])[0-9a-f]{12,}$"), hexa).otherwise(F.transform(F.sequence(F.lit(1), F.length(x)), other)), "")


def _luhn(x: Column) -> Column:
    n = F.length(x)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, (F.substring(x, i, F.lit(1)).cast("int") * 2) % 10 + F.when(F.substring(x, i, F.lit(1)).cast("int") > 4, 1).otherwise(0)).otherwise(F.substring(x, i, F.lit(1)).cast("int")))


def _mod97(x: Column) -> Column:
    """The remainder of a string of digits and capitals (A is 10) by 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: value(F.substring(x, i, F.lit(1)))), F.lit(0), lambda a, v: (a * F.when(v < 10, 10).otherwise(100) + v) % 97)


def _number(hexes: Column, at: Column) -> Column:
    return F.conv(F.substring(hexes, at, F.lit(6)), 16, 10).cast("long").cast("int")


def _listed(script: str, sex: str) -> list[str]:
    """Names to draw from first: surnames (sex s), or given ones; of no known gender all of the script."""
    if sex == "s":
        return SURNAMES.get(script, [])
    return GIVEN.get((script, sex)) or [n for x in "mf" for n in GIVEN.get((script, x), [])]


def drawn(rows: DataFrame, key: str) -> DataFrame:
    """rows (kind, canon, attempt) with the surrogate of each part at that attempt, in canonical form."""
    letters = F.array(*(F.lit("".join(x[0] for x in syllables.split())) for _, syllables, _ in SCRIPTS.values()))
    told = rows.withColumn("_hex", _stream(key, F.regexp_replace("kind", ":.*", ""), F.col("canon"), F.col("attempt").cast("string"))).withColumn("_script", _script(F.col("canon")))
    told = told.withColumn("_own", F.get(letters, F.col("_script"))).withColumn("_numbers", F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda i: _number(F.col("_hex"), 7 + 6 * i) % 16))
    return told.withColumn("surrogate", _drawn(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("_hex"), F.col("_own"))).drop("_hex", "_script", "_own", "_numbers")


def _name(kind: Column, attempt: Column, hexes: Column) -> Column:
    """A listed name of the script and gender in the first attempts, then one made of syllables."""
    place = F.col("_script") * 4 + F.when(kind == "given:m", 0).when(kind == "given:f", 1).when(kind == "given:n", 2).otherwise(3)
    known = F.get(F.array(*(_lits(_listed(s, sex)) if _listed(s, sex) else F.array().cast("array<string>") for s in SCRIPTS for sex in "mfns")), place)
    ending = F.get(_lits([e for _, _, endings in SCRIPTS.values() for e in [*endings.split(), ""]]), place)
    many = F.get(F.array(*(F.lit((2 if s in COMPACT else 3) + (sex == "s")) for s in SCRIPTS for sex in "mfns")), place) + F.greatest(attempt - 2, F.lit(0))
    syllables = F.get(F.array(*(_lits(syllables.split()) for _, syllables, _ in SCRIPTS.values())), F.col("_script"))
    made = F.concat(F.array_join(F.transform(F.slice("_numbers", F.lit(1), F.least(many, F.lit(MOST))), lambda n: F.get(syllables, n)), ""), ending)
    return F.when((attempt < 2) & (F.size(known) > 0), F.lower(F.get(known, _number(hexes, F.lit(1)) % F.size(known)))).otherwise(made)


def _drawn(kind: Column, canon: Column, attempt: Column, hexes: Column, letters: Column) -> Column:
    digits = F.translate(hexes, "abcdef", "012345")
    dot = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    # whatever many parts draw from too small a space gets longer with the attempts
    more = lambda n: F.translate(F.substring(hexes, F.lit(100), F.least(n, F.lit(16))), "0123456789abcdef", "ghijklmnopqrstuv")
    secret = F.when(~canon.rlike(r"[\p{L}0-9]"), more(attempt + 6)).otherwise(F.concat(_shaped(canon, hexes, letters), F.when(attempt >= 4, more(attempt - 3)).otherwise("")))
    more = F.when(attempt >= 4, more(attempt - 3)).otherwise("")
    email = F.concat(_shaped(F.substring(canon, F.lit(1), dot - 1), hexes, letters), more, F.substring(canon, dot, F.length(canon)))
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 254 + 1).cast("string"))
    # addresses of an inner network stay so as long as there are any left: a larger one, then any
    inner = F.regexp_extract(canon, r"^(?:10\.|192\.168\.)", 0)
    inner = F.when(inner == "", "").when(attempt >= 24, "").when(attempt >= 12, "10.").otherwise(inner)
    ip = F.concat(inner, F.array_join(F.slice(octets, F.when(inner == "", 1).when(inner == "10.", 2).otherwise(3), 4), "."))
    many = F.length(canon)
    phone = F.concat((F.substring(digits, 1, 1).cast("int") % 8 + 2).cast("string"), F.substring(digits, F.lit(2), many - 1))
    ssn = F.substring(digits, F.lit(1), many)
    number = F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(2), many - 2), F.lit("0"))
    check = ((10 - _luhn(number) % 10) % 10).cast("string")
    body = F.substring(number, F.lit(1), many - 1)
    # a valid number stays valid, an invalid one invalid
    card = F.when(_luhn(canon) % 10 == 0, F.concat(body, check)).otherwise(F.concat(body, ((check.cast("int") + 1) % 10).cast("string")))
    country, own = F.substring(canon, 1, 2), _shaped(F.substring(canon, F.lit(5), many), hexes, letters)
    proof = 98 - _mod97(F.concat(own, country, F.lit("00")))
    valid = _mod97(F.concat(F.substring(canon, F.lit(5), many), F.substring(canon, 1, 4))) == 1
    iban = F.concat(country, F.lpad(F.when(valid, proof).otherwise(proof % 97 + 2).cast("string"), 2, "0"), own)
    api = F.concat(F.regexp_extract(canon, "^(?:A[KS]IA|gh[pousr]_|sk-)", 0), _shaped(F.regexp_replace(canon, "^(?:A[KS]IA|gh[pousr]_|sk-)", ""), hexes, letters))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "card", card).when(kind == "iban", iban).when(kind == "key", api).when(kind == "secret", secret)
    return out.otherwise(_name(kind, attempt, hexes))


def rendered(raw: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the part it stands for: punctuation, spaces, capitals."""
    n = F.length(F.regexp_replace(raw, "[^0-9]", "")) - F.length(surrogate)  # digits before the canonical ones stay
    state = lambda out, i: F.struct(out.alias("out"), i.alias("i"))
    filled = F.aggregate(F.split(raw, ""), state(F.lit(""), F.lit(0)), lambda a, c: state(F.concat(a["out"], F.when(c.rlike("[0-9]") & (a["i"] >= n), F.substring(surrogate, a["i"] - n + 1, F.lit(1))).otherwise(c)), a["i"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)), lambda a: a["out"])
    spaced = F.aggregate(F.split(raw, ""), state(F.lit(""), F.lit(0)), lambda a, c: state(F.concat(a["out"], F.when(c == " ", c).otherwise(F.substring(surrogate, a["i"] + 1, F.lit(1)))), a["i"] + F.when(c == " ", 0).otherwise(1)), lambda a: a["out"])
    cased = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(F.substring(raw, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substring(surrogate, i, F.lit(1)))).otherwise(F.substring(surrogate, i, F.lit(1)))), "")
    cased = F.concat(cased, F.substring(surrogate, F.length(raw) + 1, F.length(surrogate)))
    named = F.when((F.length(raw) > 1) & (raw == F.upper(raw)), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    return F.when(kind.isin(*DIGITS), filled).when(kind == "iban", spaced).when(kind == "email", cased).when(kind.isin("ip", "key", "secret"), surrogate).otherwise(named)


def table(parts: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """kind, canon, surrogate for the distinct parts: no two of a class share one, none is a part itself.

    A given name of no known gender is the one that the corpus has with a gender, if that is a single one.
    """
    of_class = F.regexp_replace("kind", ":.*", "")
    asked = saved(parts.groupBy("kind", "canon").count().select("kind", "canon"), "parts", few="coalesce")
    told = asked.filter(F.col("kind").isin("given:m", "given:f")).groupBy("canon").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).filter("low = high").select(F.col("canon").alias("name"), "low")
    sexed = asked.join(told, (F.col("kind") == "given:n") & (F.col("canon") == F.col("name")), "left").select("kind", "canon", F.coalesce("low", "kind").alias("as"))
    alike = sexed.filter(F.col("as") != F.col("kind")).select("kind", F.col("canon").alias("of"), "as")
    asked = sexed.filter(F.col("as") == F.col("kind")).select("kind", "canon")
    rows = saved(drawn(asked.select("kind", "canon", of_class.alias("class"), F.lit(0).alias("attempt")), key), "surrogates", few="coalesce")
    many = rows.count()
    for _ in range(rounds):
        taken = rows.select(F.col("class").alias("c"), F.col("canon").alias("s")).distinct()
        twice = Window.partitionBy("class", "surrogate").orderBy("attempt", "canon", "kind")
        judged = rows.withColumn("place", F.row_number().over(twice)).join(taken, (F.col("class") == F.col("c")) & (F.col("surrogate") == F.col("s")), "left").withColumn("again", (F.col("place") > 1) | F.col("s").isNotNull())
        tried = drawn(judged.select("kind", "canon", "class", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again", F.col("surrogate").alias("old")), key)
        new = saved(tried.select("kind", "canon", "class", "attempt", "again", F.when(F.col("again"), F.col("surrogate")).otherwise(F.col("old")).alias("surrogate")), "surrogates", many)
        dropped(rows.sparkSession, rows)
        rows = new.drop("again")
        if not new.filter("again").limit(1).count():
            every = rows.select("kind", "canon", "surrogate")
            also = alike.join(every.withColumnRenamed("kind", "k"), (F.col("as") == F.col("k")) & (F.col("of") == F.col("canon"))).select("kind", "canon", "surrogate")
            return every.unionByName(also)
    raise RuntimeError("no distinct surrogates were found: some format has too few")


def _told(docs: DataFrame, key: str) -> DataFrame:
    """doc (a struct of all columns of docs, text replaced), n_entities, kinds of every row."""
    columns = docs.columns
    body = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.col("text").alias("body"))
    clean = body.filter(F.col("body").isNull() | ~F.col("body").rlike(ENTITY)).select("doc", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    found = body.filter(F.col("body").rlike(ENTITY)).select("doc", F.split("body", ENTITY, -1).alias("between"), F.regexp_extract_all("body", F.lit(ENTITY), 0).alias("entities"))
    found = saved(found.select(F.monotonically_increasing_id().alias("row"), "doc", "between", F.transform("entities", _parts).alias("of")), "entities", few="repartition")
    flat = found.select("row", F.posexplode(F.flatten("of")).alias("at", "part")).select("row", "at", "part.raw", "part.kind", "part.canon").filter("kind IS NOT NULL")
    drawn_ = table(flat.select("kind", "canon"), key).withColumnsRenamed({"kind": "k", "canon": "c"})
    told = flat.join(drawn_, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c"))).select("row", "at", rendered(F.col("raw"), F.col("kind"), F.col("surrogate")).alias("new"))
    by_doc = told.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("map")).withColumnRenamed("row", "r")  # of one document
    joined = found.join(by_doc, F.col("row") == F.col("r"), "left")
    # lead of an entity's first part: what stands between it and the entity before
    starts = F.transform("of", lambda e, i: F.transform(e, lambda p, j: F.when(j == 0, F.concat(F.get("between", i), p["lead"])).otherwise(p["lead"])))
    text = F.array_join(F.transform(F.flatten(starts), lambda s, k: F.concat(s, F.coalesce(F.element_at(F.col("map"), k), F.get(F.flatten("of"), k)["raw"]))), "")
    text = F.concat(text, F.get("between", F.size("of")))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("of", lambda e: F.when(e[0]["kind"].rlike("^(given|surname)"), "name").otherwise(e[0]["kind"])))), ",")
    doc = F.struct(*(text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in columns))
    return clean.unionByName(joined.select(doc.alias("doc"), F.size("of").cast("long").alias("n_entities"), kinds.alias("kinds")))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text.

    The key alone decides between surrogates: whoever runs it passes their own, and keeps it. Emails (in lower case),
    addresses of machines, phone numbers (their last ten digits), card and social security
    numbers, bank accounts, keys, secrets after a label, and names after a title or a label or with a
    common given name are found. A card or account number with a right check digit gets one with a right one.
    Null texts stay null, empty ones empty; texts without entities stay as they are and aren't shuffled,
    however long. Rows that repeat each give a row with the same surrogates; doc_id isn't used. Parts that drew
    the same surrogate draw again but for the first by attempt, form and kind. Other columns
    are kept, whatever their names. An empty table gives no rows.
    """
    return _told(docs, key).select("doc.*")


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities (how many were found), kinds (sorted, by comma); see replaced()."""
    return _told(docs.select("doc_id", "text"), key).select("doc.doc_id", "doc.text", "n_entities", "kinds")


def session_key(spark: SparkSession) -> str:
    """The key set as KEY, or else one drawn at random for this session."""
    own = spark.conf.get(KEY, None)
    if not own:
        own = secrets.token_hex(32)
        spark.conf.set(KEY, own)
    return own
