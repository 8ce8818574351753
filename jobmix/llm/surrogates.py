"""PII surrogates: detected entities get keyed replacements of the same type and format.

1. One pattern marks every entity in a text; the text becomes a list of plain
   pieces and entities by turns.  The words of names are learned behind titles
   and marked wherever the text has them again, with a capital but no title.
2. Entities are brought to a canonical form (an address in lower case, a
   telephone number's last ten digits, a card's digits, one name), so different
   spellings of one entity are one (coreference), in all documents.
3. Each distinct entity gets a surrogate from a keyed hash: letters become
   letters, digits digits, an IP address stays one, a card number that passes
   the Luhn test gets one that does, a name gets a name of the same script and
   gender.  A surrogate that two entities share, or that is itself an entity of
   the corpus, is given up by all but one and derived anew, until all differ;
   after some attempts it grows, so that every entity ends with one of its own.
4. Every mention is replaced in its own spelling: capitals, brackets, dashes
   and country codes stay as they were.

All of it is column expressions and joins; the key should be kept secret.
Without the key nothing leads back, and the same key gives the same surrogates.

Results for odd input: a null or empty text has no entities and gives an empty
text; a null ``doc_id`` stays null; repeated rows are replaced each; the two
noncharacters used as marks are dropped from texts; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.llm.common import materialize, table
from jobmix.llm.quality import let

OPEN, CLOSE = "\ufdd0", "\ufdd1"  # noncharacters: no text should hold them
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MALE = "Mr Mister Herr Herrn Monsieur Señor Sr Sir Lord Г-н Господин Κος Κύριος"
FEMALE = "Mrs Ms Miss Frau Fräulein Madame Madam Mme Mlle Mademoiselle Señora Señorita Sra Srta Lady Г-жа Госпожа Κα Κυρία"
OTHER = "Dr Doctor Doktor Docteur Doctora Dra Prof Professor Professeur Profesor Profesora Mx Rev Capt Sgt"


def titles(words: str) -> str:
    """A pattern of titles as they are and in capitals, the longest first."""
    return "|".join(sorted({t for w in words.split() for t in (w, w.upper())}, key=lambda t: (-len(t), t)))


TITLE = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}])(?:{titles(f'{MALE} {FEMALE} {OTHER}')})\.?[\s\u00a0]{{1,3}}"
# Words with a capital that no name is made of, but that may follow what looks like a title.
NO_NAMES = ("The Then This That There He She It We They You And But Or In On At Of For From If As When While Der Die Das "
            "Und Aber Er Sie Es Wir Ich El Los Las Le Les La Un Una Une Et Mais Il Elle Pero Он Она И Но В На Ο Η Το Και")
NOT_NAME = rf"(?!(?:{'|'.join(NO_NAMES.split())})(?![\p{{L}}\p{{M}}]))"
# A name is made of words, joined by apostrophes and hyphens (O'Brien, Jean-Luc); a single letter alone is none.
WORD = r"[\p{L}\p{M}]{2,}+"
NAME_WORD = rf"(?<![\p{{L}}\p{{M}}])(?:(?=\p{{Lu}})|(?<=\p{{L}}['’-])){WORD}"
PARTICLE = r"(?:von|vom|van|der|den|de|del|della|di|da|do|dos|du|la|le|zu|zur|bin|ibn|al|el|y|e)[ \u00a0]|\p{Lu}\.[ \u00a0]?"
JOINED = rf"(?:{PARTICLE}){{0,4}}{NOT_NAME}\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['’-](?=\p{{L}}))++"
TITLED = rf"(?:{TITLE})+{JOINED}(?:[ \u00a0]{JOINED}){{0,3}}"

# From this attempt on surrogates grow by a character each time: shapes may have nothing to replace, or be used up.
GROW_AFTER = 4
# A secret runs to its end, however long; a dot, an exclamation mark or an at sign only where it goes on behind it.
# It holds a letter or a digit: a line of dashes is none.
IN_VALUE = r"[\p{IsLatin}0-9+/_=~#$%^*-]"
VALUE = rf"(?=[+/_=~#$%^*.!@-]*+[\p{{IsLatin}}0-9])(?:{IN_VALUE}|[.!@]++(?={IN_VALUE})){{8,}}+"

# Patterns by kind; where several match at one place the first wins.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": rf"(?=[AaPpSsTt])(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?{VALUE}",
    "ip": rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.[0-9])",
    "card": r"(?<![\w.])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![\w])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\w])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
}
# A secret's introduction, and the secret.
SECRET_VALUE = "^([^=:]*[=:][ ]{0,2}[\"']?)(.*)$"
# A text that holds none of these holds no entity.
SIGNS = ("@", "AKIA", "=", ":")
# What begins with a digit, a plus or a bracket is looked at only there.
NUMBERS = ("ip", "card", "phone", "ssn")
ANY = "|".join([f"(?:{PATTERNS['email']})", f"(?:{PATTERNS['key']})",
                f"(?=[0-9+(])(?:{'|'.join(PATTERNS[k] for k in NUMBERS)})",
                f"(?:{PATTERNS['secret']})"])
# In a text with titled names, each word that may be one of them is marked, too.
ANY_OR_WORD = f"{ANY}|(?:{NAME_WORD})"

# Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Albert Carl Daniel David Emil Felix George Henry Jacob Leon Louis Martin Oscar Paul Simon",
    ("latin", "f"): "Alice Anna Clara Diana Elena Emma Eva Flora Helen Ida Julia Laura Maria Nina Olivia Sofia",
    ("cyrillic", "m"): "Антон Борис Виктор Денис Егор Иван Кирилл Максим Никита Олег Павел Роман Сергей Степан Фёдор Юрий",
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Елена Зоя Ирина Клара Лариса Мария Нина Ольга Раиса София Юлия",
    ("greek", "m"): "Αλέξης Ανδρέας Γιάννης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάριος Μιχάλης Νίκος Παύλος Πέτρος Σπύρος Στέλιος Φώτης",
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ευαγγελία Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα Άρτεμις Φωτεινή",
}
# Syllables that invented names are made of, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta".split(),
    "cyrillic": "ба бе бо да де до га го за зо ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та то".split(),
    "greek": "βα βε βο γα γε γο δα δε δο ζα ζε ζο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε".split(),
}


def keyed(key: str, *parts: Column) -> Column:
    """256 bits as hex digits: a hash under a secret key, twice as in HMAC."""
    inner = F.sha2(F.concat_ws("\u001f", F.lit(f"{key}:i"), *[p.cast("string") for p in parts]), 256)
    return F.sha2(F.concat(F.lit(f"{key}:o"), inner), 256)


def number(stream: Column, at: Column | int) -> Column:
    """The ``at``-th (from 0) byte of a hex stream, starting over at its end."""
    place = (F.lit(at) if isinstance(at, int) else at) * 2 % F.length(stream)
    return F.conv(F.substring(stream, place + 1, F.lit(2)), 16, 10).cast("int")


def letter(stream: Column, at: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), number(stream, at) % len(alphabet) + 1, F.lit(1))


def same_shape(text: Column, stream: Column) -> Column:
    """Letters for letters, digits for digits, hex digits for hex; the rest as it is."""
    def one(c: Column, i: Column, is_hex: Column, stream: Column) -> Column:
        return (F.when(is_hex, letter(stream, i, "0123456789abcdef"))
                .when(c.rlike("[0-9]"), letter(stream, i, "0123456789"))
                .when(c.rlike(r"\p{Lu}"), letter(stream, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike(r"\p{L}"), letter(stream, i, "abcdefghijklmnopqrstuvwxyz")).otherwise(c))
    # The stream and the test are computed once, not for each character: secrets may be long.
    once = F.struct((text.rlike("^[0-9a-f]++$") & text.rlike("[a-f]")).alias("is_hex"), stream.alias("stream"))
    return let(once, lambda o: F.array_join(F.transform(
        F.split(text, ""), lambda c, i: one(c, i, o["is_hex"], o["stream"])), ""))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counted once."""
    def one(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 0, doubled).otherwise(d)
    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)


def with_check_digit(digits: Column) -> Column:
    """The digits with the last one set so that the Luhn test is passed."""
    body = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1),
                    ((10 - luhn_sum(body) % 10) % 10).cast("string"))


def kind_of(entity: Column) -> Column:
    """The kind of an entity; NULL for a word that may be a name."""
    found = F.when(entity.rlike(f"^(?:{PATTERNS['secret']})$"), "secret")
    found = found.when(entity.rlike("@"), "email")
    for kind in ("key", "ip", "card", "ssn", "phone"):
        found = found.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return found


def script_of(text: Column) -> Column:
    return (F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek")
            .otherwise("latin"))


def canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn"), digits)
            .when(kind == "secret", F.regexp_extract(entity, SECRET_VALUE, 2))
            .when(kind.isin("email", "name", "surname"), F.lower(entity)).otherwise(entity))


def surrogate(kind: Column, canon: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical form, in canonical form."""
    stream = F.concat(keyed(key, kind, canon, attempt), keyed(key, kind, canon, attempt, F.lit("more")))
    grown = F.greatest(attempt - GROW_AFTER, F.lit(0))
    letters, digits = (same_shape(F.repeat(F.lit(c), grown), F.reverse(stream)) for c in ("x", "0"))
    shaped = same_shape(canon, stream)
    # The part of an address after the last dot stays.
    tail = F.regexp_extract(canon, r"\.[^.]*$", 0)
    email = F.concat(letters, F.substring(shaped, F.lit(1), F.length(canon) - F.length(tail)), tail)
    ip = F.concat_ws(".", *[(number(stream, i) % (223 if i == 0 else 255) + 1).cast("string") for i in range(4)])
    ip = F.when(grown > 0, F.concat(ip, F.lit("."), digits)).otherwise(ip)
    first = F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(shaped, F.lit(2), F.length(canon)), digits)
    card = F.when(luhn_sum(canon) % 10 == 0, with_check_digit(first)).otherwise(first)
    phone = F.concat(F.substring(F.lit("23456789"), number(stream, 40) % 8 + 1, F.lit(1)),
                     F.substring(shaped, F.lit(2), F.length(canon)), digits)
    script = script_of(canon)
    names = F.lit(None).cast("string")
    for (s, g), given in GIVEN.items():
        words = F.array(*[F.lit(w.lower()) for w in given.split()])
        names = F.when((script == s) & (gender == g), F.get(words, number(stream, 0) % F.size(words))).otherwise(names)
    made = F.lit(None).cast("string")
    for s, parts in SYLLABLES.items():
        words = F.array(*[F.lit(w) for w in parts])
        some = F.transform(F.sequence(F.lit(1), F.lit(3) + attempt),
                           lambda i: F.get(words, number(stream, i) % F.size(words)))  # noqa: B023
        made = F.when(script == s, F.array_join(some, "")).otherwise(made)
    # A given name from the list at first, then with an invented ending.
    name = F.when(attempt == 0, F.coalesce(names, made)).otherwise(
        F.concat(F.coalesce(names, F.lit("")), F.substring(made, F.lit(1), F.lit(2) + 2 * attempt)))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card)
            .when(kind == "phone", phone).when(kind == "name", name).when(kind == "surname", made)
            .when(kind == "key", F.concat(F.lit("AKIA"), F.substring(shaped, F.lit(5), F.length(canon)), digits))
            .when(kind == "ssn", F.concat(shaped, digits)).otherwise(F.concat(shaped, letters)))


def spelled(kind: Column, entity: Column, replacement: Column) -> Column:
    """A replacement in the spelling of a mention."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    extra = F.length(digits) - F.length(replacement)
    laid = F.concat(F.substring(digits, F.lit(1), F.greatest(extra, F.lit(0))), replacement)

    def digit(c: Column, i: Column) -> Column:
        seen = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(laid, seen, F.lit(1))).otherwise(c)

    def cased(c: Column, i: Column) -> Column:
        own = F.substring(replacement, i + 1, F.lit(1))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(own)).otherwise(own)

    def and_grown(laid_out: Column, full: Column, places: Column) -> Column:
        return F.concat(F.array_join(laid_out, ""), F.substring(full, places + 1, F.length(full)))

    chars = F.split(entity, "")
    return (F.when(kind.isin("phone", "card", "ssn"), and_grown(F.transform(chars, digit), laid, F.length(digits)))
            .when(kind == "email", and_grown(F.transform(chars, cased), replacement, F.length(entity)))
            .when(kind == "secret", F.concat(F.regexp_extract(entity, SECRET_VALUE, 1), replacement))
            .when(kind.isin("name", "surname"),
                  F.when(entity.rlike(r"^\p{Ll}"), replacement).when(~entity.rlike(r"\p{Ll}"), F.upper(replacement))
                  .otherwise(F.concat(F.upper(F.left(replacement, F.lit(1))),
                                      F.substring(replacement, F.lit(2), F.length(replacement)))))
            .otherwise(replacement))


def names_in(text: Column) -> Column:
    """The words of the titled names of a text: ``canon, kind, gender``; the first word of a name is a given name."""
    def words(titled: Column) -> Column:
        name = F.regexp_replace(titled, f"^(?:{TITLE})+", "")
        female = titled.rlike(rf"^(?:{TITLE})*?(?:{titles(FEMALE)})\.?[\s\u00a0]")
        return F.transform(F.regexp_extract_all(name, F.lit(NAME_WORD), 0), lambda w, i: F.struct(
            F.lower(w).alias("canon"), F.when(i == 0, "name").otherwise("surname").alias("kind"),
            F.when(i > 0, "").when(female, "f").otherwise("m").alias("gender")))
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TITLED), 0), words)))


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, text_id, pieces, names``: plain pieces and entities (or words that may be names) by turns, and names."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), f"[{OPEN}{CLOSE}]", "")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    text, has_names = F.col("text"), F.col("text").rlike(TITLED)
    split = lambda pattern: F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")
    may_hold = text.rlike("[0-9]")
    for sign in SIGNS:
        may_hold = may_hold | F.contains(text, F.lit(sign))
    pieces = F.when(has_names, split(ANY_OR_WORD)).when(may_hold, split(ANY)).otherwise(F.array(text))
    names = F.when(F.size(pieces) > 1, names_in(text))
    return (texts.select("doc_id", pieces.alias("pieces"), names.alias("names"))
            .select("doc_id", F.xxhash64("pieces").alias("text_id"), "pieces", "names"))


def mentions(pieces: DataFrame) -> DataFrame:
    """``doc_id, text_id, place, entity, kind, canon, gender``: a row per entity in a text.

    A word is a mention of a name if the same text has it behind a title
    anywhere, in any capitals; in a text a name is of one kind and gender.
    """
    at = ["doc_id", "text_id"]
    found = pieces.where(F.size("pieces") > 1).select(
        *at, F.explode(F.filter(F.transform("pieces", lambda p, i: F.struct(i.alias("place"), p.alias("entity"))),
                                lambda s: s["place"] % 2 == 1)).alias("m")).select(*at, "m.*")
    kinds = found.withColumn("kind", kind_of(F.col("entity")))
    sure = kinds.where("kind is not null").select(
        *at, "place", "entity", "kind", canonical(F.col("kind"), F.col("entity")).alias("canon"), F.lit("").alias("gender"))
    # One that is ever behind another name is a surname.
    names = (pieces.where(F.size("names") > 0).select(*at, F.explode("names").alias("n")).select(*at, "n.*")
             .groupBy(*at, "canon").agg(F.max("kind").alias("kind"), F.min("gender").alias("gender"))
             .select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"), F.col("canon").alias("_canon"),
                     "kind", F.when(F.col("kind") == "name", F.col("gender")).otherwise("").alias("gender")))
    words = kinds.where("kind is null").select(*at, "place", "entity", F.lower("entity").alias("canon"))
    named = words.join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text"))
                       & (F.col("canon") == F.col("_canon")))
    return sure.unionByName(named.select(*at, "place", "entity", "kind", "canon", "gender"))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``kind, canon, gender, replacement`` of every distinct entity; replacements of a kind all differ.

    Every round the entities left derive a replacement.  Of those with the
    same one the smallest entity keeps it, unless it is taken or is an entity
    itself; the others try again.
    """
    left = materialize(found.select("kind", "canon", "gender").distinct().withColumn("attempt", F.lit(0)))
    taken = left.select("kind", F.col("canon").alias("replacement")).distinct()
    done = None
    while not left.isEmpty():
        tried = materialize(left.withColumn("replacement", surrogate(
            F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"), key)))
        first = (tried.groupBy("kind", "replacement").agg(F.min(F.struct("canon", "gender")).alias("w"))
                 .join(taken, ["kind", "replacement"], "left_anti")
                 .select("kind", "w.canon", "w.gender", "replacement"))
        kept = materialize(first)
        done = kept if done is None else done.union(kept)
        taken = taken.union(kept.select("kind", "replacement"))
        left = materialize(tried.join(kept.select("kind", "canon", "gender"), ["kind", "canon", "gender"], "left_anti")
                           .select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt")))
    return left.select("kind", "canon", "gender", F.lit("").alias("replacement")) if done is None else done


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, n_entities, kinds, text``: every row of ``docs`` with its entities replaced.

    Texts are shuffled once, to meet their replacements; the entities of a
    text come as one map, at most as large as the text.
    """
    pieces = marked(docs)
    found = materialize(mentions(pieces))
    names = surrogates(found, key)
    by_text = (found.join(names, ["kind", "canon", "gender"])
               .select("doc_id", "text_id", "place", "kind",
                       spelled(F.col("kind"), F.col("entity"), F.col("replacement")).alias("put"))
               # Equal rows of the input have equal mentions.
               .distinct().groupBy(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"))
               .agg(F.map_from_entries(F.collect_list(F.struct("place", "put"))).alias("put"),
                    F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")))
    joined = pieces.join(by_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text")), "left")
    whole = F.transform("pieces", lambda p, i: F.coalesce(F.col("put")[i], p))
    return joined.select("doc_id", F.when(F.col("put").isNull(), 0).otherwise(F.size("put")).cast("bigint").alias("n_entities"),
                         F.coalesce("kinds", F.lit("")).alias("kinds"),
                         F.when(F.col("put").isNull(), F.array_join("pieces", ""))
                         .otherwise(F.array_join(whole, "")).alias("text"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key of the registered query is public; a user passes a secret one.
    return pseudonymize(table(spark, sf_dir, "documents"), key="jobmix")
