"""The Spanish text analyser as Column expressions: fold, cut, drop stopwords, stem."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: everything but these characters separates tokens.
_KEPT = "0123456789abcdefghijklmnopqrstuvwxyzáéíñóúü"


def _complement(kept: str) -> str:
    """Runs of other characters, as ranges: Java's engine takes several times as long for a negated class with signs beyond ASCII."""
    points = [-1, *sorted(map(ord, kept)), 0x110000]
    return "[" + "".join(rf"\x{{{a + 1:x}}}-\x{{{b - 1:x}}}" for a, b in zip(points, points[1:]) if b - a > 1) + "]+"


SEPARATORS = _complement(_KEPT)

# The Spanish stopwords, in their usual order; the forms of four verbs follow from stems and endings.
_FUNCTION_WORDS = (
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre "
    "también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo "
    "otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas "
    "nosotras vosostros vosostras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro "
    "vuestra vuestros vuestras esos esas"
)
_IRREGULAR = (
    "estoy estás está estamos estáis están he has ha hemos habéis han soy eres es somos sois son "
    "era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron siente sentid tengo tienes tiene tenemos tenéis tienen"
)
_ENDINGS = (  # stems, endings
    ("est", "é és emos éis én aba abas ábamos abais aban ando ado ada ados adas ad"),
    ("hay se teng", "a as amos áis an"),
    ("estar habr ser tendr", "é ás á emos éis án ía ías íamos íais ían"),
    ("hab ten", "ía ías íamos íais ían iendo ido ida idos idas"),
    ("estuv hub tuv", "e iste o imos isteis ieron iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen"),
    ("fu", "era eras éramos erais eran ese eses ésemos eseis esen"),
    ("sint", "iendo"),
    ("sent", "ido ida idos idas"),
    ("ten", "ed"),
)


@cache
def spanish_stopwords() -> tuple[str, ...]:
    """The stopwords, sorted."""
    forms = {stem + ending for stems, endings in _ENDINGS for stem in stems.split() for ending in endings.split()}
    return tuple(sorted(forms | {*_FUNCTION_WORDS.split(), *_IRREGULAR.split()}))


def normalise(text: Column) -> Column:
    """Lower case, every run of separators one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))


def _parts(text: Column) -> Column:
    return F.split(normalise(F.coalesce(text, F.lit(""))), " ")


def is_token(word: Column, stopwords: tuple[str, ...] | None = None) -> Column:
    """Whether a word is neither empty nor a stopword; a hash set decides."""
    return ~word.isin("", *(spanish_stopwords() if stopwords is None else stopwords))


def tokens(text: Column, stopwords: tuple[str, ...] | None = None) -> Column:
    """Array of tokens in their order, with repeats, without stopwords; of a null text, empty."""
    return F.filter(_parts(text), lambda w: is_token(w, stopwords))


def token_rows(df: DataFrame, keys: list[str | Column], text: str = "text", stopwords: tuple[str, ...] | None = None) -> DataFrame:
    """A row with the keys and `term` for each token; stopwords are dropped after the words are rows, in generated code."""
    return df.select(*keys, F.explode(_parts(F.col(text))).alias("term")).filter(is_token(F.col("term"), stopwords))


def word_counts(text: Column) -> Column:
    """Array of a text's distinct words and their numbers (term, tf), stopwords among them: the words are sorted and the runs measured, in the row."""

    def starts(words: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.get(words, i).eqNullSafe(F.get(words, i - 1)))
        return F.flatten(F.transform(F.array(found), lambda first: runs(words, first)))

    def runs(words: Column, first: Column) -> Column:
        after = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(words)))
        return F.zip_with(first, after, lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).cast("long").alias("tf")))

    return F.flatten(F.transform(F.array(F.sort_array(_parts(text))), starts))  # of arrays of one, so that each is evaluated once


# The Spanish Snowball algorithm. Its vowels, suffixes and pronouns.
_VOWEL = "aeiouáéíóúü"
_PRONOUNS = "selas selos sela selo las les los nos me se la le lo"
_ACCENTED = "iéndo ándo ár ér ír"
_PLAIN = "ando iendo ar er ir"
_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
_DELETE_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion"
_LOG, _U, _ENTE = "logía logías", "ución uciones", "encia encias"
_IDAD, _IVA = "idad idades", "iva ivo ivas ivos"
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_EN_VERBS = "en es éis emos"
_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
    "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis "
    "asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_RESIDUAL = "os a o á í ó"


def _any(words: str) -> str:
    return "|".join(sorted(words.split(), key=lambda w: (-len(w), w)))


def _ends(value: str, words: str) -> str:
    return f"regexp_extract({value}, '(?:{_any(words)})$', 0)"


def _in(value: str, words: str) -> str:
    return f"{value} in ({', '.join(repr(w) for w in words.split())})"


def _cut(value: str, n: str) -> str:
    return f"substr({value}, 1, length({value}) - {n})"


def stem_steps(word: str) -> list[tuple[str, str]]:
    """(column, SQL) in the order they build on each other; the last one, `stem`, is the stem. The SQL is common to Spark and other engines."""
    v, c = f"[{_VOWEL}]", f"[^{_VOWEL}]"
    first = f"^{c}*{v}+{c}"

    def off(base: str, words: str, region: str) -> str:
        """base without one of the endings, if it has one that lies in the region."""
        ending = _ends(base, words)
        return f"case when {ending} <> '' and length({base}) - length({ending}) >= {region} then {_cut(base, f'length({ending})')} else {base} end"

    held = "length(w0) - length(e1)"
    return [
        ("p1", f"length(regexp_extract({word}, '{first}', 0))"),
        ("r1", f"case when p1 > 0 then p1 else length({word}) end"),
        ("p2", f"length(regexp_extract(substr({word}, r1 + 1), '{first}', 0))"),
        ("r2", f"case when p2 > 0 then r1 + p2 else length({word}) end"),
        ("pv", f"length(regexp_extract({word}, '^(?:.{c}+{v}|{v}{v}+{c}|{c}{v}.)', 0))"),
        ("rv", f"case when pv > 0 then pv else length({word}) end"),
        # attached pronouns
        ("e0", _ends(f"substr({word}, rv + 1)", _PRONOUNS)),
        ("b0", _cut(word, "length(e0)")),
        ("v0", "substr(b0, rv + 1)"),
        ("a0", f"case when e0 <> '' then {_ends('v0', _ACCENTED)} else '' end"),
        (
            "w0",
            f"case when e0 = '' then {word} when a0 <> '' then concat({_cut('b0', 'length(a0)')}, translate(a0, 'áéí', 'aei')) "
            f"when {_ends('v0', _PLAIN)} <> '' then b0 when {_ends('v0', 'yendo')} <> '' and {_ends('b0', 'uyendo')} <> '' then b0 else {word} end",
        ),
        # standard endings
        ("e1", _ends("w0", " ".join([_DELETE, _DELETE_IC, _LOG, _U, _ENTE, "amente mente", _IDAD, _IVA]))),
        ("b1", _cut("w0", "length(e1)")),
        ("iv", off("b1", "iv", "r2")),
        (
            "w1",
            f"case when e1 = '' then w0 when e1 = 'amente' then case when {held} < r1 then w0 when iv <> b1 then {off('iv', 'at', 'r2')} else {off('b1', 'os ic ad', 'r2')} end "
            f"when {held} < r2 then w0 when {_in('e1', _DELETE)} then b1 when {_in('e1', _DELETE_IC)} then {off('b1', 'ic', 'r2')} when {_in('e1', _LOG)} then concat(b1, 'log') "
            f"when {_in('e1', _U)} then concat(b1, 'u') when {_in('e1', _ENTE)} then concat(b1, 'ente') when e1 = 'mente' then {off('b1', 'ante able ible', 'r2')} "
            f"when {_in('e1', _IDAD)} then {off('b1', 'abil ic iv', 'r2')} else {off('b1', 'at', 'r2')} end",
        ),
        # verbs, if nothing was cut so far
        ("e2", f"case when w1 = w0 then {_ends('substr(w1, rv + 1)', _Y_VERBS)} else '' end"),
        ("w2", f"case when e2 <> '' and substr(w1, length(w1) - length(e2), 1) = 'u' then {_cut('w1', 'length(e2)')} else w1 end"),
        ("e3", f"case when w2 = w0 then {_ends('substr(w2, rv + 1)', f'{_EN_VERBS} {_VERBS}')} else '' end"),
        ("b3", _cut("w2", "length(e3)")),
        ("w3", f"case when {_in('e3', _EN_VERBS)} and {_ends('b3', 'gu')} <> '' then {_cut('b3', '1')} else b3 end"),
        # residual
        ("e4", _ends("substr(w3, rv + 1)", f"{_RESIDUAL} e é")),
        ("b4", _cut("w3", "length(e4)")),
        ("w4", f"case when {_in('e4', 'e é')} and {_ends('b4', 'gu')} <> '' and length(b4) > rv then {_cut('b4', '1')} else b4 end"),
        ("stem", "translate(w4, 'áéíóú', 'aeiou')"),
    ]


def _qualified(sql: str, names: list[str], row: str) -> str:
    """The expression with its column names taken from a struct; quoted text stays."""
    pattern = re.compile(rf"\b({'|'.join(names)})\b")
    return "'".join(part if i % 2 else pattern.sub(rf"{row}.\1", part) for i, part in enumerate(sql.split("'")))


def stemmed(vocabulary: DataFrame, word: str = "term") -> DataFrame:
    """The vocabulary with a column `stem`. Meant for distinct words, to be joined back.

    The steps are nested as transforms of an array of one struct, so that each
    one is evaluated once; as columns, Catalyst would put them into each other.
    """
    names, nested = ["term"], f"array(named_struct('term', `{word}`))"
    for name, sql in stem_steps("term"):
        fields = ", ".join(f"'{n}', x.{n}" for n in names)
        nested = f"transform({nested}, x -> named_struct({fields}, '{name}', {_qualified(sql, names, 'x')}))"
        names.append(name)
    return vocabulary.withColumn("stem", F.expr(f"element_at({nested}, 1).stem"))
